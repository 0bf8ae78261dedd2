"""The nightly score: segment statistics, hedonic models and one score row per listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import scoring as s
from parcelwise.operators import hedonic
from parcelwise.operators.history import latest_stats
from parcelwise.operators.segments import relaxed_stats, with_segment
from parcelwise.plans.market import rent_comparables, time_on_market
from parcelwise.session import materialize


def market_stats(population: DataFrame, as_of_date: Column, listing_kind: str | None = "prodej",
                 min_n: int = s.MIN_SAMPLES) -> DataFrame:
    """Statistics rows of one day for every segment of the population that resolves.

    ``listing_kind=None`` pools sales and rentals.
    """
    if listing_kind:
        population = population.where(F.col("listing_kind") == listing_kind)
    found = relaxed_stats(population, min_n).where(F.col("relaxation_level").isNotNull())
    two = lambda c: F.round(c, 2).cast("decimal(14,2)")
    return found.select(
        "segment_id", "segment_key", as_of_date.alias("as_of_date"),
        F.col("n_samples").cast("int").alias("n_samples"),
        *[two(F.col(c)).alias(f"ppm2_{c}") for c in ("median", "trimmed_mean", "p25", "p75", "stddev")],
        "relaxation_level",
    )


def market_inputs(listings: DataFrame, as_of: Column) -> DataFrame:
    """(segment_key, dom_median_days, turnover_quarterly, rent_ppm2, rent_n, rent_level) of all ``listings``,
    closed ones and rentals included: what liquidity and yield need besides prices."""
    sold = time_on_market(with_segment(listings), ["segment_key"], as_of).select(
        "segment_key", F.col("dom_median_days").cast("double").alias("dom_median_days"), "turnover_quarterly"
    )
    rents = rent_comparables(listings).where(F.col("rent_level").isNotNull()).select(
        "segment_key", "rent_ppm2", "rent_n", "rent_level"
    )
    return sold.join(rents, "segment_key", "full")


def with_model(population: DataFrame, models: DataFrame | None) -> DataFrame:
    """Add predicted_log, actual_log and hedonic_fit."""
    if models is None:
        return population.select(
            "*", F.lit(None).cast("double").alias("predicted_log"),
            F.log(s.ppm2(F.col("price"), F.col("size_m2"))).alias("actual_log"),
            F.lit(False).alias("hedonic_fit"),
        )
    return hedonic.with_predictions(population, models)


_OPTIONAL = {
    "photo_count": "int", "has_lift": "boolean", "hoa_czk_per_month": "double",
    "address_precision": "string", "dist_metro_m": "double", "dist_tram_m": "double",
    "dist_train_m": "double", "dist_park_m": "double", "dist_road_m": "double",
    "amenity_counts": "map<string,int>",
}
_STAT_COLUMNS = {
    "n_samples": "int", "relaxation_level": "int", "ppm2_median": "double", "ppm2_p25": "double",
    "dom_median_days": "double", "turnover_quarterly": "double", "rent_ppm2": "double",
    "rent_n": "bigint", "rent_level": "int",
}


def score_rows(
    population: DataFrame,
    stats: DataFrame,
    models: DataFrame | None,
    config: s.ScoringConfig,
    as_of: Column,
    model_version: str = "v1",
) -> DataFrame:
    """One score row per listing of the population.

    ``stats``: the newest statistics per segment (segment_key, n_samples, relaxation_level,
    ppm2_median, ppm2_p25 and, when known, dom_median_days, turnover_quarterly, rent_ppm2, rent_n,
    rent_level). Missing optional inputs leave their component NULL. Everything after the two joins is one
    projection per dependency step.
    """
    have = set(population.columns)
    base = population.select(
        "*", *[F.lit(None).cast(k).alias(c) for c, k in _OPTIONAL.items() if c not in have]
    )
    base = with_segment(with_model(base, models))
    held = set(stats.columns)
    # written first, so that its size is known before the listings are shuffled for it: a row per segment is mostly broadcast
    side = materialize(stats.select(
        F.col("segment_key").alias("__key"),
        *[
            (F.col(c) if c in held else F.lit(None)).cast(k).alias(f"__{c}")
            for c, k in _STAT_COLUMNS.items()
        ],
    ))
    c = F.col
    joined = base.join(side, c("segment_key") == c("__key"), "left")
    # without a rent level of their own, rental figures share the segment's level
    level = F.coalesce(c("__relaxation_level"), F.lit(s.MAX_LEVEL))
    parts = joined.select(
        "*",
        F.coalesce(c("__n_samples"), F.lit(0)).alias("sample_size"),
        level.alias("relaxation_level"),
        s.undervaluation_pct(c("predicted_log"), c("actual_log")).alias("undervaluation_pct"),
        F.when(
            c("predicted_log").isNotNull() & c("actual_log").isNotNull(),
            s.undervaluation_abs(c("predicted_log"), c("size_m2"), c("price")),
        ).alias("undervaluation_abs"),
        F.struct(*[
            flag.alias(name)
            for name, flag in s.raised_flags(
                c("price"), c("size_m2"), c("ownership_type"), c("building_type"), c("year_built"),
                c("floor_current"), c("floor_total"), c("has_lift"), c("energy_class"),
                c("photo_count"), c("description"), c("__ppm2_median"), c("__ppm2_p25"),
            ).items()
        ]).alias("__flags"),
        s.completeness().alias("completeness"),
        s.age_days(c("first_seen_at"), as_of).alias("freshness_days"),
        s.liquidity_score(c("__dom_median_days"), c("__turnover_quarterly")).alias("liquidity_score"),
        s.rental_yield(
            c("price"), c("size_m2"), c("hoa_czk_per_month"), c("__rent_ppm2"),
            F.when(c("__rent_ppm2").isNotNull(), F.coalesce(c("__rent_n"), c("__n_samples").cast("bigint")))
            .otherwise(0),
            F.coalesce(c("__rent_level"), level),
        ).alias("rent"),
        s.location_breakdown(
            c("dist_metro_m"), c("dist_tram_m"), c("dist_train_m"), c("amenity_counts"),
            c("dist_park_m"), c("dist_road_m"),
        ).alias("location"),
    )
    raised = {name: c(f"__flags.{name}") for name in s.SEVERITIES}
    scored = parts.select(
        "*",
        s.risk_score_of(raised).alias("risk_score"),
        s.flag_names(raised).alias("risk_flags"),
        s.confidence(
            c("sample_size"), c("relaxation_level"), c("completeness"), c("address_precision"),
            c("freshness_days"),
        ).alias("confidence_score"),
    )
    components = {
        "undervaluation_pct": c("undervaluation_pct"),
        "yield_gross_pct": c("rent.gross_pct"),
        "liquidity_score": c("liquidity_score"),
        "location_score": c("location.composite"),
        "risk_score": c("risk_score"),
    }
    return scored.select(
        "listing_id",
        F.lit(model_version).alias("model_version"),
        as_of.cast("timestamp").alias("computed_at"),
        "segment_id",
        s.to_decimal(c("undervaluation_pct"), 3, 6).alias("undervaluation_pct"),
        s.to_decimal(c("undervaluation_abs"), 2, 14).alias("undervaluation_abs"),
        s.to_decimal(c("rent.gross_pct"), 2, 5).alias("yield_gross_pct"),
        s.to_decimal(c("rent.confidence"), 3, 4).alias("yield_confidence"),
        s.to_decimal(c("liquidity_score"), 2, 5).alias("liquidity_score"),
        s.to_decimal(c("location.composite"), 2, 5).alias("location_score"),
        s.to_decimal(c("risk_score"), 2, 5).alias("risk_score"),
        s.to_decimal(c("confidence_score"), 3, 4).alias("confidence_score"),
        s.to_decimal(s.composite_score(components, c("rent.confidence"), config), 2, 5)
        .alias("composite"),
        F.struct(
            "predicted_log", "actual_log", "sample_size", "relaxation_level", "completeness",
            "freshness_days", "hedonic_fit", c("rent.monthly_rent").alias("monthly_rent"),
            c("rent.annual_hoa").alias("annual_hoa"),
            c("rent.default_hoa").alias("used_default_hoa"),
            c("location").alias("location_breakdown"),
        ).alias("components"),
        "risk_flags",
    )


def nightly(
    population: DataFrame, config: s.ScoringConfig, as_of: Column, model_version: str = "v1",
    stats_history: DataFrame | None = None, block_rows: int = hedonic.BLOCK_ROWS,
    market: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(today's statistics, models, scores) of a population.

    ``market`` holds all listings, closed ones and rentals too; with it the statistics carry time on market,
    turnover and rents, so that liquidity and yield are scored. Location inputs (distances, amenity
    counts) are columns of the population, as the spatial operators add them.

    The population is written once, in even parts: statistics, models and scores each read it, and
    the listings of a large property leave the join in few partitions.
    """
    pop = materialize(population, even=True)
    today = market_stats(pop, F.to_date(as_of), listing_kind=None)
    if market is not None:
        today = today.join(market_inputs(market, as_of), "segment_key", "left")
    today = materialize(today)
    history = today if stats_history is None else stats_history.unionByName(
        today, allowMissingColumns=True
    )
    models = hedonic.fit_models(pop, block_rows=block_rows)
    return today, models, score_rows(pop, latest_stats(history), models, config, as_of, model_version)


def stale_listings(listings: DataFrame, scores: DataFrame, stats: DataFrame,
                   config_changed_at: Column) -> DataFrame:
    """Spec-only: listings never scored, or whose own data, segment statistics or configuration
    changed after their last score. ``listings``: listing_id, segment_id, updated_at; ``stats``:
    segment_id, updated_at."""
    last = scores.groupBy("listing_id").agg(F.max("computed_at").alias("__scored"))
    stat = stats.groupBy("segment_id").agg(F.max("updated_at").alias("__stat"))
    changed = F.greatest("updated_at", "__stat", config_changed_at)
    return (
        listings.join(last, "listing_id", "left")
        .join(stat, "segment_id", "left")
        .where(F.col("__scored").isNull() | (F.col("__scored") < changed))
        .select(*listings.columns)
    )


def compare_versions(scores: DataFrame, left: str, right: str) -> DataFrame:
    """Spec-only: per listing scored by both versions the two composites, their ranks among the
    common listings (1 = best) and the difference."""
    from parcelwise.operators.history import latest_scores
    from parcelwise.operators.order_stats import distributed_rank

    newest = latest_scores(scores.where(F.col("model_version").isin(left, right)), per_model=True)
    a = newest.where(F.col("model_version") == left)
    b = newest.where(F.col("model_version") == right)
    both = materialize(
        a.select("listing_id", F.col("composite").alias("left_composite")).join(
            b.select("listing_id", F.col("composite").alias("right_composite")), "listing_id"
        )
    )
    ranked = distributed_rank(
        distributed_rank(both, "left_composite", "left_rank"), "right_composite", "right_rank"
    )
    return ranked.select(
        "listing_id", "left_composite", "right_composite", "left_rank", "right_rank",
        (F.col("right_rank") - F.col("left_rank")).alias("rank_change"),
    )


def component_refs(scores: DataFrame) -> DataFrame:
    """Spec-only: mean and population deviation of every component over the corpus."""
    aggs = []
    for name in s.COMPONENTS:
        if name in scores.columns:
            aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_stddev")]
    return scores.agg(*aggs)

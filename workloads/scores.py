"""Score histories, hedonic models and the full score row."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions import scoring as s
from parcelwise.functions.keys import key_text
from parcelwise.operators import hedonic
from parcelwise.operators import history as h
from parcelwise.operators.skew import latest_per_key
from parcelwise.plans import scoring as plan
from parcelwise.plans.search import scoring_population
from parcelwise.sources import upserts
from workloads.analytics import BASE_SQL, ladder_sql
from workloads.registry import AS_OF_SQL, SCORES, L, P, as_of, query, r, rounded, scores

V1 = s.ScoringConfig(s.WEIGHTS_V1, s.DEFAULT_REFS)


@query(
    "W1_S13_latest_score_per_listing",
    f"""SELECT listing_id, model_version, composite FROM ({SCORES})
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY computed_at DESC, model_version DESC) = 1""",
)
def _latest(spark, sf_dir):
    return h.latest_scores(scores(spark, sf_dir).drop("components")).select("listing_id", "model_version", "composite")


@query(
    "W1_latest_score_per_model",
    f"""SELECT listing_id, model_version, composite FROM ({SCORES})
QUALIFY row_number() OVER (PARTITION BY listing_id, model_version ORDER BY computed_at DESC) = 1""",
)
def _latest_model(spark, sf_dir):
    return h.latest_scores(scores(spark, sf_dir).drop("components"), per_model=True).select(
        "listing_id", "model_version", "composite"
    )


@query(
    "F5_publicly_visible_scores",
    f"SELECT listing_id, composite FROM ({SCORES}) WHERE coalesce(confidence_score, 0) >= 0.3",
)
def _visible(spark, sf_dir):
    return h.publicly_visible(scores(spark, sf_dir)).select("listing_id", "composite")


# Every column of a score, from one event each.
_PARTS = {"segment_id": "event_id % 7", "undervaluation_pct": "value / 7", "undervaluation_abs": "value * 1000", "yield_gross_pct": "value / 50",
          "yield_confidence": "(event_id % 10) / 10", "liquidity_score": "100 - value / 10", "location_score": "value / 9", "risk_score": "value / 20"}
_FULL = f"""SELECT user_id AS listing_id, event_type AS model_version, ts AS computed_at, {", ".join(f"{v} AS {k}" for k, v in _PARTS.items())},
  CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100 END AS confidence_score, value AS composite,
  CASE WHEN event_id % 4 > 0 THEN 'value=' || CAST(floor(value) AS BIGINT) ELSE '' END AS components, CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END AS flags
FROM events"""


@query(
    "F15_score_view_of_one_listing",
    f"""SELECT listing_id, model_version, epoch_us(computed_at) AS at, segment_id, {", ".join(r(k) + f" AS {k}" for k in list(_PARTS)[1:])},
  {r("confidence_score")} AS confidence_score, {r("composite")} AS composite, components, flags
FROM (SELECT * FROM ({_FULL}) QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY computed_at DESC, model_version DESC) = 1)
WHERE coalesce(confidence_score, 0) >= 0.3""",
)
def _view(spark, sf_dir):
    e = F.col("event_id")
    full = ad.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("listing_id"), F.col("event_type").alias("model_version"), F.col("ts").alias("computed_at"),
        *[F.expr(v).alias(k) for k, v in _PARTS.items()], F.when(e % 10 > 0, (e % 100) / 100).alias("confidence_score"),
        F.col("value").alias("composite"), F.when(e % 4 > 0, F.create_map(F.lit("value"), F.col("value"))).alias("components"),
        F.when(e % 3 > 0, F.array("event_type")).alias("risk_flags"),
    )
    parts = F.array_join(F.transform(F.map_entries("components"), lambda x: F.concat(x["key"], F.lit("="), F.floor(x["value"]).cast("string"))), ",")
    return rounded(h.shown_score(full).select(
        "listing_id", "model_version", F.unix_micros(F.col("computed_at").cast("timestamp")).alias("at"), *_PARTS, "confidence_score", "composite",
        parts.alias("components"), F.array_join("risk_flags", ",").alias("flags"),
    ))


@query(
    "T4_score_history_page_with_total",
    f"""WITH s AS ({SCORES}), m AS (SELECT * FROM s WHERE listing_id = (SELECT max(listing_id) FROM s))
SELECT listing_id, model_version, composite, (SELECT count(*) FROM m) AS total FROM m ORDER BY computed_at DESC, model_version DESC LIMIT 10 OFFSET 3""",
)
def _history_total(spark, sf_dir):
    df = scores(spark, sf_dir)
    return h.score_history_page(df, df.agg(F.max("listing_id")).head()[0], 10, 3).select("listing_id", "model_version", "composite", "total")


@query(
    "T4_score_history_page",
    f"""WITH s AS ({SCORES}) SELECT listing_id, model_version, composite FROM s WHERE listing_id = (SELECT min(listing_id) FROM s)
ORDER BY computed_at DESC, model_version DESC LIMIT 20 OFFSET 5""",
)
def _history(spark, sf_dir):
    df = scores(spark, sf_dir)
    return h.score_history(df, df.agg(F.min("listing_id")).head()[0], 20, 5).select(
        "listing_id", "model_version", "composite"
    )


DAILY = "SELECT user_id AS segment_id, CAST(ts AS DATE) AS as_of_date, count(*) AS n_samples, avg(value) AS ppm2_median FROM events GROUP BY ALL"


def daily_stats(spark, sf_dir):
    return (
        ad.table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("segment_id"), F.col("ts").cast("date").alias("as_of_date"))
        .agg(F.count(F.lit(1)).alias("n_samples"), F.avg("value").alias("ppm2_median"))
    )


@query(
    "J4_S11_latest_statistics_per_segment",
    f"""SELECT segment_id, strftime(as_of_date, '%Y-%m-%d') AS as_of_day, n_samples, {r("ppm2_median")} AS ppm2_median FROM ({DAILY})
QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY as_of_date DESC) = 1""",
)
def _latest_stats(spark, sf_dir):
    return rounded(h.latest_stats(daily_stats(spark, sf_dir)).select(
        "segment_id", F.date_format("as_of_date", "yyyy-MM-dd").alias("as_of_day"), "n_samples", "ppm2_median"
    ))


@query(
    "J6_segments_without_statistics",
    f"SELECT c_custkey AS segment_id FROM customer WHERE c_custkey NOT IN (SELECT segment_id FROM ({DAILY}))",
)
def _without(spark, sf_dir):
    segments = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("segment_id"))
    return upserts.segments_without_stats(segments, daily_stats(spark, sf_dir))


@query(
    "J5_S10_null_safe_segment_lookup",
    f"""WITH l AS ({L}), k AS (SELECT ownership_type, condition, year_built, count(*) AS n FROM l GROUP BY ALL)
SELECT l.listing_id, k.n FROM l JOIN k ON l.ownership_type IS NOT DISTINCT FROM k.ownership_type
 AND l.condition IS NOT DISTINCT FROM k.condition AND l.year_built IS NOT DISTINCT FROM k.year_built""",
)
def _null_safe(spark, sf_dir):
    l = ad.listings(spark, sf_dir).select(
        "listing_id", key_text("ownership_type", "condition", "year_built").alias("k")
    )
    return l.join(l.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k").select("listing_id", "n")


def population(spark, sf_dir):
    return scoring_population(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), as_of(), "")


@query(
    "A9_hedonic_category_levels",
    f"""WITH b AS (SELECT CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city, ownership_type AS own,
   building_type, disposition, condition, energy_class, city_district, CASE WHEN year_built IS NULL THEN 'unknown' WHEN year_built < 1948 THEN '<1948'
   WHEN year_built < 1990 THEN '1948-1989' WHEN year_built < 2010 THEN '1990-2009' ELSE '2010+' END AS year_built_bucket FROM ({L}) JOIN ({P}) USING (property_id)
   WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY AND price > 0 AND size_m2 > 0),
u AS (UNPIVOT b ON building_type, disposition, condition, energy_class, city_district, year_built_bucket INTO NAME feature VALUE level),
d AS (SELECT DISTINCT city, own, feature, level FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY city, own, feature ORDER BY level) AS rn FROM d)
SELECT city, own AS ownership_type, feature, coalesce(string_agg(level, ',' ORDER BY level) FILTER (WHERE rn > 1), '') AS levels
FROM n GROUP BY ALL""".replace("UNPIVOT b ON building_type", "UNPIVOT (SELECT * REPLACE (city_district || '' AS city_district) FROM b) ON building_type"),
)
def _levels(spark, sf_dir):
    rows = hedonic.trainable(hedonic.design(population(spark, sf_dir)))
    return hedonic.category_levels(rows).select(
        "city", "ownership_type", "feature", F.array_join("levels", ",").alias("levels")
    )


@query(
    "A10_hedonic_group_sizes",
    f"""SELECT CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city, property_type, ownership_type, count(*) AS n_samples
FROM ({L}) JOIN ({P}) USING (property_id) WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY
 AND price > 0 AND size_m2 > 0 GROUP BY ALL HAVING count(*) >= 50""",
)
def _sizes(spark, sf_dir):
    return hedonic.fit_models(population(spark, sf_dir)).select(
        "city", "property_type", "ownership_type", "n_samples"
    )


_FIT_GROUPS = f"""SELECT CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city, property_type, ownership_type,
  building_type, disposition, condition, energy_class, city_district || '' AS city_district,
  CASE WHEN year_built IS NULL THEN 'unknown' WHEN year_built < 1948 THEN '<1948' WHEN year_built < 1990 THEN '1948-1989'
       WHEN year_built < 2010 THEN '1990-2009' ELSE '2010+' END AS year_built_bucket
FROM ({L}) JOIN ({P}) USING (property_id) WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY AND price > 0 AND size_m2 > 0"""


@query(
    "A10_U3_score_equations",
    f"""WITH b AS ({_FIT_GROUPS}),
g AS (SELECT city, property_type, ownership_type, count(*) AS n_samples FROM b GROUP BY ALL HAVING count(*) >= {hedonic.MIN_FIT_ROWS}),
u AS (UNPIVOT b ON {", ".join(hedonic.CATEGORICAL)} INTO NAME name VALUE level),
d AS (SELECT DISTINCT city, property_type, ownership_type, name, level FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY city, property_type, ownership_type, name ORDER BY level) AS rn FROM d),
f AS (SELECT city, property_type, ownership_type, 'cat__' || name || '__' || level AS feature FROM n WHERE rn > 1
      UNION ALL SELECT city, property_type, ownership_type, unnest({["intercept", *hedonic.CONTINUOUS, *hedonic.BINARY]}) FROM g)
SELECT f.*, n_samples, CAST(0 AS DOUBLE) AS excess FROM f JOIN g USING (city, property_type, ownership_type)""",
)
def _equations(spark, sf_dir):
    """Every model solves its equations: the oracle lists all of their columns with nothing left over."""
    pop = population(spark, sf_dir)
    left = hedonic.score_equations(pop, hedonic.fit_models(pop))
    return left.withColumn("excess", F.abs(F.round("excess", 3)))


@query("A10_U3_P5_hedonic_models")
def _models(spark, sf_dir):
    m = hedonic.fit_models(population(spark, sf_dir))
    return m.select(
        "city", "property_type", "ownership_type", F.round("intercept", 6).alias("intercept"), "n_samples",
        "n_features", F.round("residual_stddev", 6).alias("residual_stddev"),
        F.round(F.col("coefficients")["log_size_m2"], 6).alias("log_size_coefficient"),
    )


@query("H3_H4_H5_hedonic_predictions")
def _predictions(spark, sf_dir):
    pop = population(spark, sf_dir)
    p = hedonic.predict(pop, hedonic.fit_models(pop))
    return p.select(
        "listing_id", F.round("predicted_log", 6).alias("predicted_log"),
        F.round(s.undervaluation_pct(F.col("predicted_log"), F.col("actual_log")), 4).alias("undervaluation_pct"),
    )


def _nightly(spark, sf_dir):
    return plan.nightly(population(spark, sf_dir), V1, as_of())


@query("K3_S12_nightly_scores")
def _scores(spark, sf_dir):
    _, _, out = _nightly(spark, sf_dir)
    return out.select(
        "listing_id", "segment_id", "undervaluation_pct", "risk_score", "confidence_score", "composite",
        F.array_join("risk_flags", ",").alias("flags"),
    )


# The score row without a hedonic model is plain arithmetic over the ladder's statistics.
LADDER = ladder_sql(BASE_SQL)
NO_MODEL = f"""
WITH stat AS ({LADDER}),
l AS (SELECT *, {"CASE WHEN size_m2 < 35 THEN '<35' WHEN size_m2 < 50 THEN '35-50' WHEN size_m2 < 70 THEN '50-70' WHEN size_m2 < 90 THEN '70-90' WHEN size_m2 < 120 THEN '90-120' WHEN size_m2 < 160 THEN '120-160' ELSE '>160' END"} AS sz,
   CASE condition WHEN 'novostavba' THEN 'new' WHEN 'velmi_dobry' THEN 'very_good' WHEN 'po_rekonstrukci' THEN 'very_good'
   WHEN 'dobry' THEN 'good' WHEN 'pred_rekonstrukci' THEN 'needs_work' WHEN 'spatny' THEN 'ruin' ELSE 'unknown' END AS cb
   FROM ({L}) JOIN ({P}) USING (property_id) WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY),
j AS (SELECT l.*, coalesce(s.n_samples, 0) AS n, coalesce(s.relaxation_level, 5) AS lv,
        CAST(CAST(s.median AS DECIMAL(14, 2)) AS DOUBLE) AS med, CAST(CAST(s.p25 AS DECIMAL(14, 2)) AS DOUBLE) AS q1
      FROM l LEFT JOIN (SELECT * FROM stat WHERE relaxation_level IS NOT NULL) s
        ON s.city_district = l.city_district AND s.disposition = l.disposition AND s.ownership_type = l.ownership_type
       AND s.building_type = l.building_type AND s.size_bucket = l.sz AND s.condition_bucket = l.cb),
f AS (SELECT *, coalesce(price / size_m2 < 0.6 * q1, false) AS f1, description LIKE '%EXEKUCE%' AS f2,
   coalesce(building_type = 'panel' AND year_built BETWEEN 1960 AND 1990, false) AND NOT description LIKE '%Revitaliz%' AS f4,
   coalesce(has_lift = false AND floor_current = floor_total AND floor_total > 3, false) AS f5,
   energy_class IN ('F', 'G') AS f6, coalesce(photo_count < 4, false) AS f7, description LIKE '%HAVARIJNÍ stav%' AS f8,
   (7 + CAST(condition IS NOT NULL AS INT) + CAST(year_built IS NOT NULL AS INT)) / 9.0 AS comp,
   greatest(floor((epoch_us({AS_OF_SQL}) - epoch_us(first_seen_at)) / 86400000000.0), 0) AS age FROM j),
k AS (SELECT *, least(100, (3 * f1::INT + 3 * f2::INT + 2 * f4::INT + f5::INT + f6::INT + f7::INT + 2 * f8::INT) / 8.0 * 100) AS risk FROM f)
SELECT listing_id, CAST(n AS INT) AS sample_size, CAST(lv AS INT) AS relaxation_level, {r("risk")} AS risk_score,
 concat_ws(',', CASE WHEN f1 THEN 'price_too_low' END, CASE WHEN f2 THEN 'legal_encumbrance' END, CASE WHEN f4 THEN 'panel_capex_due' END,
  CASE WHEN f5 THEN 'top_floor_no_lift' END, CASE WHEN f6 THEN 'class_g_energy' END, CASE WHEN f7 THEN 'photo_count_low' END, CASE WHEN f8 THEN 'description_keywords' END) AS flags,
 {r("round(1 / (1 + exp(-0.1 * (n - 30))) * (1 - 0.4 * lv / 5.0) * comp * CASE address_precision WHEN 'rooftop' THEN 1.0 WHEN 'source_gps' THEN 0.6 ELSE 0.5 END * (1 - 0.5 * (least(greatest(age, 30), 180) - 30) / 150.0), 3)")} AS confidence_score,
 {r("round(100 / (1 + exp(0.8 * (risk - 10) / 15)), 2)")} AS composite
FROM k"""


@query("K3_score_rows_without_model", NO_MODEL)
def _no_model(spark, sf_dir):
    from parcelwise.session import materialize

    pop = materialize(population(spark, sf_dir), even=True)
    today = plan.market_stats(pop, F.to_date(as_of()), listing_kind=None)
    out = plan.score_rows(pop, today, None, V1, as_of())
    return rounded(out.select(
        "listing_id", F.col("components.sample_size").alias("sample_size"),
        F.col("components.relaxation_level").alias("relaxation_level"),
        F.col("risk_score").cast("double").alias("risk_score"), F.array_join("risk_flags", ",").alias("flags"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
        F.col("composite").cast("double").alias("composite"),
    ))


@query(
    "A15_component_reference_distributions",
    f"""SELECT {r("avg(risk_score)")} AS risk_score_mean, {r("stddev_pop(risk_score)")} AS risk_score_stddev,
 {r("avg(liquidity_score)")} AS liquidity_score_mean, {r("stddev_pop(liquidity_score)")} AS liquidity_score_stddev
FROM (SELECT value AS risk_score, CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100 END AS liquidity_score FROM events)""",
)
def _refs(spark, sf_dir):
    df = scores(spark, sf_dir).select(
        F.col("composite").alias("risk_score"), F.col("confidence_score").alias("liquidity_score")
    )
    return rounded(plan.component_refs(df))


@query(
    "A20_compare_model_versions",
    f"""WITH s AS (SELECT listing_id, model_version, arg_max(composite, computed_at) AS composite FROM ({SCORES}) GROUP BY ALL),
b AS (SELECT a.listing_id, a.composite AS lc, c.composite AS rc FROM s a JOIN s c USING (listing_id) WHERE a.model_version = 'view' AND c.model_version = 'click'),
k AS (SELECT *, rank() OVER (ORDER BY lc DESC) AS lr, rank() OVER (ORDER BY rc DESC) AS rr FROM b)
SELECT listing_id, lc AS left_composite, rc AS right_composite, lr AS left_rank, rr AS right_rank, rr - lr AS rank_change FROM k""",
)
def _compare(spark, sf_dir):
    return plan.compare_versions(scores(spark, sf_dir).drop("components"), "view", "click")


@query(
    "J24_listings_to_rescore",
    f"""WITH u AS (SELECT c_custkey AS listing_id, c_nationkey AS segment_id FROM customer),
w AS (SELECT u.*, max(o_orderdate) AS updated_at FROM u JOIN orders ON o_custkey = listing_id GROUP BY ALL),
st AS (SELECT s_nationkey AS segment_id, TIMESTAMP '2000-01-01' + to_days(CAST(max(s_suppkey) * 3 AS INT)) AS updated_at FROM supplier GROUP BY ALL),
sc AS (SELECT o_custkey AS listing_id, max(o_orderdate) AS computed_at FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT w.listing_id, w.segment_id FROM w LEFT JOIN st USING (segment_id) LEFT JOIN sc USING (listing_id)
WHERE computed_at IS NULL OR computed_at < greatest(w.updated_at, coalesce(st.updated_at, w.updated_at), TIMESTAMP '1999-06-01')""",
)
def _stale(spark, sf_dir):
    from workloads.registry import moment

    orders, cust = ad.table(spark, sf_dir, "orders"), ad.table(spark, sf_dir, "customer")
    last = orders.groupBy(F.col("o_custkey").alias("listing_id")).agg(F.max("o_orderdate").alias("updated_at"))
    listings = cust.select(F.col("c_custkey").alias("listing_id"), F.col("c_nationkey").alias("segment_id")).join(
        last, "listing_id"
    )
    stats = ad.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("segment_id")).agg(
        (moment("2000-01-01T00:00:00") + F.make_dt_interval((F.max("s_suppkey") * 3).cast("int"))).alias("updated_at")
    )
    done = orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("listing_id"), F.col("o_orderdate").alias("computed_at")
    )
    return plan.stale_listings(listings, done, stats, moment("1999-06-01T00:00:00")).select("listing_id", "segment_id")

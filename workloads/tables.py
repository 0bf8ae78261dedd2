"""Table sinks as write-then-read queries, the order of groups, and predictions of a stated model."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions.keys import key_id
from parcelwise.operators import hedonic
from parcelwise.plans import analytics as an
from parcelwise.plans import scoring, search
from parcelwise.session import materialize, shared_dir
from parcelwise.sources import upserts
from workloads.registry import SCORES, L, P, as_of, query, r, rounded, scores, versions
from workloads.scores import NO_MODEL, V1, population


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


@query("S10_segment_register_after_two_batches", "SELECT DISTINCT event_type || '/' || user_id AS segment_key FROM events")
def _register(spark, sf_dir):
    key = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    events = ad.table(spark, sf_dir, "events").select("ts", key.alias("segment_key"), F.struct("event_type", "user_id").alias("segment"))
    batch = events.withColumn("segment_id", key_id("segment_key"))
    half = F.dayofmonth("ts") <= 15
    none = spark.createDataFrame([], batch.select("segment_id", "segment_key", "segment").schema)
    once = upserts.upsert_segments(none, batch.where(half))
    return upserts.upsert_segments(once, batch).select("segment_key")


@query(
    "S11_statistics_of_a_day_are_replaced",
    """SELECT user_id AS segment_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) * CASE WHEN day(ts) > 15 THEN 2 ELSE 1 END AS BIGINT) AS n
FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), day(ts)""",
)
def _stats(spark, sf_dir):
    path = _folder(spark)
    days = ad.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("segment_id"), F.to_date("ts").alias("as_of_date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # statistics arrive by date, so that a date is one file
    upserts.write_stats(days.repartition("as_of_date"), path)
    late = days.where(F.dayofmonth("as_of_date") > 15).withColumn("n", F.col("n") * 2)
    upserts.write_stats(late.repartition("as_of_date"), path)
    return spark.read.parquet(path).select("segment_id", F.date_format("as_of_date", "yyyy-MM-dd").alias("day"), "n")


@query(
    "S12_S13_appended_scores_and_latest_table",
    f"""SELECT listing_id, model_version, composite FROM ({SCORES})
QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY computed_at DESC, model_version DESC) = 1""",
)
def _latest(spark, sf_dir):
    path = _folder(spark)
    rows = scores(spark, sf_dir).drop("components")
    for part in (F.dayofmonth("computed_at") <= 15, F.dayofmonth("computed_at") > 15):
        batch = rows.where(part).withColumn("__day", F.to_date("computed_at"))
        upserts.append_scores(batch.repartition("__day").drop("__day"), f"{path}/scores")
    return upserts.refresh_latest_scores(spark, f"{path}/scores", f"{path}/latest").select("listing_id", "model_version", "composite")


@query(
    "T3_rank_of_localities_in_the_breakdown",
    f"""WITH g AS (SELECT coalesce(p.locality, '(neuvedeno)') AS group_key, count(*) AS n FROM ({L}) l LEFT JOIN ({P}) p ON p.property_id = l.property_id
  WHERE l.status = 'active' AND l.listing_kind = 'prodej' AND l.price IS NOT NULL AND l.size_m2 > 0 GROUP BY ALL)
SELECT group_key, n, CAST(row_number() OVER (ORDER BY n DESC, group_key) AS INT) AS place FROM g""",
)
def _rank(spark, sf_dir):
    out = an.breakdown(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), versions(spark, sf_dir), "locality", as_of())
    # the place in the returned order, not a rank computed anew
    arrived = out.select("group_key", "n", F.monotonically_increasing_id().alias("at"))
    return arrived.select("group_key", "n", F.row_number().over(Window.orderBy("at")).alias("place"))


# Stated models: (city, ownership) -> intercept and coefficients.
_MODELS = {
    ("Praha", "A"): (11.2, {"log_size_m2": -0.11, "floor_current": 0.013, "has_balcony": 0.04, "cat__building_type__panel": -0.07, "cat__condition__dobry": 0.02}),
    ("Praha", "N"): (10.9, {"log_size_m2": -0.2, "floor_current": 0.005, "has_balcony": 0.01, "cat__building_type__kamen": 0.3, "cat__condition__spatny": -0.25}),
    ("Brno", "R"): (10.1, {"log_size_m2": 0.03, "floor_current": -0.01, "has_cellar": 0.02, "cat__building_type__panel": -0.02, "cat__year_built_bucket__2010+": 0.1}),
}


def _term(name: str, value: float) -> str:
    if name.startswith("cat__year_built_bucket__"):
        return f"{value} * coalesce(CAST(year_built >= 2010 AS INT), 0)"
    if name.startswith("cat__"):
        _, feature, level = name.split("__")
        return f"{value} * coalesce(CAST({feature} = '{level}' AS INT), 0)"
    column = {"log_size_m2": "ln(size_m2)", "floor_current": "floor_current"}.get(name, f"CAST({name} AS INT)")
    return f"{value} * {column}"


_CASES = " ".join(
    f"WHEN city = '{c}' AND ownership_type = '{o}' THEN {i} + {' + '.join(_term(k, v) for k, v in m.items())}" for (c, o), (i, m) in _MODELS.items()
)


def _stated(spark):
    rows = [(c, "byt", o, i, m, 100, len(m), 0.1) for (c, o), (i, m) in _MODELS.items()]
    return spark.createDataFrame(rows, hedonic.MODEL_SCHEMA)


@query(
    "H3_H4_predictions_of_stated_models",
    f"""WITH l AS (SELECT *, CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city FROM ({L}) JOIN ({P}) USING (property_id)),
p AS (SELECT listing_id, CASE {_CASES} END AS y, ln(price / size_m2) AS actual FROM l)
SELECT listing_id, round(y, 9) AS predicted_log, round((exp(y) - exp(actual)) / exp(y) * 100, 6) AS below_pct, y IS NOT NULL AS hedonic_fit FROM p""",
)
def _predictions(spark, sf_dir):
    models = _stated(spark)
    listings = search.with_property(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), "inner")
    p = hedonic.predict(listings, models)
    y, actual = F.exp("predicted_log"), F.exp("actual_log")
    return p.select(
        "listing_id", F.round("predicted_log", 9).alias("predicted_log"), F.round((y - actual) / y * 100, 6).alias("below_pct"), "hedonic_fit"
    )


_WITH_MODEL = NO_MODEL[: NO_MODEL.rindex("SELECT listing_id, CAST(n AS INT)")].rstrip() + f""",
y AS (SELECT *, CASE {_CASES} END AS y, ln(price / size_m2) AS actual
      FROM (SELECT *, CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city FROM k)),
u AS (SELECT *, CASE WHEN y IS NOT NULL THEN greatest(least((exp(y - actual) - 1) * 100, 50), -50) END AS pct FROM y)
SELECT listing_id, {r("round(pct, 3)")} AS undervaluation_pct, {r("round(exp(y) * size_m2 - price, 2)")} AS undervaluation_abs, {r("risk")} AS risk_score,
  {r("round(100 / (1 + exp(-(1.5 * coalesce(pct, 0) / 15 - 0.8 * (risk - 10) / 15))), 2)")} AS composite FROM u"""


@query("K3_score_rows_with_stated_models", _WITH_MODEL)
def _with_model(spark, sf_dir):
    pop = materialize(population(spark, sf_dir), even=True)
    today = scoring.market_stats(pop, F.to_date(as_of()), listing_kind=None)
    out = scoring.score_rows(pop, today, _stated(spark), V1, as_of())
    return rounded(out.select("listing_id", *[
        F.col(x).cast("double").alias(x) for x in ("undervaluation_pct", "undervaluation_abs", "risk_score", "composite")
    ]))

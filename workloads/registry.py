"""Registration of queries and shared SQL fragments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def moment(text: str) -> Column:
    return F.lit(dt.datetime.fromisoformat(text)).cast("timestamp_ntz")


AS_OF = "1999-04-01T00:00:00"
AS_OF_SQL = "TIMESTAMP '1999-04-01'"


def as_of() -> Column:
    return moment(AS_OF)


L = ad.LISTINGS_SQL
P = ad.PROPERTIES_SQL
PLACES = ad.PLACES_SQL
PROBES = ad.PROBES_SQL

# A listing's price history: three observations 40 days apart, the middle one unknown for some.
VERSIONS = f"""
SELECT listing_id, first_seen_at + to_days(CAST(i * 40 AS INT)) AS observed_at,
       CASE WHEN i = 1 AND has_balcony THEN NULL ELSE price * (0.95 + i * 0.05) END AS price,
       status
FROM ({L}) l, range(3) r(i)
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    return (
        ad.listings(spark, sf_dir)
        .select("listing_id", "first_seen_at", "price", "status", "has_balcony",
                F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
        .select(
            "listing_id",
            (F.col("first_seen_at") + F.make_dt_interval(i * 40)).alias("observed_at"),
            F.when(~((i == 1) & F.col("has_balcony")), F.col("price") * (0.95 + i * 0.05)).alias("price"),
            "status",
        )
    )


# Scores over time: one row per event.
SCORES = """
SELECT user_id AS listing_id, event_type AS model_version, ts AS computed_at, value AS composite,
       CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100 END AS confidence_score,
       CASE WHEN event_id % 3 > 0 THEN event_type END AS flag
FROM events
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return ad.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("listing_id"),
        F.col("event_type").alias("model_version"),
        F.col("ts").alias("computed_at"),
        F.col("value").alias("composite"),
        F.when(e % 10 > 0, (e % 100) / 100).alias("confidence_score"),
        F.when(e % 3 > 0, F.array("event_type")).alias("risk_flags"),
        F.when(e % 4 > 0, F.create_map(F.lit("value"), F.col("value"))).alias("components"),
    )


# Payload fetches: one row per event.
FETCHES = """
SELECT event_type AS source_slug, CAST(user_id AS VARCHAR) AS source_listing_id, ts AS fetched_at,
       sha256(props) AS content_hash, event_id
FROM events
"""


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_slug"),
        F.col("user_id").cast("string").alias("source_listing_id"),
        F.col("ts").alias("fetched_at"),
        F.sha2("props", 256).alias("content_hash"),
        "event_id",
    )


# Engines round decimal ties differently, and a price per area often is one; both sides move off
# the tie by the same small amount before rounding.
SHIFT = 1.3e-7


def r(expr: str, places: int = 4) -> str:
    return f"round({expr} + {SHIFT}, {places})"


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double so that both engines print the same digits."""
    return df.select(
        *[
            F.round(F.col(n) + SHIFT, places).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )

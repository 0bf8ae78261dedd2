"""Data-quality rollups and health alarms (spec-only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def field_completeness(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows with each field present and not blank, in one aggregate."""
    share = lambda c: F.avg(
        F.when(F.trim(F.col(c).cast("string")) != "", 1.0).otherwise(0.0)
    )
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[share(c).alias(f"{c}_share") for c in fields]
    )


def ingest_quality(parsed: DataFrame, keys: Sequence[str] = ("source_slug",)) -> DataFrame:
    """Parse outcome, location precision and duplicate counts per feed."""
    have = set(parsed.columns)
    count = lambda c, v: (
        F.count_if(F.col(c) == v) if c in have else F.lit(None).cast("bigint")
    )
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count("parse_status", "ok").alias("parsed_ok"),
        count("parse_status", "quarantine").alias("parsed_quarantine"),
        count("precision", "rooftop").alias("geocoded_rooftop"),
        count("precision", "street").alias("geocoded_street"),
        count("precision", "locality").alias("geocoded_locality"),
        (F.count_if(F.col("duplicate")) if "duplicate" in have else F.lit(None).cast("bigint"))
        .alias("deduped"),
    )


def drop_alarms(daily: DataFrame, keys: Sequence[str], day: str, metric: str, max_drop: float,
                days: int = 7) -> DataFrame:
    """Days on which ``metric`` fell by more than ``max_drop`` against the mean of the previous
    days. ``daily`` has one row per key and day, so a key's window holds days, not events."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-days, -1)
    base: Column = F.avg(metric).over(w)
    return (
        daily.withColumn("baseline", base)
        .withColumn("drop", 1 - F.col(metric) / F.when(F.col("baseline") > 0, F.col("baseline")))
        .where(F.col("drop") > max_drop)
    )

"""Market segments and the relaxation ladder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import scoring as s
from parcelwise.functions.keys import key_id, key_text
from parcelwise.operators import order_stats as os_
from parcelwise.session import materialize

STAT_QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}
TRIM = 0.10


def with_segment(df: DataFrame) -> DataFrame:
    """Add ``segment`` (struct of key parts), ``segment_key`` (exact null-safe text) and
    ``segment_id`` (64-bit id)."""
    c = F.col
    return (
        df.withColumn(
            "segment",
            s.segment_key(
                c("city_district"), c("property_type"), c("disposition"), c("ownership_type"),
                c("building_type"), c("size_m2"), c("condition"),
            ),
        )
        .withColumn("segment_key", segment_text(F.col("segment")))
        .withColumn("segment_id", segment_id(F.col("segment")))
    )


def segment_text(key: Column) -> Column:
    return key_text(*[key.getField(p) for p in s.SEGMENT_PARTS])


def segment_id(key: Column) -> Column:
    return key_id(*[key.getField(p) for p in s.SEGMENT_PARTS])


def segment_stats(
    df: DataFrame, keys: list[str], value: str = "ppm2"
) -> DataFrame:
    """n, median, trimmed mean, quartiles and population deviation of the positive values."""
    usable = df.where((F.col(value) > 0) & (F.col(value) < float("inf")))
    return os_.order_stats(usable, keys, value, STAT_QUANTILES, TRIM)


def with_levels(keys: DataFrame) -> DataFrame:
    """Add ``__levels``: array<struct<level, rkey>> of the six relaxed keys of ``segment``."""
    part = {p: F.col(f"segment.{p}") for p in s.SEGMENT_PARTS}
    wide = s.relax(F.col("segment"), 4)
    staged = keys.select(
        "*",
        wide.getField("size_bucket").alias("__size"),
        wide.getField("condition_bucket").alias("__cond"),
        wide.getField("city_district").alias("__city"),
    )
    forms = []
    for level in range(s.MAX_LEVEL + 1):
        p = dict(part)
        if level >= 1:
            p["size_bucket"] = F.col("__size")
        if level >= 2:
            p["condition_bucket"] = F.col("__cond")
        if level >= 3:
            p["building_type"] = F.lit(None)
        if level >= 4:
            p["city_district"] = F.col("__city")
        if level >= 5:
            p["disposition"] = F.lit(None)
        forms.append(
            F.struct(F.lit(level).alias("level"), key_text(*p.values()).alias("rkey"))
        )
    return staged.withColumn("__levels", F.array(*forms)).drop("__size", "__cond", "__city")


def relaxed_stats(
    listings: DataFrame,
    min_n: int = s.MIN_SAMPLES,
    quantiles: Mapping[str, float] | None = None,
) -> DataFrame:
    """Per base segment: the first ladder level with at least ``min_n`` values and the statistics
    of everything pooled at that level. Unresolved segments keep a row with NULL level.

    Input: the segment columns plus price and size_m2. Raw rows are never multiplied by the six
    levels: value histograms of the base segments are, and they are small. Rows are read a second
    time only for the few buckets whose inner order matters. The narrow (segment, value) rows are
    written once because they are read twice.
    """
    quantiles = dict(quantiles or STAT_QUANTILES)
    rows = materialize(
        with_segment(listings.withColumn("__v", s.ppm2(F.col("price"), F.col("size_m2"))))
        .where(F.col("__v") > 0)
        .select("segment", "segment_key", "__v")
    )
    base = materialize(os_.histogram(rows, ["segment", "segment_key"], "__v"))
    bases = base.select("segment", "segment_key").distinct()
    members = materialize(
        with_levels(bases)
        .select("segment_key", F.explode("__levels").alias("__l"))
        .select("segment_key", "__l.level", "__l.rkey")
    )
    ladder = base.drop("segment").join(members, "segment_key")
    summary = materialize(
        os_.summarise(os_.roll_up(ladder, ["level", "rkey"]), ["level", "rkey"], quantiles, TRIM)
    )
    chosen = (
        members.join(
            summary.where(F.col("n_samples") >= min_n).select("level", "rkey"), ["level", "rkey"]
        )
        .groupBy("segment_key")
        .agg(F.min("level").alias("level"), F.min_by("rkey", "level").alias("rkey"))
    )
    chosen = materialize(chosen)
    wanted = os_.open_buckets(summary).join(
        chosen.select("level", "rkey").distinct(), ["level", "rkey"], "left_semi"
    )
    # (base segment, bucket) -> the pooled groups that need this bucket opened
    routes = ladder.select("segment_key", "level", "rkey", "__b").join(
        wanted, ["level", "rkey", "__b"]
    )
    counted = (
        rows.select("segment_key", "__v", os_.value_bucket(F.col("__v")).alias("__b"))
        .join(routes, ["segment_key", "__b"])
        .groupBy("level", "rkey", "__b", "__v", "__start", *os_.SUMMARY)
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    stats = os_.resolve(counted, ["level", "rkey"], "__v", quantiles, TRIM)
    return (
        bases.join(chosen, "segment_key", "left")
        .join(stats, ["level", "rkey"], "left")
        .select(
            segment_id(F.col("segment")).alias("segment_id"),
            "segment_key",
            "segment",
            F.col("level").alias("relaxation_level"),
            *[c for c in stats.columns if c not in ("level", "rkey")],
        )
    )

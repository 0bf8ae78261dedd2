"""Exact order statistics per group without ever holding a large group in one task.

``percentile`` keeps a group's distinct values in one buffer, so one dominant group decides
the memory and run time of the job. Here a group is first cut into narrow value buckets that
depend on the value alone:

1. count and sum per (group, bucket), combined on the map side;
2. running counts over a group's buckets (a few thousand small rows at most) tell which buckets
   hold the wanted ranks and how many values lie below each of them;
3. only rows of those buckets are read again, collapsed to (group, bucket, value, count) and
   ranked inside their bucket.

The result is exact. The largest unit of work is the set of distinct values in one bucket of one
group, which the bucket width bounds to a relative spread of 1/BUCKETS_PER_E.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS_PER_E = 512

# name -> (column, one of "sum", "min", "max"): further aggregates taken in the same pass
Extra = Mapping[str, tuple[str, str]]
_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def value_bucket(v: Column) -> Column:
    """Monotone bucket number: logarithmic away from zero, linear around it."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_E).cast("int")


def _bucket_anchor(bucket: Column) -> Column:
    x = bucket / float(BUCKETS_PER_E)
    return F.signum(x) * F.expm1(F.abs(x))


def _extras(extra: Extra | None, rolled: bool = False) -> list[Column]:
    return [
        _COMBINE[how](name if rolled else column).alias(name)
        for name, (column, how) in (extra or {}).items()
    ]


def histogram(
    rows: DataFrame, keys: Sequence[str], value: str, extra: Extra | None = None
) -> DataFrame:
    """keys, __b, n, s, d, dd, lo, hi: count, sum and moments around the bucket's anchor."""
    shifted = F.col(value) - _bucket_anchor(F.col("__b"))
    return (
        rows.withColumn("__b", value_bucket(F.col(value)))
        .groupBy(*keys, "__b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("s"),
            F.sum(shifted).alias("d"),
            F.sum(shifted * shifted).alias("dd"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            *_extras(extra),
        )
    )


def roll_up(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up histograms that share coarser keys."""
    return hist.groupBy(*keys, "__b").agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "d", "dd")],
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )


def _ranks(q: float, n: Column) -> tuple[Column, Column]:
    pos = (n - 1) * float(q)
    return F.floor(pos), F.ceil(pos)


def _cut(n: Column, trim: float) -> Column:
    """How many values the symmetric trim drops at each end."""
    cut = F.floor(n * float(trim))
    return F.when(n - 2 * cut > 0, cut).otherwise(0)


def summarise(
    hist: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, float],
    trim: float | None,
    extra: Extra | None = None,
) -> DataFrame:
    """Per group: n, mean, stddev, min, max, the sum of all untouched buckets and the list of
    buckets that must be opened, each with the number of values below it."""
    below = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n, start, total = F.col("n"), F.col("__start"), F.col("__total")
    end = start + n
    holds = F.lit(False)
    for q in quantiles.values():
        for rank in _ranks(q, total):
            holds = holds | ((start <= rank) & (rank < end))
    untouched = F.lit(0.0)
    if trim is not None:
        cut = _cut(total, trim)
        inside = (start >= cut) & (end <= total - cut)
        outside = (end <= cut) | (start >= total - cut)
        holds = holds | ~(inside | outside)
        untouched = F.when(inside & ~F.col("__hold"), F.col("s")).otherwise(0.0)
    anchor = _bucket_anchor(F.col("__b")) - F.col("__mean")
    spread = F.col("dd") + 2 * anchor * F.col("d") + n * anchor * anchor
    return (
        hist.select(
            "*",
            F.coalesce(F.sum("n").over(below), F.lit(0)).alias("__start"),
            F.sum("n").over(whole).alias("__total"),
            (F.sum("s").over(whole) / F.sum("n").over(whole)).alias("__mean"),
        )
        .withColumn("__hold", holds)
        .groupBy(*keys)
        .agg(
            F.first("__total").alias("n_samples"),
            F.first("__mean").alias("mean"),
            F.when(F.min("lo") == F.max("hi"), F.lit(0.0))
            .otherwise(F.sqrt(F.greatest(F.sum(spread), F.lit(0.0)) / F.first("__total")))
            .alias("stddev"),
            F.min("lo").alias("min"),
            F.max("hi").alias("max"),
            F.sum(untouched).alias("__kept"),
            F.collect_list(
                F.when(F.col("__hold"), F.struct(F.col("__b").alias("b"), start.alias("start")))
            ).alias("__open"),
            *_extras(extra, rolled=True),
        )
    )


def open_buckets(summary: DataFrame) -> DataFrame:
    """One row per bucket to open, carrying the group's summary."""
    rest = [c for c in summary.columns if c != "__open"]
    return summary.select(*rest, F.explode("__open").alias("__o")).select(
        *rest, F.col("__o.b").alias("__b"), F.col("__o.start").alias("__start")
    )


SUMMARY = ["n_samples", "mean", "stddev", "min", "max", "__kept"]


def resolve(
    counted: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    trim: float | None,
    extra: Extra | None = None,
) -> DataFrame:
    """Finish from (keys, __b, value, __c) rows of the opened buckets."""
    carried = SUMMARY + list(extra or {})
    inner = (
        Window.partitionBy(*keys, "__b")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    n, v, r0, r1 = F.col("n_samples"), F.col(value), F.col("__r0"), F.col("__r0") + F.col("__c")
    first = F.col("__start") + F.coalesce(F.sum("__c").over(inner), F.lit(0))
    ranked = counted.withColumn("__r0", first)
    aggs = [F.first(c).alias(c) for c in carried]
    for name, q in quantiles.items():
        for side, rank in zip(("lo", "hi"), _ranks(q, n), strict=True):
            hit = F.max(F.when((r0 <= rank) & (rank < r1), v))
            aggs.append(hit.alias(f"__{name}_{side}"))
    if trim is not None:
        cut = _cut(n, trim)
        kept = F.greatest(F.least(r1, n - cut) - F.greatest(r0, cut), F.lit(0))
        aggs.append(F.sum(kept * v).alias("__partial"))
    cols = [F.col(c) for c in [*keys, *carried] if c != "__kept"]
    for name, q in quantiles.items():
        pos = (n - 1) * float(q)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    if trim is not None:
        total = F.col("__kept") + F.col("__partial")
        cols.append((total / (n - 2 * _cut(n, trim))).alias("trimmed_mean"))
    return ranked.groupBy(*keys).agg(*aggs).select(*cols)


def order_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    trim: float | None = None,
    extra: Extra | None = None,
) -> DataFrame:
    """keys, n_samples, mean, stddev (population), min, max, the ``extra`` aggregates, one column
    per quantile (linear interpolation) and, with ``trim``, trimmed_mean.

    Rows with a NULL or NaN value are ignored; NULL keys form a group of their own.
    """
    needed = sorted({c for c, _ in (extra or {}).values()} - set(keys))
    rows = df.select(*keys, *needed, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    summary = summarise(histogram(rows, keys, "__v", extra), keys, quantiles, trim, extra)
    wanted = open_buckets(summary)
    carried = [*SUMMARY, *(extra or {})]
    wanted = wanted.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__b").alias("__kb"),
        "__start",
        *[F.col(c).alias(f"__s_{c}") for c in carried],
    )
    same = F.col("__b") == F.col("__kb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    counted = (
        rows.select(*keys, "__v", value_bucket(F.col("__v")).alias("__b"))
        .join(wanted, same)
        .groupBy(*keys, "__b", "__v", "__start", *[F.col(f"__s_{c}").alias(c) for c in carried])
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    return resolve(counted, keys, "__v", quantiles, trim, extra)


def distributed_rank(
    df: DataFrame, value: str, out: str = "rank", keys: Sequence[str] = ()
) -> DataFrame:
    """Competition rank (1 = largest) over the whole table or per key, without a global sort task:
    the number of larger values is the number in higher buckets plus those in the own bucket."""
    rows = df.withColumn("__b", value_bucket(F.col(value).cast("double")))
    hist = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    above = (
        Window.partitionBy(*(list(keys) or [F.lit(0)]))
        .orderBy(F.desc("__b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    hist = hist.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).drop("__n")
    counted = rows.groupBy(*keys, "__b", value).agg(F.count(F.lit(1)).alias("__c"))
    inner = (
        Window.partitionBy(*keys, "__b")
        .orderBy(F.desc(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        counted.join(hist, [*keys, "__b"])
        .withColumn(out, F.col("__above") + F.coalesce(F.sum("__c").over(inner), F.lit(0)) + 1)
        .select(*keys, "__b", value, out)
    )
    return rows.join(ranks, [*keys, "__b", value]).drop("__b")

"""Places in an order within keys of any size: range partitions, with their edges stitched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.session import materialize


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned by key and order, with its partition in ``_part``; a written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def _meets(keys: Sequence[str]) -> Column:
    """A row's partition and key are those of an edge (``_p``, ``_k0``, ...)."""
    meets = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        meets &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return meets


def _edge(keys: Sequence[str]) -> list[Column]:
    return [F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]]


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with ``columns`` of the row before among its key's rows, NULL for the first.

    ``order`` must be unique within a key. As in :func:`placed` a key may have any number of rows, all of them
    at one time included: a partition's first row of a key takes what the key's partition before ended with.
    """
    rows = ranged(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    ends = rows.groupBy("_part", *keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    # at most one key per partition began before it
    carried = ends.select(*_edge(keys), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carry")).where("_carry IS NOT NULL")
    near = rows.withColumn("_prev", F.lag(F.struct(*columns)).over(inside))
    joined = near.join(F.broadcast(carried), _meets(keys), "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in columns])


def placed(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place (0, 1, ...) among its key's rows in the given order.

    Rows are range-partitioned by key and order, so a key of any size lies in as many partitions as its rows
    need; places are counted inside a partition and moved by what the key has in the partitions before. Only keys
    that cross a partition's edge are moved: at most one row per partition, which is why they may be broadcast.
    Rows that are equal in key and order come in any order. Null keys are keys. The result rests on a written table.
    """
    rows = ranged(df.withColumn("_row", F.monotonically_increasing_id()), keys, [*order, "_row"])
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_row")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .where("_before > 0")
        .select(*_edge(keys), "_before")
    )
    ranked = rows.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    return ranked.join(F.broadcast(edges), _meets(keys), "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)

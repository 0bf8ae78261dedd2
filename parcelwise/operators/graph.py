"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.session import discard, materialize


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component): the smallest vertex reachable over the undirected ``edges`` (a, b).

    Each round takes the smallest label among a vertex and its neighbours, then the label of that
    label, so a chain of length n needs about log n rounds. Labels are written to the shared folder
    every round and the ones before are removed; a lost executor never restarts the loop. Raises if ``max_rounds`` is not enough.
    """
    both = materialize(
        edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
        .union(edges.select(F.col("b"), F.col("a")))
        .where(F.col("v") != F.col("w"))
        .distinct()
    )
    labels = vertices.select("v", F.col("v").alias("l"))
    if both.isEmpty():
        return labels.withColumnRenamed("l", "component")
    touched = both.select("v").distinct()
    lonely = vertices.join(touched, "v", "left_anti").select("v", F.col("v").alias("component"))
    table = materialize(touched.select("v", F.col("v").alias("l")))
    labels = table
    for _ in range(max_rounds):
        around = (
            both.join(labels.select(F.col("v").alias("w"), F.col("l").alias("wl")), "w")
            .groupBy("v")
            .agg(F.min("wl").alias("wl"))
        )
        lowered = labels.join(around, "v").select(
            "v", F.col("l").alias("old"), F.least("l", "wl").alias("l")
        )
        # label of the label; the lookup side has one row per vertex
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        nxt = materialize(
            lowered.join(jump, "l", "left").select(
                "v", "old", F.least("l", F.coalesce("ll", "l")).alias("l")
            )
        )
        changed = nxt.where(F.col("l") != F.col("old")).limit(1).count()
        discard(table)
        table, labels = nxt, nxt.select("v", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component").unionByName(lonely)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... of all words. A source is taken at most
``MAX_EPOCHS`` times over; what a small source cannot take is shared again among the others by weight.
The documents of a source queue in a random order fixed by a hash of their ids. The e-th time round a
document's virtual finish time is the words its source has then sent divided by the source's target.
Documents are taken in order of finish time until the next one would exceed the total budget, which is
the sum of all words.

Running totals of a source never meet in one task: the order key's leading digits cut the queue into
blocks, block totals are summed, and a window runs inside each block. The cut in the global order is
found from totals by range of finish time, narrowed until few copies remain, which alone are put in order.

Defined results: a null text has no words; a document without words is taken zero times; repeated rows
each count; ties in finish time go by source, round, key and size; all arithmetic up to the division is
exact, so reruns agree; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.common import WORD, fresh, row_hash
from parcelwise.session import materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BLOCK_ROWS = 4096
SEED = "mix"
_RANGES = 1024
_FEW = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources fill up in the order of limit over weight, so those held at their limit are a prefix of
    that order; the rest share what is left by weight. Two windows over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = ranked.withColumn(
        "held",
        F.col("most") * F.sum("weight").over(after)
        <= F.col("weight") * (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))),
    )
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("held"), F.col("most")).otherwise(0)).over(everything)
    share = F.sum(F.when(~F.col("held"), F.col("weight")).otherwise(0)).over(everything)
    return held.select(
        "source", "source_size",
        F.when(F.col("held"), F.col("most").cast("double"))
        .otherwise((F.col("weight") * left).cast("double") / share).alias("target"),
    )


def mix(docs: DataFrame, seed: str = SEED, epochs: int = MAX_EPOCHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, row, size, source_size, target, copies, taken) of every document."""
    rows = materialize(
        docs.select(
            "doc_id", "source", row_hash(docs).alias("row"), word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("key"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    per_source = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), epochs))
    total = per_source.agg(F.sum("source_size")).first()[0] or 0
    blocks = 64
    while blocks * block_rows < rows.count() and blocks < 1 << 24:
        blocks *= 4
    # blocks are powers of four up to 2**24, so they cut the six leading digits in order of the key
    block = F.expr(f"CAST(conv(substring(key, 1, 6), 16, 10) AS BIGINT) DIV {(1 << 24) // blocks}")
    by_key = rows.withColumn("block", block)
    sums = by_key.groupBy("source", "block").agg(F.sum("size").alias("words"))
    lead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("words").over(lead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "block").orderBy("key", "size", "row", "rid")
    queued = by_key.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    s, o, t = queued.alias("s"), offsets.alias("o"), per_source.alias("t")
    same = F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.block") == F.col("o.block"))
    timed = materialize(
        s.join(o, same).join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
            "s.doc_id", "s.row", "s.rid", "s.source", "s.key", "s.size", "source_size", "target",
            (F.col("offset") + F.col("upto")).alias("upto"),
        )
    )

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")

    copies = timed.where(F.col("size") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("time", finish(F.col("epoch")))
    low, high, sent = 0.0, None, 0
    high = copies.agg(F.max("time")).first()[0] or 0.0
    high = high * (1 + 1e-9) + 1e-9
    while True:
        # totals by range of finish time in [low, high); the budget runs out in one of the ranges
        within = copies.where((F.col("time") >= low) & (F.col("time") < high))
        step = (high - low) / _RANGES
        part = F.least(F.floor((F.col("time") - low) / step), F.lit(_RANGES - 1))
        found = within.groupBy(part.alias("part")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")
        ).orderBy("part").collect()
        at = None
        for part_row in found:
            if sent + part_row["words"] > total:
                at = part_row
                break
            sent += part_row["words"]
        if at is None:
            edge = timed.sparkSession.createDataFrame([], "rid long, extra long")
            low = high
            break
        low = at["first"]
        if at["n"] <= _FEW or at["first"] == at["last"]:
            ordered = Window.orderBy("time", F.col("source").asc_nulls_last(), "epoch", "key", "size", "row", "rid")
            edge = (
                copies.where(F.col("time").between(at["first"], at["last"]))
                .select("rid", "time", "source", "epoch", "key", "size", "row")
                .withColumn("run", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + sent)
                .where(F.col("run") <= total)
                .groupBy("rid").agg(F.count("*").alias("extra"))
            )
            break
        high = max(at["last"] * (1 + 1e-15), at["last"] + 1e-300)
    sure = sum((F.when(finish(F.lit(e)) < low, 1).otherwise(0) for e in range(epochs)), F.lit(0))
    n = F.when(F.col("size") > 0, sure + F.coalesce("extra", F.lit(0))).otherwise(0).cast("int")
    return timed.join(edge, "rid", "left").select(
        "doc_id", "row", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken."""
    row, n = fresh(docs, "row", "n")
    plan = (
        mix(docs, seed).where(F.col("copies") > 0).groupBy("doc_id", "row")
        .agg((F.sum("copies") / F.count("*")).alias("each"), F.sum("copies").alias("all"), F.count("*").alias("rows"))
        .withColumnsRenamed({"doc_id": "plan_id", "row": "plan_row"})
    )
    left = docs.withColumn(row, row_hash(docs))
    same = left["doc_id"].eqNullSafe(plan["plan_id"]) & (left[row] == plan["plan_row"])
    times = F.explode(F.sequence(F.lit(1), F.ceil("each").cast("int"))).alias(n)
    return left.join(plan, same).select(*[left[c] for c in docs.columns], times).drop(n)

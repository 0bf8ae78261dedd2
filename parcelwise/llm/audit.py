"""Conversation structure repair by a persistent audit DP (operator 11).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Every row is kept (K), given the role
that fits (R) or deleted (D), and empty turns are inserted (I); an *audit* is the edits' initials in order, and of
the cheapest audits the least in ASCII order counts. What has been read so far is one of four states: nothing, a
system turn, a user turn, an assistant turn.

*The DP.* A row maps a state to states at a cost; inserts before the row belong to it, so each of its segments ends in the
row's own edit and none is a prefix of another. A prefix of edits is a node that shares its parent, knows its ancestors
1, 2, 4, ... back and a rolling hash of its whole prefix. Where two prefixes reach a state at equal cost, the longest
common prefix is searched over these ancestors by hash; equal hashes are verified by the nodes themselves, which are
unique per row and state. The segments after it decide, and they stay decisive whatever follows.

*Long conversations.* Rows are placed in their order by range partitions and cut into chunks of ``CHUNK``. A chunk's
summary (cost and rank of its least prefix from each state to each state) has the same form as a row's, so chunks of
chunks are folded by the same DP until a conversation is one; then the states are handed down and every chunk names its
rows' edits. No task holds a conversation. Only ``digest``, whose SHA-256 is sequential by definition, reads a
conversation's repaired rows in one task, one after another.

Rows: null roles and texts are one space, so the text is blank and the role fits nowhere; a null turn sorts first;
null conversation ids are one conversation. Rows of a turn order by role and the text's hash; equal rows are
interchangeable, and all but the first are duplicates. Very long texts are only hashed and trimmed. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.operators.ordered import placed
from parcelwise.session import materialize

CHUNK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK_CHARS = " \t\n\x0b\f\r"
NONE = -1
_PRIME, _BASE = (1 << 61) - 1, 1_000_003

#: States: 0 nothing, 1 system, 2 user, 3 assistant; the state after an inserted or re-roled turn.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Inserts that end a conversation, by state.
CLOSING = ("", "II", "I", "")

Segment = tuple[int, str]  # cost, edits
Moves = dict[int, dict[int, tuple[int, int]]]  # from state: to state: (cost, rank of the segment among those from there)


@cache
def segments(fault: str, initial: str) -> dict[int, dict[int, Segment]]:
    """From state, to state: the cheapest, then least, segment of a row."""
    out: dict[int, dict[int, Segment]] = {}
    for s in range(4):
        best: dict[int, Segment] = {}

        def offer(t: int, cost: int, edits: str, best: dict[int, Segment] = best) -> None:
            best[t] = min(best.get(t, (cost, edits)), (cost, edits))

        at = s
        for n in range(3):
            cost, edits = n * INSERT, "I" * n
            offer(at, cost + DELETE, edits + "D")
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                offer(NEXT[at], cost + REROLE + more, edits + "R")
                if initial == "s" and at == 0:
                    offer(1, cost + KEEP + more, edits + "K")
                elif ROLE[NEXT[at]][0] == initial:
                    offer(NEXT[at], cost + KEEP + more, edits + "K")
            at = NEXT[at]
        out[s] = best
    return out


@cache
def row_moves(fault: str, initial: str) -> Moves:
    return {s: ranked(to) for s, to in segments(fault, initial).items()}


def ranked(to: dict[int, Segment]) -> dict[int, tuple[int, int]]:
    order = sorted(to, key=lambda t: to[t][1])
    return {t: (to[t][0], order.index(t)) for t in to}


class Prefixes:
    """Nodes of shared edit prefixes, all from one state; a node is one number."""

    def __init__(self, state: int):
        self.state, self.rank, self.hash, self.up = [state], [0], [0], [[]]

    def add(self, parent: int, state: int, rank: int) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.state.append(state)
        self.rank.append(rank)
        self.hash.append((self.hash[parent] * _BASE + 1 + 4 * self.state[parent] + state) % _PRIME)
        self.up.append(up)
        return len(self.up) - 1

    def same(self, a: int, b: int) -> bool:
        """Equal prefixes: by hash, verified by identity, since a prefix has one node."""
        return self.hash[a] == self.hash[b] and a == b

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the edits of ``a`` are below, equal to or above those of ``b``, both of one depth."""
        if self.same(a, b):
            return 0
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return -1 if self.rank[a] < self.rank[b] else 1


def fold(items: list[Moves], state: int) -> tuple[Prefixes, dict[int, tuple[int, int]]]:
    """(the nodes, per end state the cost and node of its cheapest, then least, prefix)."""
    nodes = Prefixes(state)
    live = {state: (0, 0)}
    for moves in items:
        best: dict[int, tuple[int, int, int]] = {}
        for s, (cost, node) in live.items():
            for t, (more, rank) in moves.get(s, {}).items():
                new, old = (cost + more, node, rank), best.get(t)
                if old is None or new[0] < old[0] or (new[0] == old[0] and nodes.compare(node, old[1]) < 0):
                    best[t] = new
        live = {t: (cost, nodes.add(node, t, rank)) for t, (cost, node, rank) in best.items()}
    return nodes, live


def summary(items: list[Moves], first: bool) -> tuple[list[int], list[int]]:
    """(costs, ranks) of the moves of the items together, from state times four plus to state."""
    costs, ranks = [NONE] * 16, [NONE] * 16
    for s in range(1 if first else 4):
        nodes, live = fold(items, s)
        order = sorted(live, key=cmp_to_key(lambda a, b: nodes.compare(live[a][1], live[b][1])))
        for t in live:
            costs[4 * s + t], ranks[4 * s + t] = live[t][0], order.index(t)
    return costs, ranks


def moves_of(costs: list[int], ranks: list[int]) -> Moves:
    return {s: {t: (costs[4 * s + t], ranks[4 * s + t]) for t in range(4) if costs[4 * s + t] != NONE} for s in range(4)}


def states(items: list[Moves], start: int, end: int) -> list[int]:
    """The states between the items, ``start`` and ``end`` included, of the cheapest, then least, edits."""
    nodes, live = fold(items, start)
    node, back = live[end][1], []
    for _ in items:
        back.append(nodes.state[node])
        node = nodes.up[node][0]
    return [start, *reversed(back)]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of neighbouring rows that agree on the first two columns."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:2] != key:
                if rows:
                    yield key, rows
                key, rows = r[:2], []
            rows.append(r)
    if rows:
        yield key, rows


def in_chunks(df: DataFrame, place: str) -> DataFrame:
    """Rows with their chunk; a chunk's rows are neighbours in one partition."""
    return (
        df.withColumn("chunk", F.floor(F.col(place) / CHUNK))
        .repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", place)
    )


def summarize(items: DataFrame, level: int) -> DataFrame:
    """(conv, chunk, costs, ranks): one row per chunk of rows, or of chunks (``level`` above 0)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, chunk), rows in runs(batches):
            moves = [(moves_of if level else row_moves)(r[3], r[4]) for r in rows]
            out.append((conv, chunk, *summary(moves, chunk == 0)))
            if len(out) == 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv", "chunk", "costs", "ranks"]
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    place, *facts = ["chunk_", "costs", "ranks"] if level else ["place", "fault", "initial"]
    rows = in_chunks(items.withColumnRenamed("chunk", "chunk_") if level else items, place)
    return rows.select("conv", "chunk", place, *facts).mapInArrow(task, "conv string, chunk long, costs array<long>, ranks array<long>")


def hand_down(items: DataFrame, ends: DataFrame, level: int) -> DataFrame:
    """(conv, place or chunk, start, end, last): the states around each item, from those around its chunk.

    ``ends``: (conv, chunk, start, end, last); ``last`` marks what ends a conversation.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), rows in runs(batches):
            moves = [(moves_of if level else row_moves)(r[3], r[4]) for r in rows]
            start, end, last = rows[0][5:8]
            path = states(moves, start, end)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * n, pa.string()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32()),
                    pa.array([last and i == n - 1 for i in range(n)], pa.bool_()),
                ],
                ["conv", "chunk", "start", "end", "last"],
            )

    place, *facts = ["chunk_", "costs", "ranks"] if level else ["place", "fault", "initial"]
    rows = items.withColumnRenamed("chunk", "chunk_") if level else items
    met = rows.withColumn("chunk", F.floor(F.col(place) / CHUNK)).join(ends, ["conv", "chunk"])
    met = met.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", place)
    return met.select("conv", "chunk", place, *facts, "start", "end", "last").mapInArrow(
        task, "conv string, chunk long, start int, end int, last boolean"
    )


def conv_key(conv_id: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("~"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text, ...) in order, with place, initial and each row's first fault (or '')."""
    marked = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    marked = marked.withColumn("mark", F.sha2("text", 256))
    at = placed(marked, ["conv"], [F.asc_nulls_first("turn"), "role", "mark"])
    again = at.groupBy("conv", "role", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    fault = (
        F.when(F.length(trimmed) == 0, "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return at.join(again, ["conv", "role", "mark"], "left").select(
        "conv", "place", "turn", "role", "text", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault")
    )


def edits(rows: DataFrame) -> DataFrame:
    """(conv, place, cost, edits): every row's share of the audit, an array of (edit, role; null where kept).

    ``rows``: (conv, place, initial, fault), a table that may be read more than once.
    """
    items = rows.select("conv", "place", "fault", "initial")
    levels = [materialize(summarize(items, 0))]
    while not levels[-1].where("chunk > 0").isEmpty():
        levels.append(materialize(summarize(levels[-1], len(levels))))

    options = F.array(*[
        F.when(F.element_at("costs", t + 1) != NONE, F.struct(
            (F.element_at("costs", t + 1) + INSERT * len(CLOSING[t])).alias("cost"),
            F.element_at("ranks", t + 1).alias("rank"), F.lit(t).alias("state"),
        ))
        for t in range(4)
    ])
    best = F.array_min(F.filter(options, lambda x: x.isNotNull()))
    ends = levels[-1].select("conv", "chunk", F.lit(0).alias("start"), best["state"].alias("end"), F.lit(True).alias("last"))
    for level in range(len(levels) - 1, 0, -1):
        ends = materialize(hand_down(levels[level - 1], ends, level))
    told = hand_down(items, ends, 0)
    known = [(f, i, s, t, *seg) for f in ("blank", "duplicate", "truncated", "") for i in ("s", "u", "a", "")
             for s, to in segments(f, i).items() for t, seg in to.items()]
    names = "fault string, known string, start int, end int, cost long, segment string"
    known = rows.sparkSession.createDataFrame(known, names)
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("")
    full = (
        told.withColumnRenamed("chunk", "place").join(items, ["conv", "place"]).withColumn("known", kind)
        .join(F.broadcast(known), ["fault", "known", "start", "end"])
    )
    closing = F.when(F.col("last"), F.element_at(F.array(*map(F.lit, CLOSING)), F.col("end") + 1)).otherwise("")
    letters = F.concat("segment", closing)
    # an edit's state is the row's last one before it, moved by the turns that the segment has put out so far
    put = lambda i: F.length(F.replace(F.substring(letters, F.lit(1), i + 1), F.lit("D"), F.lit("")))
    user_first = F.col("start") != 2
    role = lambda i: F.when((put(i) % 2 == 1) == user_first, "user").otherwise("assistant")
    edit = F.transform(F.sequence(F.lit(0), F.length(letters) - 1), lambda i: F.struct(
        F.substring(letters, i + 1, F.lit(1)).alias("edit"),
        F.when(F.substring(letters, i + 1, F.lit(1)).isin("I", "R"), role(i)).alias("role"),
    ))
    # a system turn kept by the row itself shifts the turns after it
    shifted = F.when((F.col("known") == "s") & F.col("segment").endswith("K"), F.transform(edit, lambda e: F.struct(
        e["edit"].alias("edit"),
        F.when(e["role"] == "user", "assistant").when(e["role"] == "assistant", "user").alias("role"),
    ))).otherwise(edit)
    return full.select("conv", "place", (F.col("cost") + INSERT * F.length(closing)).alias("cost"), shifted.alias("edits"))


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, edited): every row with place, initial and fault, and with its cost and edits besides.

    Both have conv (a text that names the conversation, ``conv_key``), place, turn, role and text.
    """
    named = conversations.select(conv_key(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = materialize(faults(named))
    return rows, rows.join(edits(rows), ["conv", "place"])


def repaired(edited: DataFrame) -> DataFrame:
    """(conv, place, step, edit, role, text): the repaired turns, in order of place and step; deleted rows are gone."""
    one = edited.select("conv", "place", "role", "text", F.posexplode("edits").alias("step", "e"))
    return one.where("e.edit <> 'D'").select(
        "conv", "place", "step", "e.edit", F.coalesce("e.role", "role").alias("role"),
        F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )


def digest(edited: DataFrame) -> DataFrame:
    """(conv, cost, audit, repaired_sha256): a conversation's rows pass one after another, never held together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cost, audit, sha, lines = None, 0, [], hashlib.sha256(), 0

        def done() -> pa.RecordBatch:
            row = ([conv], [cost], ["".join(audit)], [sha.hexdigest()])
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                ["conv", "cost", "audit", "repaired_sha256"],
            )

        for batch in batches:
            for key, more, role, text, steps in zip(*(c.to_pylist() for c in batch.columns)):
                if key != conv:
                    if conv is not None:
                        yield done()
                    conv, cost, audit, sha, lines = key, 0, [], hashlib.sha256(), 0
                cost += more
                for e in steps:
                    audit.append(e["edit"])
                    if e["edit"] != "D":
                        line = f"{e['role'] or role}:{'' if e['edit'] == 'I' else text}"
                        sha.update(("\n" * (lines > 0) + line).encode("utf-8", "replace"))
                        lines += 1
        if conv is not None:
            yield done()

    rows = edited.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "cost", "role", "text", "edits")
    return rows.mapInArrow(task, "conv string, cost long, audit string, repaired_sha256 string")


def counts(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal) of every conversation that has rows."""
    here = rows.withColumn("chunk", F.floor(F.col("place") / CHUNK))
    bad = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    inside = Window.partitionBy("conv", "chunk").orderBy("place")
    pairs = here.withColumn("illegal", bad(F.lag("initial").over(inside), F.col("initial")))
    edge = here.where((F.col("place") + 1) % CHUNK == 0).select("conv", (F.col("place") + 1).alias("place"), F.col("initial").alias("i"))
    over = here.where((F.col("place") % CHUNK == 0) & (F.col("place") > 0)).join(edge, ["conv", "place"])
    names = ["blank", "duplicate", "truncated"]
    within = pairs.groupBy("conv").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in names], F.coalesce(F.sum("illegal"), F.lit(0)).alias("illegal"))
    across = over.groupBy("conv").agg(F.sum(bad(F.col("i"), F.col("initial"))).alias("more"))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    return within.join(turns, "conv").join(across, "conv", "left").select(
        "conv", F.col("gaps").cast("long").alias("gaps"), *names, (F.col("illegal") + F.coalesce("more", F.lit(0))).alias("illegal")
    )

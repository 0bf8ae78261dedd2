"""SimHash fingerprints and their exact neighbours by vantage-point trees.

A fingerprint has 64 bits. Two that differ in at most ``radius`` bits differ in at most
``radius // trees`` bits on one of ``trees`` disjoint bit ranges, so one vantage-point tree per range
is searched with that smaller radius. A tree node holds a vantage point and a distance: values within
the distance lie inside, the others outside. Every distinct fingerprint has one home leaf (a shard),
and as a query it goes to each leaf that the triangle bounds cannot exclude. Inside a leaf queries and
residents are compared on all 64 bits, so no pair within the radius is lost and none beyond is linked.

Near duplicates by word shingles (:func:`keep_one`) are decided by their exact similarity; fingerprints only propose pairs.
``WIDE_WORDS`` times 64 majority bits of a text's distinct shingles show a Jaccard similarity as an expected share of
differing bits. At the distances of 0.8 no radius on 64 bits lets a tree exclude anything, so there every one of many
short bit ranges has a tree whose leaves a fingerprint enters without reach, and all pairs of a leaf within the radius (three
standard deviations beyond the expected distance) are candidates. A pair at exactly 0.8 agrees on some range with probability 0.99, a
closer one more often. A text goes only if a text that stays is similar to it, so groups do not chain. Texts that are surely alike
first meet one leader each; whatever is not similar to a leader that stays then meets every candidate (:func:`staying`), so leaders
save comparisons and decide nothing.

The trees' shape is fitted on a bounded sample of distinct fingerprints; every fingerprint is indexed.
Copies of one fingerprint are one row of the search; a leaf hands on a spanning forest of its pairs,
never the pairs themselves, so a dense group costs as many rows as it has members.

Defined results: null and empty texts have fingerprint zero and link like any other; a text under
four words is one shingle; a null ``doc_id`` never names a component unless all its members have none;
repeated rows repeat in the result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.common import fresh, row_hash
from parcelwise.operators.graph import connected_components
from parcelwise.session import discard, free_shuffles, materialize

SHINGLE = 4
RADIUS = 4
TREES = 3
LEAF_ROWS = 2048
SAMPLE = 100_000
WIDE_WORDS = 8
RANGE_WORDS = 4  # trees are grown on the ranges of so many of them
WIDE_RANGE = 10
SEED = 42
_FEW = 1 << 14  # shingles whose bits are unpacked at once


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text, repeats included."""
    parts = text.lower().split()
    n = len(parts) - shingle + 1
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, SEED)], dtype="<u8")
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin = [0, *(gaps[: n - 1] + 1).tolist()]
    end = [*gaps[shingle - 1 :].tolist(), len(joined)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Eight bytes: a bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _FEW):
        part = hashes[i : i + _FEW]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    return int(majority(shingle_hashes(text, shingle)).view("<u8")[0])


def wide_print(hashes: np.ndarray, words: int) -> bytes:
    """``words`` fingerprints of the same shingles under different mixtures of their hashes."""
    more = (tb.mix(hashes ^ np.uint64(0xA0761D6478BD642F * k % 2**64)).astype("<u8") for k in range(1, words))
    return b"".join(majority(h).tobytes() for h in (hashes, *more))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long."""
    key = docs.select("doc_id", row_hash(docs).alias("row"), "text")
    schema = f"doc_id {dict(key.dtypes)['doc_id']}, row long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(
                [fingerprint((t or "").encode(), shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"]
            )

    return key.mapInArrow(run, schema)


@dataclass
class VantageTree:
    """Nodes in arrays; a leaf has ``left`` -1 and its number in ``leaf``."""

    shift: int
    width: int
    point: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, shift: int, width: int, leaf_rows: int, seed: int) -> VantageTree:
        rng = np.random.default_rng(seed)
        nodes: list[list[int]] = []
        leaves = 0
        todo = [((sample >> np.uint64(shift)) & np.uint64((1 << width) - 1), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([0, 0, -1, -1, -1])
            if parent >= 0:
                nodes[parent][2 + side] = me
            split = None
            if len(rows) > leaf_rows:
                for v in rng.choice(rows, 4):
                    far = np.bitwise_count(rows ^ v)
                    counts = np.cumsum(np.bincount(far, minlength=width + 1))
                    bound = int(np.argmin(np.abs(counts - len(rows) / 2)))
                    inside = int(counts[bound])
                    worst = max(inside, len(rows) - inside)
                    if worst < len(rows) and (split is None or worst < split[0]):
                        split = (worst, int(v), bound, far <= bound)
            if split is None:
                nodes[me][4] = leaves
                leaves += 1
                continue
            nodes[me][0], nodes[me][1] = split[1], split[2]
            todo += [(rows[split[3]], me, 0), (rows[~split[3]], me, 1)]
        a = np.array(nodes, dtype=np.int64)
        return cls(shift, width, a[:, 0].astype(np.uint64), a[:, 1], a[:, 2], a[:, 3], a[:, 4])

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that may hold a value within ``radius``; 0 gives the home leaf."""
        values = (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        out_row, out_leaf = [], []
        while len(row):
            done = self.left[node] < 0
            out_row.append(row[done])
            out_leaf.append(self.leaf[node[done]])
            row, node = row[~done], node[~done]
            far = np.bitwise_count(values[row] ^ self.point[node]).astype(np.int64)
            within, beyond = far - radius <= self.bound[node], far + radius > self.bound[node]
            row, node = (
                np.concatenate([row[within], row[beyond]]),
                np.concatenate([self.left[node[within]], self.right[node[beyond]]]),
            )
        return np.concatenate(out_row), np.concatenate(out_leaf)


def bit_ranges(trees: int) -> list[tuple[int, int]]:
    cuts = [64 * i // trees for i in range(trees + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def settle(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of ``a`` and ``b`` in place; ``parent`` stays flat, roots are the smallest members."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def leaf_links(fps: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the pairs within ``radius`` between any row and a home row."""
    nodes, where = np.unique(fps, return_inverse=True)
    at_home = np.zeros(len(nodes), bool)
    at_home[where[home]] = True
    homes = np.flatnonzero(at_home)
    parent = np.arange(len(nodes))
    block = max(1, (1 << 20) // max(1, len(homes)))
    for i in range(0, len(nodes), block):
        near = np.bitwise_count(nodes[i : i + block, None] ^ nodes[homes][None, :]) <= radius
        q, h = np.nonzero(near)
        settle(parent, q + i, homes[h])
    away = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[away], nodes[parent[away]]


def links(fps: DataFrame, radius: int = RADIUS, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
          sample: int = SAMPLE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``fps`` (distinct ``fp``) within ``radius``."""
    spark = fps.sparkSession
    n = fps.count()
    some = fps.orderBy(F.xxhash64("fp", F.lit(7)), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    per_leaf = max(16, leaf_rows * len(some) // max(1, n))
    forest = spark.sparkContext.broadcast([
        VantageTree.fit(some.view(np.uint64), shift, width, per_leaf, seed)
        for seed, (shift, width) in enumerate(bit_ranges(trees))
    ])
    reach = radius // trees

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(forest.value):
                for lo in range(0, len(values), 20_000):
                    part = values[lo : lo + 20_000]
                    own = np.empty(len(part), np.int64)
                    row, leaf = tree.route(part, 0)
                    own[row] = leaf
                    row, leaf = tree.route(part, reach)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf * trees + t), pa.array(part[row].view(np.int64)), pa.array(own[row] == leaf)],
                        ["leaf", "fp", "home"],
                    )

    def search(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        a, b = leaf_links(values, table.column("home").to_numpy(), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = fps.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")
    return routed.groupBy("leaf").applyInArrow(search, "a long, b long")


def components(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component): the component of every distinct ``fp`` of ``keyed``."""
    distinct = materialize(keyed.select("fp").distinct())
    edges = materialize(links(distinct, radius).distinct())
    return connected_components(distinct.select(F.col("fp").alias("v")), edges).withColumnRenamed("v", "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row, fp, component_id): ``component_id`` is the smallest id reachable over links."""
    keyed = materialize(with_fingerprints(docs, shingle))
    of = components(keyed, radius)
    smallest = keyed.groupBy("fp").agg(F.min("doc_id").alias("low")).join(of, "fp")
    named = smallest.groupBy("component").agg(F.min("low").alias("component_id"))
    return keyed.join(of.join(named, "component").select("fp", "component_id", "component"), "fp")


def wide_distance(similarity: float, words: int = WIDE_WORDS, deviations: float = 3.0) -> int:
    """Differing bits expected at a Jaccard similarity, and some standard deviations more or (negative) less."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * words
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of words of ``a`` and of ``b``."""
    far = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        far += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return far


def candidate_pairs(prints: np.ndarray, radius: int, sure: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) rows of a leaf to be compared exactly; ``prints`` has a row of words per text, in order.

    A row within ``sure`` bits of earlier leaders meets the first of them and the first leader within ``radius``. All
    others lead too, and meet every leader within ``radius``; so a group of near copies makes few pairs, and texts that
    are not surely alike make all.
    """
    leaders = np.zeros(0, np.int64)
    later, earlier = [], []

    def meet(q: np.ndarray, h: np.ndarray) -> None:
        later.append(q)
        earlier.append(h)

    for lo in range(0, len(prints), block):
        mine = np.arange(lo, min(lo + block, len(prints)))
        far = _apart(prints[mine], prints[leaders])
        safe = far <= sure
        covered = safe.any(1)
        if covered.any():
            q = mine[covered]
            for near in (safe, far <= radius):
                meet(q, leaders[near[covered].argmax(1)])
        q, h = np.nonzero((far <= radius) & ~covered[:, None])
        meet(mine[q], leaders[h])
        rest = mine[~covered]
        near = _apart(prints[rest], prints[rest])
        lead = np.ones(len(rest), bool)
        for i in np.flatnonzero((near <= radius).sum(1) > 1):
            before = np.flatnonzero(lead[:i] & (near[i, :i] <= radius))
            close = before[near[i, before] <= sure]
            lead[i] = not len(close)
            met = np.unique([close[0], before[0]]) if len(close) else before
            meet(np.full(len(met), rest[i]), rest[met])
        leaders = np.concatenate([leaders, rest[lead]])
    return np.concatenate(later or [leaders]), np.concatenate(earlier or [leaders])


def all_pairs(prints: np.ndarray, fresh: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(later, earlier) rows of a leaf within ``radius`` of which one or both are ``fresh``, block by block."""
    for lo in range(0, len(prints), block):
        hi = min(lo + block, len(prints))
        near = _apart(prints[lo:hi], prints[:hi]) <= radius
        near &= (fresh[lo:hi, None] | fresh[None, :hi]) & (np.arange(hi)[None, :] < np.arange(lo, hi)[:, None])
        q, h = np.nonzero(near)
        yield q + lo, h


def wide_candidates(prints: DataFrame, radius: int, sure: int, words: int = WIDE_WORDS, leaf_rows: int = LEAF_ROWS,
                    sample: int = SAMPLE // 4, range_words: int = RANGE_WORDS) -> DataFrame:
    """(later, low, earlier): keys of ``prints`` (key, low, wide; distinct keys) to be compared, in order of ``low``, null last,
    and key; with the ``low`` of the earlier one. A pair comes from the first leaf that both are in.

    With ``sure`` below zero these are all pairs within ``radius`` that share a leaf; if ``prints`` has a boolean column ``fresh``,
    all of them with a fresh row. Otherwise they are those of :func:`candidate_pairs`.
    """
    spark = prints.sparkSession
    n = prints.count()
    some = prints.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(sample).toPandas()["wide"]
    bits = np.frombuffer(b"".join(some), "<u8").reshape(-1, words)
    per_leaf = max(16, leaf_rows * len(bits) // max(1, n))
    places = [(w, s) for w in range(min(words, range_words)) for s in range(0, 65 - WIDE_RANGE, WIDE_RANGE)]
    values = np.arange(1 << WIDE_RANGE, dtype=np.uint64)
    leaf_of = np.zeros((len(places), len(values)), np.int64)
    for i, (w, s) in enumerate(places):
        row, leaf = VantageTree.fit(bits[:, w], s, WIDE_RANGE, per_leaf, i).route(values << np.uint64(s), 0)
        leaf_of[i, row] = leaf
    tables = spark.sparkContext.broadcast(leaf_of)
    kind = dict(prints.dtypes)["low"]
    some_fresh = "fresh" in prints.columns

    def leaves(wide: np.ndarray, t: int) -> np.ndarray:
        w, s = places[t]
        return tables.value[t, (wide[:, w] >> np.uint64(s)) & np.uint64((1 << WIDE_RANGE) - 1)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, words)
            for t in range(len(places)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves(wide, t) * len(places) + t), *batch.columns], ["leaf", "key", "low", "wide", "fresh"]
                )

    def search(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by([("low", "ascending"), ("key", "ascending")])
        key, low = table.column("key").combine_chunks(), table.column("low").combine_chunks()
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), "<u8").reshape(-1, words)
        if sure < 0:
            found = all_pairs(wide, table.column("fresh").to_numpy(), radius)
        else:
            found = [candidate_pairs(wide, radius, sure)]
        before = [leaves(wide, t) for t in range(group[0].as_py() % len(places))]
        for later, earlier in found:
            for where in before:
                new = where[later] != where[earlier]
                later, earlier = later[new], earlier[new]
            if len(later):
                later, earlier = pa.array(later), pa.array(earlier)
                yield pa.RecordBatch.from_arrays([key.take(later), low.take(earlier), key.take(earlier)], ["later", "low", "earlier"])

    fresh = F.col("fresh") if some_fresh else F.lit(True)
    rows = prints.select("key", "low", "wide", fresh.alias("fresh"))
    into = f"leaf long, key binary, low {kind}, wide binary, fresh boolean"
    routed = rows.mapInArrow(route, into)
    if some_fresh:
        # the leaves are few: at most 1024 for each range
        met = rows.where("fresh").mapInArrow(route, into).select("leaf").distinct()
        routed = routed.join(F.broadcast(met), "leaf", "left_semi")
    return routed.groupBy("leaf").applyInArrow(search, f"later binary, low {kind}, earlier binary").distinct()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (later, earlier) whose sets (key, shingles) have a Jaccard similarity of at least ``similarity``."""
    one, two = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("later", "earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.join(one, "later").join(two, "earlier").select("later", "earlier", "later_set", "earlier_set").mapInArrow(
        run, "later binary, earlier binary"
    )


def left_out(links: DataFrame) -> DataFrame:
    """(key): what goes where, in order, a text goes if an earlier one that stays is linked to it."""
    open_, gone = materialize(links), []
    while not open_.isEmpty():
        later = open_.select(F.col("later").alias("key")).distinct()
        stay = materialize(open_.select(F.col("earlier").alias("key")).distinct().join(later, "key", "left_anti"))
        new = materialize(
            open_.join(stay.withColumnRenamed("key", "earlier"), "earlier", "left_semi").select(F.col("later").alias("key")).distinct()
        )
        gone.append(new)
        for c in ("later", "earlier"):
            open_ = open_.join(new.withColumnRenamed("key", c), c, "left_anti")
        open_ = materialize(open_)
    out = links.select(F.col("later").alias("key")).limit(0)
    for some in gone:
        out = out.union(some)
    return out


def _contents(texts: DataFrame, shingle: int, words: int) -> DataFrame:
    """(key, low, row, wide): the distinct shingle sets of ``texts`` (doc_id, row, text), each with its first document."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t or "").encode("utf-8", "replace"), shingle) for t in batch.column(2).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
            wide = [wide_print(s, words) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "row", "key", "wide"]
            )

    keyed = texts.mapInArrow(run, f"doc_id {kind}, row long, key binary, wide binary")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return materialize(keyed.groupBy("key").agg(F.min(first).alias("f"), F.first("wide").alias("wide")).select(
        "key", F.col("f.doc_id").alias("low"), F.col("f.row").alias("row"), "wide"
    ))


def _compared(pairs: DataFrame, texts: DataFrame, contents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The similar ones of ``pairs`` (later, earlier: keys of ``contents``)."""
    pairs = pairs.select("later", "earlier")
    met = pairs.select(F.col("later").alias("key")).union(pairs.select("earlier")).distinct()
    wanted = contents.join(met, "key", "left_semi").select("key", F.col("low").alias("low_"), F.col("row").alias("row_"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["low_"]) & (texts["row"] == wanted["row_"]))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set((t or "").encode("utf-8", "replace"), shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    sets = materialize(found.dropDuplicates(["key"]).select("key", "text").mapInArrow(take, "key binary, shingles binary"))
    links = materialize(similar(pairs, sets, similarity))
    discard(sets)
    return links


def staying(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = WIDE_WORDS) -> DataFrame:
    """(key, low, row): the contents of ``texts`` (doc_id, row, text) that are not similar to an earlier one that stays.

    First a text meets one leader that it is surely alike. What a leader does not take then meets all candidates. Texts whose
    leader turns out not to stay come back and meet all candidates as well, until every text that is gone has a link to one that
    stays. The smallest text decided wrongly would be one of those that come back, so each round settles at least that one.
    """
    spark = texts.sparkSession
    contents = _contents(texts, shingle, words)
    radius, sure = (wide_distance(similarity, words, d) for d in (3.0, -1.5))
    led = wide_candidates(contents, sure, sure, words, range_words=RANGE_WORDS // 2)
    at = F.struct(F.col("low").isNull().alias("none"), "low", F.col("earlier").alias("key"))
    pairs = materialize(led.groupBy("later").agg(F.min(at).alias("at")).select("later", F.col("at.key").alias("earlier")))
    links = _compared(pairs, texts, contents, shingle, similarity)
    open_ = materialize(contents.join(left_out(links), "key", "left_anti").withColumn("fresh", F.lit(True)))
    first = True
    while True:
        del led, pairs
        free_shuffles(spark)
        led = wide_candidates(open_.drop("fresh") if first else open_, radius, -1, words)
        pairs = materialize(led)
        new = _compared(pairs, texts, contents, shingle, similarity)
        stay = materialize(open_.drop("fresh").join(left_out(new), "key", "left_anti"))
        links = links.union(new)
        kept = links.join(stay.select(F.col("key").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("key"))
        back = materialize(contents.join(stay, "key", "left_anti").join(kept, "key", "left_anti"))
        if back.isEmpty():
            return stay.drop("wide")
        open_ = materialize(stay.withColumn("fresh", F.lit(False)).unionByName(back.withColumn("fresh", F.lit(True))))
        first = False


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those that are similar to one with a smaller id that stays; of equal rows one stays."""
    (row,) = fresh(docs, "row")
    stays = staying(docs.select("doc_id", row_hash(docs).alias("row"), "text"), shingle, similarity)
    stays = stays.select(F.col("low").alias("stay_id"), F.col("row").alias("stay_row"))
    left = docs.withColumn(row, row_hash(docs))
    same = left["doc_id"].eqNullSafe(stays["stay_id"]) & (left[row] == stays["stay_row"])
    return left.join(stays, same, "left_semi").dropDuplicates(["doc_id", row]).drop(row)

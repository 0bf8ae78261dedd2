"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes with at most e edits still shares m + 1 - q - q * e of its q-grams with the
original, and all on diagonals (text position minus item position) within e of each other. Documents
are read once per block of benchmark items:

1. which text positions carry a q-gram of the block (exact 8-byte codes), and where such positions are
   dense enough for some item's bound (prefix sums over small cells, so nothing that meets the bound
   is missed);
2. there, shared q-grams are counted by item in overlapping diagonal bands, and bands that reach the
   item's bound are retained;
3. a banded alignment of the item against the retained region decides, and gives the edits and the span.

Letters are compared in lower case (A-Z), and every run of other ASCII characters counts as one space.
Items shorter than ``WORDS_ITEM`` bytes in that form must occur unchanged and between word borders; those shorter than
``MIN_ITEM`` are left out, as they would mark ordinary text. The
benchmark is taken in blocks of ``BLOCK_BYTES``, so the index in a task is bounded however large it is.

Defined results: null and empty texts and items match nothing; repeated documents are reported
each; of an item's occurrences in a document the one with fewest edits, then the first, is reported;
equal items are reported each under its own id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parcelwise.llm import textbytes as tb

Q = 8
EDIT_RATE = 0.05
MIN_ITEM = 12
WORDS_ITEM = 24
BLOCK_BYTES = 4_000_000
_CELL = 16
_SHIFT = 1 << 24  # keeps diagonals positive; above any item's length
_SLOTS = 1 << 21
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def plain(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, their offsets by row, place of each kept byte in ``buf``)."""
    out = _PLAIN[buf]
    blank = out == 32
    again = np.zeros(len(out) + 1, bool)
    again[1:-1] = blank[:-1]
    again[off] = False
    keep = np.flatnonzero(~(blank & again[:-1]))
    return out[keep], np.searchsorted(keep, off), keep


def codes(text: np.ndarray) -> np.ndarray:
    """The q-gram at every position as one integer (empty if the text is too short)."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    x = text.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    return x


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)


def budget(m: int, rate: float) -> int:
    """Edits allowed in an item of m bytes, at most as many as the lemma can still see."""
    return min(int(rate * m), (m - Q) // Q)


@dataclass
class Index:
    ids: list
    texts: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    classes: list[tuple[int, int]]

    @classmethod
    def build(cls, rows: list[tuple], rate: float = EDIT_RATE) -> Index | None:
        ids, texts = [], []
        for key, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            folded = plain(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if len(folded) >= MIN_ITEM:
                ids.append(key)
                texts.append(np.frombuffer(folded, np.uint8))
        if not ids:
            return None
        sizes = np.array([len(t) for t in texts])
        edits = np.array([budget(m, rate) if m >= WORDS_ITEM else 0 for m in sizes])
        need = sizes + 1 - Q - Q * edits
        grams = [codes(t) for t in texts]
        code = np.concatenate(grams)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(code, kind="stable")
        keys, first = np.unique(code[order], return_index=True)
        slots = np.zeros(_SLOTS, bool)
        slots[_slot(keys)] = True
        # items of about the same size share one density test, with the longest reach and least need
        step = np.floor(np.log(sizes) / np.log(1.15)).astype(int)
        classes = [
            (int((sizes + edits)[step == k].max()), int(need[step == k].min())) for k in np.unique(step)
        ]
        return cls(ids, texts, edits, need, keys, np.append(first, len(code)), item[order], place[order], slots, classes)


def dense(hit: np.ndarray, classes: list[tuple[int, int]]) -> np.ndarray:
    """Positions inside some window that has enough hits for one of the classes, in whole cells."""
    cells = -(-len(hit) // _CELL)
    padded = np.zeros(cells * _CELL, np.uint8)
    padded[: len(hit)] = hit
    bits = np.packbits(padded).view(np.uint16)
    sums = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    mark = np.zeros(cells + 1, np.int64)
    for reach, need in classes:
        span = -(-reach // _CELL) + 1
        if cells <= span:
            full = np.zeros(int(sums[cells] >= need), np.int64)
        else:
            full = np.flatnonzero(sums[span:] - sums[: cells + 1 - span] >= need)
        if len(full):
            mark[full] += 1
            end = np.minimum(full + span, cells)
            mark[end] -= 1  # ends are as distinct as starts
    return np.repeat(np.cumsum(mark[:-1]) > 0, _CELL)[: len(hit)]


def align(item: np.ndarray, region: np.ndarray, low: int, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best alignment of all of ``item`` to a part of ``region``.

    Only cells on diagonals ``low`` .. ``low + width`` (region position minus item position) are visited;
    leading and trailing region bytes are free. Row by row over the item, vectorised over the band.
    """
    m, n = len(item), len(region)
    far = m + n + 1
    lane = np.arange(width + 1)
    at = low + lane
    ok = (at >= 0) & (at <= n)
    cost = np.where(ok, 0, far)
    start = at.copy()
    padded = np.append(region, 0)
    for i in range(1, m + 1):
        at = low + i + lane
        ok = (at >= 0) & (at <= n)
        same = (at >= 1) & (at <= n) & (padded[np.clip(at - 1, 0, n)] == item[i - 1])
        through = np.where(at >= 1, cost + ~same, far)
        down = np.append(cost[1:] + 1, far)
        best = np.where(ok, np.minimum(through, down), far)
        origin = np.where(through <= down, start, np.append(start[1:], 0))
        # inserted region bytes: a running minimum of cost minus lane
        lead = np.minimum.accumulate(best - lane)
        source = np.maximum.accumulate(np.where(best - lane == lead, lane, 0))
        cost = np.where(ok, lead + lane, far)
        start = origin[source]
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), int(low + m + k)


def matches(text: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) in one folded text, the best of each item."""
    code = codes(text)
    if not len(code):
        return []
    return _retained(text, code, index.slots[_slot(code)], index)


def _retained(text: np.ndarray, code: np.ndarray, hit: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    near = np.flatnonzero(hit & dense(hit, index.classes))
    if not len(near):
        return []
    at = np.minimum(np.searchsorted(index.keys, code[near]), len(index.keys) - 1)
    true = index.keys[at] == code[near]
    near, at = near[true], at[true]
    count = index.first[at + 1] - index.first[at]
    pick = np.repeat(index.first[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    item, place = index.item[pick], index.place[pick]
    diagonal = np.repeat(near, count) - place + _SHIFT
    e = index.edits[item]
    step = e + 1
    band = diagonal // step
    twice = diagonal % step < e
    item, place = np.concatenate([item, item[twice]]), np.concatenate([place, place[twice]])
    band = np.concatenate([band, band[twice] - 1])
    pair, slot = np.unique(band * len(index.texts) + item, return_inverse=True)
    longest = 1 + int(place.max(initial=0))
    shared = np.bincount(np.unique(slot * longest + place) // longest, minlength=len(pair))
    enough = shared >= index.need[pair % len(index.texts)]
    best: dict[int, tuple[int, int, int]] = {}
    for b, k in zip(*(x.tolist() for x in divmod(pair[enough], len(index.texts))), strict=True):
        e = int(index.edits[k])
        low = b * (e + 1) - _SHIFT
        width = 2 * e
        pattern = index.texts[k]
        begin = max(0, low - e)
        region = text[begin : max(begin, low + width + len(pattern) + e)]
        there = _place(pattern, text, begin, begin + len(region))
        if there >= 0:
            found = (0, there, there + len(pattern))
        elif len(pattern) < WORDS_ITEM:
            continue
        else:
            edits, s, t = align(pattern, region, low - begin - e, width + 2 * e)
            found = (edits, begin + s, begin + t)
        if found[0] <= e and (k not in best or found < best[k]):
            best[k] = found
    return [(k, *v) for k, v in sorted(best.items())]


def _place(pattern: np.ndarray, text: np.ndarray, begin: int, end: int) -> int:
    """Where an item occurs unchanged in a part of a text, a short one between word borders; or -1."""
    whole, wanted = text[max(0, begin - 1) : end + 1].tobytes(), pattern.tobytes()
    lead = begin - max(0, begin - 1)
    at = whole.find(wanted, lead, lead + end - begin)
    while at >= 0 and len(pattern) < WORDS_ITEM:
        after = at + len(wanted)
        if (at == 0 or whole[at - 1] == 32) and (after == len(whole) or whole[after] == 32):
            break
        at = whole.find(wanted, at + 1, lead + end - begin)
    return begin + at - lead if at >= 0 else -1


def scan(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end): spans in bytes of the original UTF-8 text."""
    for lo, _, buf, off in tb.slices(texts, tb.SLICE // 4):
        text, at, keep = plain(buf, off)
        code = codes(text)
        if not len(code):
            continue
        hit = index.slots[_slot(code)]
        row = np.searchsorted(at, np.flatnonzero(dense(hit, index.classes)), "right") - 1
        for r in np.unique(row).tolist():
            a, b = int(at[r]), int(at[r + 1])
            if b - a < Q:
                continue
            for k, edits, s, t in _retained(text[a:b], code[a : b - Q + 1], hit[a : b - Q + 1], index):
                yield lo + r, k, edits, int(keep[a + s] - off[r]), int(keep[a + t - 1] + 1 - off[r])


def indexes(benchmark: DataFrame, rate: float, item_id: str = "item_id", text: str = "text") -> Iterator:
    """One broadcast index for each block of items; a block is bounded in bytes and in rows."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for i in range(blocks):
        mine = F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i
        rows = sorted(map(tuple, items.where(mine).collect()), key=repr)
        if index := Index.build(rows, rate):
            yield spark.sparkContext.broadcast(index)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every item found in every document."""
    rows = docs.select("doc_id", "text")
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    doc_kind, item_kind = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, edits int, start long, end long"
    names = ["doc_id", "item_id", "edits", "start", "end"]
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in indexes(benchmark, rate):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(scan(batch.column(1), shared.value))
                if found:
                    row, item, edits, start, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([shared.value.ids[k] for k in item], id_type),
                         pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                        names,
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, all their columns unchanged."""
    at = docs.columns.index("text")
    for shared in indexes(benchmark, rate):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, *_ in scan(batch.column(at), shared.value):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Substring dedup: word windows that occur more than once, found in sharded FM-indexes.

A window of ``WINDOW`` words has a minimizer, the smallest hash among its ``GRAM``-word grams; equal windows have
equal minimizers, so they meet in the shard that the minimizer names. The steps:

1. count minimizers over all documents; one that occurs once belongs to no repeated window;
2. cut every document into runs of windows that share a repeated minimizer; a run's words are its content, and
   equal contents are one entry with a count;
3. in every shard, index the contents (suffix order, wavelet matrix) and stream them through backward search,
   which reports each window that starts at two places or more; contents counted twice need no search;
4. carry the reports back to the runs, and take the covered words out of the texts.

A whole text that occurs more than once is decided by its count and enters the index once. A minimizer that occurs
more than ``HOT`` times would fill one shard, so its windows travel singly and their own words name the shard:
equal windows still meet, and distinct ones spread.

Defined results: null and empty texts have no words, and the digest of the empty text; a text shorter than a window
keeps all its words; repeated rows, with or without equal ids, are copies of each other; a null id is an
id like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.common import discard, keep
from parcelwise.llm.fmindex import Index

WINDOW = 35
GRAM = 5
HOT = 20_000
SHARD_BYTES = 3_000_000
_PLACE = 26  # bits for the place of a word in a slice, below the bits of the hash
_TURN = 0xD6E8FEB86659FD93


def minimizers(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its minimizer, hash of the gram at every place).

    ``hashes`` are word hashes of documents one after the other; windows lie within a document. Of equal
    hashes the leftmost counts, so the choice depends on the window's words only.
    """
    n, grams = len(hashes), window - GRAM + 1
    gram = np.zeros(max(0, n - GRAM + 1), np.uint64)
    for i in range(GRAM):
        gram = gram * np.uint64(_TURN) + hashes[i : i + len(gram)]
    gram = tb.mix(gram)
    start = np.arange(max(0, n - window + 1))
    start = start[doc[start] == doc[start + window - 1]]
    low = (gram >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    if not len(start):
        return start, start, gram
    at = np.minimum(low[start], low[start + grams - width]) & np.uint64((1 << _PLACE) - 1)
    return start, at.astype(np.int64), gram


def _keyed(docs: DataFrame) -> DataFrame:
    """The document with a text key and a row key of two independent hashes each way round."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", text.alias("text"),
        F.xxhash64(text, F.col("doc_id")).alias("k1"), F.xxhash64(F.lit(3), F.col("doc_id"), text).alias("k2"),
    )


def _occurrences(keyed: DataFrame, window: int) -> DataFrame:
    """(k1, place, gram) of every minimizer; ``place`` counts words from the document's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = batch.column(0).to_numpy()
            for lo, _, buf, off in tb.slices(batch.column(1)):
                start, end, doc = tb.words(buf, off)
                _, at, gram = minimizers(tb.span_hashes(buf, start, end), doc, window)
                at = np.unique(at)
                place = at - np.searchsorted(doc, doc[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[lo + doc[at]]), pa.array(place.astype(np.int32)), pa.array(gram[at].view(np.int64))],
                    ["k1", "place", "gram"],
                )

    return keyed.select("k1", "text").mapInArrow(run, "k1 long, place int, gram long")


def _marks(keyed: DataFrame, window: int, hot: int) -> DataFrame:
    """(k1, k2, places, copies, chosen): by document the places of repeated minimizers, twice the place plus
    one if it is hot; for a text that occurs more than once, how often, and which row stands for it.

    ``places`` only says where to look, so there the first key suffices.
    """
    seen, path = keep(_occurrences(keyed, window))
    often = seen.groupBy("gram").count().where("count > 1")
    marked = seen.join(often, "gram").select("k1", (F.col("place") * 2 + (F.col("count") > hot).cast("int")).alias("mark"))
    places = marked.groupBy("k1").agg(F.collect_set("mark").alias("places"))
    slim = keyed.select("k1", "k2", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"))
    same = slim.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2")).alias("first"))
    copied = (
        slim.join(same.where("copies > 1"), ["t1", "t2"])
        .select("k1", "k2", "copies", (F.struct("k1", "k2") == F.col("first")).alias("chosen"))
        .distinct()
    )
    marks, _ = keep(
        slim.select("k1", "k2").distinct().join(places, "k1", "left").join(copied, ["k1", "k2"], "left")
        .where("places IS NOT NULL OR copies IS NOT NULL")
    )
    discard(seen, path)
    return marks


def _content_keys(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    digests = b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in contents)
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _digest(text: bytes, removed: np.ndarray | None = None) -> str:
    parts = text.split()
    return hashlib.sha256(b" ".join(parts if removed is None else compress(parts, (~removed).tolist()))).hexdigest()


def _runs(starts: np.ndarray, at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) indices of runs of consecutive windows with one minimizer; hot windows are single."""
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(at) != 0) | hot[1:]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(starts))


_DONE, _OPEN, _RUN, _CONTENT = range(4)
_PIECE = {
    "kind": pa.int32(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
    "text": pa.binary(), "k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "c1": pa.int64(), "c2": pa.int64(),
    "shard": pa.int64(), "times": pa.int64(),
}
_PIECE_SQL = (
    "kind int, n_words long, n_removed long, kept_sha256 string, text binary, k1 long, k2 long, start int, "
    "c1 long, c2 long, shard long, times long"
)


def _piece(kind: int, ids: pa.Array, n: int, **columns) -> pa.RecordBatch:
    given = columns | {"kind": np.full(n, kind, np.int32)}
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in _PIECE.items())],
        ["doc_id", *_PIECE],
    )


def _cut_slice(ids: pa.Array, k1: np.ndarray, k2: np.ndarray, marks: pa.Array, copies: np.ndarray, chosen: np.ndarray,
               buf: np.ndarray, off: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """The pieces of the documents of one slice."""
    rows = len(k1)
    start, end, doc = tb.words(buf, off)
    first, at, gram = minimizers(tb.span_hashes(buf, start, end), doc, window)
    n = tb.per_row(doc, rows)
    begin = np.cumsum(n) - n
    values = marks.flatten().to_numpy()
    place = np.repeat(begin, marks.value_lengths().fill_null(0).to_numpy()) + values // 2
    repeated, hot = np.zeros(len(doc) + 1, bool), np.zeros(len(doc) + 1, bool)
    repeated[place] = True
    hot[place[values % 2 == 1]] = True
    may = repeated[at]
    first, at = first[may], at[may]
    whole = (copies > 1) & (n >= window)
    touched = np.zeros(rows, bool)
    touched[doc[first]] = True
    closed = whole | ~touched
    raw = [buf[off[i] : off[i + 1]].tobytes() for i in range(rows)]
    pick = np.flatnonzero(closed)
    yield _piece(
        _DONE, ids.take(pa.array(pick)), len(pick), n_words=n[pick], n_removed=np.where(whole, n, 0)[pick],
        kept_sha256=[_digest(b"" if whole[i] else raw[i]) for i in pick],
    )
    pick = np.flatnonzero(~closed)
    yield _piece(_OPEN, ids.take(pa.array(pick)), len(pick), n_words=n[pick], text=[raw[i] for i in pick], k1=k1[pick], k2=k2[pick])
    sends = chosen[doc[first]]
    first, at = first[sends], at[sends]
    if not len(first):
        return
    a, b = _runs(first, at, hot[at])
    w0, w1, at = first[a], first[b - 1] + window, at[a]
    row = doc[w0]
    contents = [b" ".join(buf[i:j].tobytes().split()) for i, j in zip(start[w0].tolist(), end[w1 - 1].tolist(), strict=True)]
    c1, c2 = _content_keys(contents)
    # a whole copy is decided already: its run enters the index as two and nothing is reported back
    own = np.flatnonzero(~whole[row])
    yield _piece(_RUN, pa.nulls(len(own), ids.type), len(own), k1=k1[row[own]], k2=k2[row[own]],
                 start=(w0 - begin[row])[own].astype(np.int32), c1=c1[own], c2=c2[own])
    times: dict[bytes, int] = {}
    for c, k in zip(contents, np.where(whole[row], 2, 1).tolist(), strict=True):
        times[c] = times.get(c, 0) + k
    _, pick = np.unique(c1, return_index=True)
    if len(pick) != len(times):
        last = {c: i for i, c in enumerate(contents)}
        pick = np.array(list(last.values()))
    shard = np.where(hot[at], c1, gram[at].view(np.int64))
    yield _piece(_CONTENT, pa.nulls(len(pick), ids.type), len(pick), c1=c1[pick], c2=c2[pick], shard=shard[pick],
                 text=[contents[i] for i in pick], times=np.array([times[contents[i]] for i in pick]))


def _cut(keyed: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Decide what needs no index, and cut the rest into runs and contents (rows by ``kind``)."""
    kind = dict(keyed.dtypes)["doc_id"]
    joined = keyed.join(marks, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "text", "places", "copies", "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2, text, places, copies, chosen = batch.columns
            copies, chosen = copies.fill_null(1).to_numpy(), chosen.fill_null(True).to_numpy(zero_copy_only=False)
            k1, k2 = k1.to_numpy(), k2.to_numpy()
            for lo, hi, buf, off in tb.slices(text):
                yield from _cut_slice(
                    ids.slice(lo, hi - lo), k1[lo:hi], k2[lo:hi], places.slice(lo, hi - lo), copies[lo:hi],
                    chosen[lo:hi], buf, off, window,
                )

    return joined.mapInArrow(run, f"doc_id {kind}, {_PIECE_SQL}")


def _index_shard(table: pa.Table, window: int) -> pa.Table:
    """(c1, c2, windows): for each content with a repeated window, which of its windows are repeated, as bits."""
    entry: dict[bytes, int] = {}
    which = np.array([entry.setdefault(c, len(entry)) for c in table.column("text").to_pylist()])
    times = np.bincount(which, table.column("times").to_numpy())
    first = np.zeros(len(entry), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    lines = b"\n".join(entry)
    buf = np.frombuffer(lines, np.uint8)
    start, end, _ = tb.words(buf, np.array([0, len(buf)]))
    number = np.unique(tb.span_hashes(buf, start, end), return_inverse=True)[1] + 1
    # a 0 behind each content: words there begin right after a line break
    begin = np.flatnonzero(np.append(True, buf[start[1:] - 1] == 10))
    size = np.diff(np.append(begin, len(start)))
    place = begin + np.arange(len(begin))
    symbols = np.zeros(len(start) + len(begin), np.int64)
    symbols[np.arange(len(start)) + np.repeat(np.arange(len(begin)), size)] = number
    once = times == 1
    found = Index(symbols).repeated(place[once], size[once], window) if once.any() else np.zeros(len(symbols), bool)
    found[np.repeat(place, size) + np.arange(len(start)) - np.repeat(begin, size)] |= np.repeat(~once, size)
    bits = [np.packbits(found[p : p + n - window + 1]).tobytes() for p, n in zip(place.tolist(), size.tolist(), strict=True)]
    told = np.array([any(b) for b in bits], bool)
    keep = first[told]
    return pa.table({
        "c1": table.column("c1").take(pa.array(keep)), "c2": table.column("c2").take(pa.array(keep)),
        "windows": pa.array([b for b, t in zip(bits, told, strict=True) if t], pa.binary()),
    })


def _take_out(text: bytes, starts: list[int], windows: list[bytes], n: int, window: int) -> np.ndarray:
    """Which of the ``n`` words lie in a reported window."""
    edge = np.zeros(n + 1, np.int64)
    for s, bits in zip(starts, windows, strict=True):
        at = s + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    keyed = _keyed(docs)
    pieces, _ = keep(_cut(keyed, _marks(keyed, window, hot), window))
    contents = pieces.where(F.col("kind") == _CONTENT)
    shards = 1 + int(contents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes
    told = (
        contents.select(F.pmod(F.xxhash64("shard"), F.lit(shards)).alias("shard"), "c1", "c2", "times", "text")
        .groupBy("shard")
        .applyInArrow(lambda t: _index_shard(t, window), "c1 long, c2 long, windows binary")
    )
    runs = pieces.where(F.col("kind") == _RUN).select("k1", "k2", "start", "c1", "c2")
    reports = (
        runs.join(told, ["c1", "c2"]).groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "windows")).alias("found"))
        .select("k1", "k2", "found.start", "found.windows")
    )
    still = pieces.where(F.col("kind") == _OPEN).select("doc_id", "k1", "k2", "n_words", "text")
    kind = dict(keyed.dtypes)["doc_id"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, text, start, windows = batch.columns
            removed, kept = [], []
            for k, t, s, w in zip(n.to_pylist(), text, start, windows, strict=True):
                out = _take_out(t.as_py(), s.as_py() or [], w.as_py() or [], k, window)
                removed.append(int(out.sum()))
                kept.append(_digest(t.as_py(), out))
            yield pa.RecordBatch.from_arrays(
                [ids, n, pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    opened = still.join(reports, ["k1", "k2"], "left").select("doc_id", "n_words", "text", "start", "windows")
    done = pieces.where(F.col("kind") == _DONE).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.union(opened.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))

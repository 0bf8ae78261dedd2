"""Ranked lexical search by hashed max-sketches (operator 13).

Terms are runs of letters, digits and bytes above 0x7F, A-Z in lower case. A document's *impact* of a term grows
with the term's count and falls with the document's length; a query's score is the sum of its terms' weights (rarer
in the corpus: higher) times the document's impacts. All of it is integer arithmetic.

1. *Corpus counts.* One scan counts the documents with terms, all terms and, for the terms of the queries, the
   documents that hold them. Tasks add up before anything is shuffled.
2. *Sketches.* A second scan folds each document's impacts, of all its terms, into a sketch: the term's hash names a
   coordinate, and a coordinate keeps the maximum. A sketch has four coordinates or more for each distinct term, so
   its size follows the document's.
3. *Bounds.* A batch of queries reads its terms' coordinates in a batch of sketches; weight times coordinate, summed,
   is never below the exact score, since a coordinate is never below the impact of any term that it stands for.
4. *Rescoring.* Per query, documents are scored exactly in descending order of bound, until the next bound is below
   the k-th best score that the task has found. What tasks found is ranked in Spark.

Queries go out in blocks of at most ``BLOCK_PAIRS`` query terms (or one query); a block is broadcast and takes the two
scans. Terms meet by 64-bit hashes. A text above a slice is cut between terms and counted piece by piece.

Rows: a null text has no terms, as an empty or blank one; such documents do not count and never appear. A query without
terms (null, empty) has no rows. Equal documents rank one after another; equal scores go by ascending doc_id, null
last. Equal query rows count once; rows that share an item_id but differ in text are ranked apart. Empty tables give an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.textbytes import LOWER, SLICE, slices, span_hashes, words

TOP = 20
BLOCK_PAIRS = 200_000
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False
#: Rows share 64 bits with the part of a term's hash that sketches use.
HASH_BITS = 44
PART_ROWS = 1 << 16
LEAST_WIDTH = 64
CELLS = 1 << 21
STEP = 64


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slice itself, or parts of its one long text, cut after bytes that end terms."""
    at = 0
    while len(buf) - at > 2 * SLICE:
        breaks = np.flatnonzero(BREAK[buf[at + SLICE : at + 2 * SLICE]])
        if not len(breaks):  # one term longer than a slice
            rest = np.flatnonzero(BREAK[buf[at + 2 * SLICE :]])
            breaks = rest + SLICE if len(rest) else np.array([len(buf) - at - SLICE - 1])
        end = at + SLICE + int(breaks[0]) + 1
        yield buf[at:end], np.array([0, end - at])
        at = end
    yield buf[at:], off if at == 0 else np.array([0, len(buf) - at])


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


class Terms:
    """The terms of a slice of texts: counts per row, and the counts of those that queries hold.

    ``n``: terms per row; ``found``/``tf``: row * vocabulary + term, ascending, and its count; ``cells``/``cell_tf``:
    row and hash of every distinct term, and its count (terms that share the hash bits are added up, which can only
    raise a bound).
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, vocabulary: np.ndarray, all_terms: bool):
        rows = len(off) - 1
        self.n = np.zeros(rows, np.int64)
        found, tf, cells, cell_tf = [], [], [], []
        for part, bounds in pieces(buf, off):
            part = LOWER[part]
            start, end, row = words(part, bounds, BREAK)
            self.n += np.bincount(row, minlength=rows)[:rows]
            h = span_hashes(part, start, end) if len(start) else np.zeros(0, np.uint64)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            k, c = np.unique(row[hit] * len(vocabulary) + at[hit], return_counts=True)
            found.append(k)
            tf.append(c)
            if all_terms:
                k, c = np.unique((row.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)), return_counts=True)
                cells.append(k)
                cell_tf.append(c)
        self.found, self.tf = added(found, tf)
        if all_terms:
            self.cells, self.cell_tf = added(cells, cell_tf)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, PART_ROWS):
        yield batch.slice(lo, PART_ROWS)


class Queries:
    """A block of queries: ``vocabulary`` holds their terms' hashes, ascending; query i has the pairs from ``start[i]``."""

    def __init__(self, counts: list[Counter]):
        terms = sorted({t for c in counts for t in c})
        buf = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms])
        h = span_hashes(buf, np.concatenate([[0], ends[:-1]]), ends)
        self.vocabulary = np.unique(h)
        place = dict(zip(terms, np.searchsorted(self.vocabulary, h).tolist()))
        self.query = np.array([i for i, c in enumerate(counts) for _ in c])
        self.term = np.array([place[t] for c in counts for t in c])
        self.times = np.array([n for c in counts for n in c.values()], np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Set the pairs' weights and drop the pairs, and so the queries, that no document holds."""
        held = df[self.term] > 0
        self.query, self.term, times = self.query[held], self.term[held], self.times[held]
        self.weight = weight(n_docs, df[self.term]) * times
        self.queries, self.start = np.unique(self.query, return_index=True)


class Sketches:
    """One sketch per row of a slice; widths are powers of two, at least four times the row's distinct terms."""

    def __init__(self, terms: Terms, m: np.ndarray):
        row = (terms.cells >> np.uint64(HASH_BITS)).astype(np.int64)
        distinct = np.bincount(row, minlength=len(m))
        self.width = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(4 * distinct, 1))).astype(np.int64))
        self.base = np.cumsum(self.width) - self.width
        self.cell = np.zeros(int(self.width.sum()), np.int64)
        place = self.base[row] + (terms.cells.astype(np.int64) & (self.width[row] - 1))
        np.maximum.at(self.cell, place, impact(terms.cell_tf, m[row]))

    def bounds(self, queries: Queries) -> np.ndarray:
        """Upper bounds of the scores, rows by queries."""
        out = np.zeros((len(self.width), len(queries.start)), np.int64)
        h = (queries.vocabulary >> np.uint64(64 - HASH_BITS)).astype(np.int64)[queries.term]
        step = max(1, CELLS // len(h))
        for w in np.unique(self.width):
            rows = np.flatnonzero(self.width == w)
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                read = self.cell[self.base[some][:, None] + (h & (w - 1))] * queries.weight
                out[some] = np.add.reduceat(read, queries.start, axis=1)
        return out


class Best:
    """The k best documents of each query that a task has met."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.rescored = queries, k, 0
        ends = np.append(queries.start[1:], len(queries.term))
        self.pairs = [slice(a, b) for a, b in zip(queries.start, ends)]
        self.least = np.ones(len(self.pairs), np.int64)  # a document below this cannot enter
        none = np.zeros(0, np.int64)
        self.kept = [(none, none, none.astype(bool)) for _ in self.pairs]

    def exact(self, terms: Terms, m: np.ndarray, rows: np.ndarray, pairs: slice) -> np.ndarray:
        key = rows[:, None] * len(self.queries.vocabulary) + self.queries.term[pairs]
        at = np.minimum(np.searchsorted(terms.found, key), len(terms.found) - 1)
        tf = np.where(terms.found[at] == key, terms.tf[at], 0)
        self.rescored += len(rows)
        return (self.queries.weight[pairs] * impact(tf, m[rows][:, None])).sum(1)

    def meet(self, terms: Terms, m: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if not len(terms.found):
            return
        bound = Sketches(terms, m).bounds(self.queries)
        for q in np.flatnonzero((bound >= self.least).any(0)):
            b = bound[:, q]
            rows = np.flatnonzero(b >= self.least[q])
            rows = rows[np.lexsort((ids[rows], no_id[rows], -b[rows]))]
            for lo in range(0, len(rows), STEP):
                if b[rows[lo]] < self.least[q]:
                    break
                some = rows[lo : lo + STEP]
                score = self.exact(terms, m, some, self.pairs[q])
                some, score = some[score >= self.least[q]], score[score >= self.least[q]]
                if not len(some):
                    continue
                merged = [np.concatenate(x) for x in zip(self.kept[q], (score, ids[some], no_id[some]))]
                order = np.lexsort((merged[1], merged[2], -merged[0]))[: self.k]
                self.kept[q] = tuple(x[order] for x in merged)
                if len(order) == self.k:
                    self.least[q] = self.kept[q][0][-1]

    def rows(self) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.kept]
        score, ids, no_id = (np.concatenate([x[i] for x in self.kept]) if n else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries.queries, n), pa.int32()), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(score, pa.int64())],
            ["query", "doc_id", "score"],
        )


def read(texts: pa.Array, vocabulary: np.ndarray, all_terms: bool) -> Iterator[tuple[int, int, Terms]]:
    for lo, hi, buf, off in slices(texts):
        yield lo, hi, Terms(buf, off, vocabulary, all_terms)


def corpus_counts(texts: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all terms, documents per vocabulary term); ``texts`` has one column."""
    vocabulary = texts.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        n = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for part in parts(batch):
                for _, _, terms in read(part.column(0), known, False):
                    n[:-2] += np.bincount(terms.found % len(known), minlength=len(known))
                    n[-2:] += (terms.n > 0).sum(), terms.n.sum()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["term", "n"])

    n = np.zeros(len(queries.vocabulary) + 2, np.int64)
    for r in texts.mapInArrow(task, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r.term] = r.n
    vocabulary.unpersist()
    return int(n[-2]), int(n[-1]), n[:-2]


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[Counter]]]:
    """(ids, term counts) of the queries that have terms, in blocks of bounded size."""
    ids, counts, pairs = [], [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).distinct().toLocalIterator():
        c = Counter(TERM.findall((r.t or "").encode("utf-8", "replace").translate(bytes(LOWER))))
        if not c:
            continue
        if ids and pairs + len(c) > BLOCK_PAIRS:
            yield ids, counts
            ids, counts, pairs = [], [], 0
        ids.append(r.i)
        counts.append(c)
        pairs += len(c)
    if ids:
        yield ids, counts


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    id_type = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for ids, counts in blocks(items, item_id, text):
        queries = Queries(counts)
        n_docs, n_terms, df = corpus_counts(rows.select("text"), queries)
        queries.weigh(n_docs, df)
        if not len(queries.start):
            continue
        found = candidates(rows, queries, n_docs, n_terms, k)
        # a first cut over buckets of ids leaves each query a bounded number of rows
        for keys in (["query", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["query"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", id_type)])
        named = spark.createDataFrame(list(enumerate(ids)), names)
        out = out.union(found.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def candidates(rows: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): what each task's documents can add to the best of a query."""
    block = rows.sparkSession.sparkContext.broadcast(queries)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value, k)
        for batch in batches:
            for part in parts(batch):
                ids = part.column(0)
                no_id = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for lo, hi, terms in read(part.column(1), block.value.vocabulary, True):
                    m = 75 + (25 * terms.n * n_docs) // n_terms
                    best.meet(terms, m, ids[lo:hi], no_id[lo:hi])
        yield best.rows()

    return rows.mapInArrow(task, "query int, doc_id long, score long")

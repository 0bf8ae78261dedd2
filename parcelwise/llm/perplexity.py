"""Quality rules with an n-gram perplexity band for each language.

The model is a modified Kneser-Ney model of bytes: a text is its words with one blank between them and an end
symbol, and each symbol is predicted from the ``ORDER - 1`` before it. Spark counts the n-grams of every language
over all documents, derives continuation counts, context totals and the three discounts of each order, and
interpolates order by order with joins. Every counted n-gram is kept. Documents travel in blocks: a block lists its distinct
n-grams, gets their probabilities by a join as arrays sorted by the n-grams' hashes (:class:`KneserNey`), and looks up
its documents' n-grams there, each hit checked against the n-gram itself; so no task loads the model. The words of a block
lie on disk twice, as a kept table and on their way to the n-grams, so they are packed (:func:`packed_words`) before either.

A text's perplexity must lie inside its language's band: ``SPREAD`` times the quartile distance beyond the
quartiles of log-perplexity, taken over all documents of the language long enough for the base rules.

Defined results: null and empty texts have no words and fail the base rule; a null language is a language by
itself; a language without a long enough document has no band and rejects nothing; repeated rows count each;
a line equals an earlier one byte for byte; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.automaton import Words, _unvarints, count_runs, keys, packed_weights, respelled, stream, unpacked
from parcelwise.llm.common import discard, keep
from parcelwise.session import free_shuffles, materialize

ORDER = 5
BLOCK_BYTES = 48_000_000
SPREAD = 3.5
LEAST_WORDS = 50
#: Languages are marked with a sign in front, so that none is apart from an empty one.
NO_LANG = "~"
#: Languages up to which their bands are broadcast.
MOST_BANDS = 10_000
_LENGTH = 56
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by row."""
    rows = len(off) - 1
    start, end, doc = tb.words(buf, off)
    row = np.repeat(np.arange(rows), np.diff(off))
    letter = ~tb.GAP[buf] & tb.utf8_letters(buf)
    repeated = np.zeros(len(doc) + 2, np.int64)
    if len(doc) > 2:
        number = np.unique(tb.span_hashes(buf, start, end), return_inverse=True)[1]
        kinds = int(number.max()) + 1
        pair = np.unique(number[:-1] * kinds + number[1:], return_inverse=True)[1]
        first = np.flatnonzero(doc[:-2] == doc[2:])
        # pairs are fewer than words, so this stays below 2**63 for texts of up to a million million words
        triple = np.unique(pair[first] * kinds + number[first + 2], return_inverse=True)[1]
        _, place, times = np.unique(doc[first] * (len(first) + 1) + triple, return_inverse=True, return_counts=True)
        again = first[times[place] > 1]
        for k in range(3):
            repeated[again + k] = 1
    lines = np.zeros(rows, np.int64)
    for i in range(rows):
        parts = buf[off[i] : off[i + 1]].tobytes().split(b"\n")
        if len(parts) > 1:
            full = [p for p in parts if p.split()]
            lines[i] = len(full) - len(set(full))
    return {
        "n_words": tb.per_row(doc, rows), "word_chars": tb.per_row(row[letter], rows),
        "n_symbols": tb.per_row(row[_SYMBOL[buf]], rows), "n_dup_lines": lines,
        "n_repeat_words": tb.per_row(doc, rows, repeated[: len(doc)]).astype(np.int64),
    }


def _suffix(key: str, length: str) -> str:
    """SQL for the key of the last ``length`` symbols."""
    return f"(({key} & (shiftleft(1L, CAST(8 * ({length}) AS INT)) - 1)) | shiftleft(CAST({length} AS BIGINT), {_LENGTH}))"


#: Words of a block that need one byte, and the first that needs three.
_SHORT = 128
_LONG = _SHORT + (255 - _SHORT) * 256


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(data, asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed_words(numbers: np.ndarray, spelling: bytes) -> tuple[bytes, bytes]:
    """(the words of a block in text order, their spelling), compressed; ``numbers`` tell the words by falling frequency.

    A word that occurs once is code 0 and spelled in text order, so its number takes no room; any other is one more than
    its number. Codes are split into a byte for each and the bytes that rarer ones need. Words of three bytes are spelled in
    byte order, as their frequencies hardly differ.
    """
    words = spelling.split(b" ")[:-1]
    used = np.bincount(numbers, minlength=len(words))
    often = int(np.count_nonzero(used > 1))
    once = numbers[numbers >= often]
    tail = sorted(range(min(_LONG - 1, often), often), key=words.__getitem__)
    code = np.zeros(len(words), np.int64)
    code[:often] = np.arange(1, often + 1)
    code[tail] = np.arange(often - len(tail), often) + 1
    code = code[numbers]
    two, three = code[(code >= _SHORT) & (code < _LONG)] - _SHORT, code[code >= _LONG] - _LONG
    top = np.where(code < _SHORT, code, np.where(code < _LONG, _SHORT + (code - _SHORT >> 8), 255))
    planes = [top, two & 255, *(three >> k & 255 for k in (24, 16, 8, 0))]
    order = [*range(often - len(tail)), *tail, *once.tolist()]
    return (
        _shrunk(len(code).to_bytes(8, "little") + np.concatenate(planes).astype(np.uint8).tobytes()),
        _shrunk(b"".join(words[i] + b" " for i in order)),
    )


def unpacked_words(packed: bytes, spelling: bytes) -> tuple[np.ndarray, bytes]:
    """(numbers of words in text order, the words in order with a blank after each)."""
    data, letters = _grown(packed), _grown(spelling)
    n, data = int.from_bytes(data[:8], "little"), np.frombuffer(data, np.uint8)[8:].astype(np.int64)
    code, rest = data[:n].copy(), data[n:]
    two, three = np.flatnonzero((code >= _SHORT) & (code < 255)), np.flatnonzero(code == 255)
    code[two] = _SHORT + (code[two] - _SHORT << 8) + rest[: len(two)]
    planes = rest[len(two) :].reshape(4, len(three))
    code[three] = _LONG + (planes[0] << 24) + (planes[1] << 16) + (planes[2] << 8) + planes[3]
    once = np.flatnonzero(code == 0)
    code[once] = letters.count(b" ") - len(once) + 1 + np.arange(len(once))
    return code - 1, letters


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ROW = {"block": pa.int64(), "lang": pa.string(), **dict.fromkeys(_COUNTS, pa.int64()), "place": pa.int64(),
        "words": pa.binary(), "spelling": pa.binary(), "key": pa.int64(), "n": pa.int64()}


def _row(ids: pa.Array, block: int, **columns) -> pa.RecordBatch:
    columns["block"] = np.full(len(ids), block)
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(columns[c], t) if c in columns else pa.nulls(len(ids), t) for c, t in _ROW.items())], ["doc_id", *_ROW]
    )


class _Block:
    """Documents with their base counts and words, and the n-grams of each language."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.words = Words()
        self.docs: list[tuple] = []
        self.grams: dict[str, list] = {}

    def add(self, ids: pa.Array, lang: str, buf: np.ndarray, off: np.ndarray) -> None:
        self.words.add(buf, off)
        self.docs.append((ids, lang, base_counts(buf, off)))
        self.grams.setdefault(lang, []).append(count_runs(keys(*stream(buf, off, fold=False), self.order)))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        texts, spelling, _, _ = self.words.close()
        self.words.parts.clear()
        numbers = np.concatenate([_unvarints(np.frombuffer(t.buffers()[2] or b"", np.uint8)) for t in texts])
        words, spelling = packed_words(numbers, spelling)
        del texts, numbers
        place = 0
        for ids, lang, counts in self.docs:
            yield _row(ids, block, lang=[lang] * len(ids), place=np.arange(place, place + len(ids)),
                       **{c: counts[c].astype(np.int64) for c in _COUNTS})
            place += len(ids)
        kind = self.docs[0][0].type
        yield _row(pa.nulls(1, kind), block, words=[words], spelling=[spelling])
        for lang, parts in self.grams.items():
            key, n = count_runs(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            for a in range(0, len(key), 100_000):
                some = slice(a, a + 100_000)
                size = len(key[some])
                yield _row(pa.nulls(size, kind), block, lang=[lang] * size, key=key[some].view(np.int64), n=n[some].astype(np.int64))


def packed(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Blocks of documents: a row by document, one with the words of all of them and one by (language, n-gram)."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(NO_LANG))
    rows = docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, _Block(order)
        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                mine = batch.filter(pa.array(langs == lang))
                for lo, hi, buf, off in tb.slices(mine.column(2)):
                    block.add(mine.column(0).slice(lo, hi - lo), lang, buf, off)
                    if block.words.bytes >= BLOCK_BYTES:
                        yield from block.rows(number)
                        number, block = number + 1, _Block(order)
        yield from block.rows(number)

    told, _ = keep(rows.mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, block long, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, "
        "place long, words binary, spelling binary, key long, n long"
    ))
    return told


def model_table(told: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, str]:
    """(lang, key, k, context, c) of all n-grams of packed documents, (lang, k, n1..n4) for the discounts, and where the first is kept."""
    longest = told.where("key IS NOT NULL").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    length = f"CAST(shiftrightunsigned(key, {_LENGTH}) AS INT)"
    each = longest.select("lang", "key", "n", F.explode(F.sequence(F.lit(1), F.expr(length))).alias("k"))
    grams = each.select("lang", F.expr(_suffix("key", "k")).alias("key"), "n").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    grams, path = keep(grams.withColumn("k", F.expr(length)))
    before = (
        grams.where("k > 1").select("lang", F.expr(_suffix("key", "k - 1")).alias("key")).groupBy("lang", "key")
        .agg(F.count("*").alias("before"))
    )
    # counts of continuations below the top; an n-gram that begins a text has none and keeps its own count
    counted = grams.join(before, ["lang", "key"], "left").select(
        "lang", "key", "k", F.when(F.col("k") == order, F.col("n")).otherwise(F.coalesce("before", "n")).alias("c"),
        F.expr(f"(shiftrightunsigned(key & {(1 << _LENGTH) - 1}L, 8) | shiftleft(CAST(k - 1 AS BIGINT), {_LENGTH}))").alias("context"),
    )
    counted, at = keep(counted)
    discard(counted, path)
    kinds = counted.groupBy("lang", "k").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)])
    return counted, kinds, at


def chances(counted: DataFrame, kinds: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[tuple[DataFrame, str]]]:
    """(lang, key, weight): the natural logarithm of the interpolated probability of every n-gram of two symbols or more;
    and the kept tables that it rests on."""
    y = "CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5D END"
    cuts = kinds.withColumn("y", F.expr(y)).select("lang", "k", F.array(*[
        F.expr(f"least(greatest(CASE WHEN n{i} > 0 THEN {i} - {i + 1} * y * n{i + 1} / n{i} ELSE 0.5D END, 0.05D), {most}D)")
        for i, most in ((1, 0.95), (2, 1.9), (3, 2.85))
    ]).alias("cut"))
    # a row for each order of a language
    cut = counted.join(F.broadcast(cuts), ["lang", "k"]).withColumn("taken", F.expr("element_at(cut, CAST(least(c, 3) AS INT))"))
    totals = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("taken").alias("rest"))
    shares, path = keep(cut.join(totals, ["lang", "context"]).select(
        "lang", "key", "k", F.expr("(c - taken) / total").alias("share"), F.expr("rest / total").alias("rest")
    ))
    lower = shares.where("k = 1").select("lang", F.col("key").alias("short"), F.expr("share + rest / 256").alias("chance"))
    out, levels = [], [(shares, path)]
    for k in range(2, order + 1):
        rows = shares.where(f"k = {k}").withColumn("short", F.expr(_suffix("key", f"{k - 1}")))
        now, level = keep(rows.join(lower, ["lang", "short"]).select("lang", "key", F.expr("share + rest * chance").alias("chance")))
        out.append(now)
        levels.append((now, level))
        lower = now.withColumnRenamed("key", "short")
    table = out[0]
    for more in out[1:]:
        table = table.union(more)
    return table.select("lang", "key", F.log(F.greatest("chance", F.lit(1e-30))).alias("weight")), levels


def _tag(code: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return code | np.asarray(length, np.uint64) << np.uint64(_LENGTH)


def _cut(key: np.ndarray, length: int) -> np.ndarray:
    return _tag(key & np.uint64((1 << 8 * length) - 1), length)


def _context(key: np.ndarray, length: int) -> np.ndarray:
    return _tag((key & np.uint64((1 << _LENGTH) - 1)) >> np.uint64(8), length - 1)


@dataclass
class KneserNey:
    """Natural logarithms in arrays sorted by the hashes of n-grams and of contexts, with what was hashed."""

    gram: np.ndarray
    gram_key: np.ndarray
    weight: np.ndarray
    context: np.ndarray
    context_key: np.ndarray
    backoff: np.ndarray
    unknown: float
    order: int

    @classmethod
    def build(cls, key: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: dict[int, tuple], order: int = ORDER) -> KneserNey:
        length = (key >> np.uint64(_LENGTH)).astype(np.int64)
        share = np.zeros(len(key))
        for k in range(1, order + 1):
            n1, n2, n3, n4 = (float(x) for x in kinds.get(k, (0, 0, 0, 0)))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            cut = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
            cut = np.clip(cut, 0.05, [0.95, 1.9, 2.85])
            rows = length == k
            share[rows] = (c[rows] - cut[np.minimum(c[rows], 3).astype(int) - 1]) / total[rows]
        context = np.concatenate([_context(key[length == k], k) for k in range(1, order + 1)]) if len(key) else key
        order_of = np.concatenate([np.flatnonzero(length == k) for k in range(1, order + 1)]) if len(key) else length
        names, where = np.unique(context, return_inverse=True)
        rest = 1 - np.bincount(where, share[order_of], minlength=len(names))
        left = np.zeros(len(key))
        left[order_of] = rest[where]
        chance = np.zeros(len(key))
        sort = np.argsort(key)
        for k in range(1, order + 1):
            rows = np.flatnonzero(length == k)
            lower = 1 / 256
            if k > 1 and len(rows):
                wanted = _cut(key[rows], k - 1)
                found = sort[np.minimum(np.searchsorted(key, wanted, sorter=sort), len(key) - 1)]
                if not np.array_equal(key[found], wanted):
                    raise ValueError("an n-gram's suffix is missing")
                lower = chance[found]
            chance[rows] = share[rows] + left[rows] * lower
        by_gram, hashed = np.argsort(tb.mix(key)), tb.mix(key)
        by_name, named = np.argsort(tb.mix(names)), tb.mix(names)
        root = rest[0] if len(names) and names[0] == 0 else 1.0
        return cls(hashed[by_gram], key[by_gram], np.log(np.maximum(chance, 1e-30))[by_gram], named[by_name], names[by_name],
                   np.log(np.clip(rest, 1e-12, 1))[by_name], float(np.log(max(root, 1e-12) / 256)), order)

    @classmethod
    def of_block(cls, key: np.ndarray, weight: np.ndarray, order: int = ORDER) -> KneserNey:
        """From the finished values of all the n-grams that will be asked for; any other has no value."""
        hashed = tb.mix(key)
        by_gram, none = np.argsort(hashed), np.zeros(0, np.uint64)
        return cls(hashed[by_gram], key[by_gram], weight[by_gram], none, none, np.zeros(0), float("nan"), order)

    @staticmethod
    def _find(table: np.ndarray, names: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key; equal hashes count only for equal keys."""
        wanted = tb.mix(key)
        at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
        return at, (table[at] == wanted) & (names[at] == key) if len(table) else np.zeros(len(key), bool)

    def log_chances(self, key: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram after the ones before it."""
        out = np.zeros(len(key))
        length = (key >> np.uint64(_LENGTH)).astype(np.int64)
        for k in range(self.order, 0, -1):
            rows = np.flatnonzero(length == k)
            if not len(rows):
                continue
            at, there = self._find(self.gram, self.gram_key, key[rows])
            out[rows[there]] += self.weight[at[there]]
            rows = rows[~there]
            length[rows] = k - 1
            if k == 1:
                out[rows] += self.unknown
            elif len(rows):
                at, there = self._find(self.context, self.context_key, _context(key[rows], k))
                out[rows[there]] += self.backoff[at[there]]
                key = key.copy() if not key.flags.writeable else key
                key[rows] = _cut(key[rows], k - 1)
        return out

    def text_sums(self, spelling: bytes, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, symbols) of texts given as numbers of words."""
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, _, buf, off in respelled(spelling, texts):
            symbols, at = stream(buf, off, fold=False)
            distinct, where = np.unique(keys(symbols, at, self.order), return_inverse=True)
            values = self.log_chances(distinct)
            if np.isnan(values).any():
                raise ValueError("an n-gram of a text has no value")
            sums.append(np.add.reduceat(values[where], at[:-1]))
            sizes.append(np.diff(at))
        return np.concatenate(sums), np.concatenate(sizes)

    def log_perplexity(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        symbols, at = stream(buf, off, fold=False)
        distinct, where = np.unique(keys(symbols, at, self.order), return_inverse=True)
        return -np.add.reduceat(self.log_chances(distinct)[where], at[:-1]) / np.diff(at)


def fit(docs: DataFrame, order: int = ORDER) -> dict[str, KneserNey]:
    """A model by language (None for null) in memory, for few n-grams; :func:`measure` needs none."""
    counted, kinds, _ = model_table(packed(docs, order), order)
    totals = counted.groupBy("lang", "context").agg(F.sum("c").alias("total"))
    got, small = counted.join(totals, ["lang", "context"]).toArrow(), kinds.collect()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    key, c, total = (got.column(x).to_numpy() for x in ("key", "c", "total"))
    return {
        None if lang == NO_LANG else lang[1:]: KneserNey.build(
            key[langs == lang].view(np.uint64), c[langs == lang], total[langs == lang],
            {r["k"]: (r["n1"], r["n2"], r["n3"], r["n4"]) for r in small if r["lang"] == lang}, order,
        )
        for lang in sorted(set(langs))
    }


def measure(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, the base counts, log_perplexity) of every document."""
    told = packed(docs, order)
    counted, kinds, path = model_table(told, order)
    table, levels = chances(counted, kinds, order)
    weights, _ = keep(packed_weights(told.where("key IS NOT NULL").select("block", "lang", "key").join(table, ["lang", "key"])))
    for frame, at in [(counted, path), *levels]:
        discard(frame, at)
    del counted, kinds, table, levels, frame
    free_shuffles(docs.sparkSession)
    names = ["doc_id", "block", "lang", *_COUNTS, "place", "words", "spelling"]
    rows = told.where("key IS NULL").select(names).toDF(*names)  # new columns, as both sides come from one table

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.filter(left.column("spelling").is_valid())
        numbers, spelling = unpacked_words(block.column("words")[0].as_py(), block.column("spelling")[0].as_py())
        left = left.filter(left.column("spelling").is_null()).sort_by("place")
        texts = np.split(numbers, np.cumsum(left.column("n_words").to_numpy())[:-1])
        langs, owners = (np.array(t.column("lang").to_pylist(), dtype=object) for t in (left, right))
        told = np.zeros(left.num_rows)
        for lang in set(langs):
            mine, own = np.flatnonzero(langs == lang), np.flatnonzero(owners == lang)
            key, weight = unpacked(right.column("packed").take(pa.array(own)).to_pylist())
            sums, sizes = KneserNey.of_block(key, weight, order).text_sums(spelling, [texts[i] for i in mine])
            told[mine] = -sums / sizes
        return left.select(["doc_id", "lang", *_COUNTS]).append_column("log_perplexity", pa.array(told))

    blocks = max(1, rows.where("spelling IS NOT NULL").count())
    return rows.repartition(blocks, "block").groupBy("block").cogroup(weights.repartition(blocks, "block").groupBy("block")).applyInArrow(
        score, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, log_perplexity double"
    )


def judge(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The measures with base_failed and kept."""
    measured, _ = keep(measure(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bands = (
        measured.where(~failed).groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"))
        .select("lang", (F.col("q")[0] - spread * (F.col("q")[1] - F.col("q")[0])).alias("low"),
                (F.col("q")[1] + spread * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    )
    # a row per language; names of languages are a small vocabulary, but that is checked
    bands = materialize(bands)
    if bands.count() <= MOST_BANDS:
        bands = F.broadcast(bands)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return measured.join(bands, "lang", "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_perplexity"
    )

"""LM scoring by a weighted backoff automaton over bytes.

A text is its words in lower case (A-Z) with one blank between them and an end symbol; the model predicts
every byte of that from the ``ORDER - 1`` before it, and the end. Contexts are states; a seen continuation is an arc
with a log-probability and a next state; for any other byte a failure arc leads to the context without its
first byte at the price of the context's backoff weight. Each state is the longest known context, so one
left-to-right traversal carries it along. Probabilities are interpolated absolute discounting and sum to one in every state.

Spark counts n-grams over all learnable texts and keeps every one. The arcs are spread over the cluster: the n-grams of all
documents, learned or not, follow their failure arcs level by level in joins, once per n-gram instead of once per
occurrence. A block of documents gets the arcs that its texts use by a join, with the failures' price in their weight, as
an automaton of its own (``BlockAutomaton``), and every text is traversed from left to right with the state carried
along; no task loads the model. ``Automaton`` is the whole model in arrays with failure arcs, for counts that fit into memory.

Words are counted exactly over all learnable texts for the base score. A task numbers the words of a block of text,
hands on (word, slot, learned count) once per block, and gets the corpus counts of its slots back; so words
travel by block, not by token, and no task holds the vocabulary.

Defined results: null and empty texts are the end token alone; with nothing to learn from every byte has the
same probability and the base score is 0; repeated rows are counted and scored each; a null id is in the fold of
the empty text; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.common import discard, fold, keep
from parcelwise.session import free_shuffles

ORDER = 6
DISCOUNT = 0.8
END = 10
BLOCK_BYTES = 12_000_000
_LENGTH = 56  # a key is the n-gram's bytes, the last lowest, with its length above
_STEPS = 1024
_PIECE = 256
_HASH = np.uint64(0x9E3779B97F4A7C15)


def stream(buf: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows one after the other, place of each row's first symbol and the end).

    ``fold`` puts A-Z into lower case."""
    start, end, doc = tb.words(buf, off)
    rows = len(off) - 1
    size = end - start
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    n = tb.per_row(doc, rows)
    length = tb.per_row(doc, rows, size).astype(np.int64) + np.maximum(n, 1)
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.full(at[-1], END, np.uint8)
    # a word moves by as much as what was dropped before it
    goes = np.cumsum(size + 1) - (size + 1) + np.cumsum(n == 0)[doc] if len(doc) else start
    inside = ~tb.GAP[buf]
    out[np.repeat(goes - np.cumsum(size) + size, size) + np.arange(size.sum())] = tb.LOWER[buf[inside]] if fold else buf[inside]
    out[(goes + size)[~last]] = 32
    return out, at


def keys(symbols: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every symbol the n-gram that it ends, as long as the order and the row's start allow."""
    padded = np.concatenate([np.full(order - 1, END, np.uint8), symbols]).astype(np.uint64)
    n = len(symbols)
    code = np.zeros(n, np.uint64)
    for back in range(order):
        code |= padded[order - 1 - back : order - 1 - back + n] << np.uint64(8 * back)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    length = np.minimum(order, place + 2).astype(np.uint64)
    return (code & ((np.uint64(1) << (np.uint64(8) * length)) - np.uint64(1))) | length << np.uint64(_LENGTH)


def count_runs(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often (or with what sum of ``times``) each occurs."""
    if times is None:
        values = np.sort(values)
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        return values[first], np.diff(np.append(first, len(values)))
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(times, first) if len(first) else times


def chances(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, list[tuple[DataFrame, str]]]:
    """(key, weight): log10 of the probability of every n-gram of ``grams`` (key, n learned), of two symbols or more; and
    the kept tables that it rests on."""
    longest = grams.groupBy("key").agg(F.sum("n").alias("n"))
    length = F.shiftrightunsigned("key", _LENGTH).cast("int")
    each = longest.select("key", "n", F.explode(F.sequence(F.lit(1), length)).alias("k"))
    low = f"(key & (shiftleft(1L, CAST(8 * k AS INT)) - 1)) | shiftleft(CAST(k AS BIGINT), {_LENGTH})"
    counted = each.select(F.expr(low).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")).withColumn("k", length)
    context = f"shiftrightunsigned(key & {(1 << _LENGTH) - 1}L, 8) | shiftleft(CAST(k - 1 AS BIGINT), {_LENGTH})"
    counted, path = keep(counted.withColumn("context", F.expr(context)))
    totals = counted.where("k > 1").groupBy("context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kids"))
    # a context that was not learned leaves all to its failure arc
    shares, other = keep(counted.where("k > 1").join(totals, "context").select(
        "key", "k", F.expr(f"CASE WHEN total > 0 THEN greatest(n - {discount}D, 0D) / total ELSE 0D END").alias("share"),
        F.expr(f"CASE WHEN total > 0 THEN 1 - (total - {discount}D * kids) / total ELSE 1D END").alias("rest"),
    ))
    symbols = counted.where("k = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    # symbols at the root get half a count more, so every byte has an arc there
    lower, root = keep(counted.where("k = 1").select(F.col("key").alias("short"), F.expr(f"(n + 0.5D) / ({symbols} + 128)").alias("chance")))
    discard(counted, path)
    out, levels = [], [(lower, root)]
    for k in range(2, order + 1):
        suffix = f"(key & {(1 << 8 * (k - 1)) - 1}L) | {(k - 1) << _LENGTH}L"
        rows = shares.where(f"k = {k}").withColumn("short", F.expr(suffix))
        now, level = keep(rows.join(lower, "short").select("key", F.expr("share + rest * chance").alias("chance")))
        out.append(now)
        levels.append((now, level))
        lower = now.withColumnRenamed("key", "short")
    discard(shares, other)
    table = out[0]
    for more in out[1:]:
        table = table.union(more)
    return table.select("key", F.log10("chance").alias("weight")), levels


@dataclass
class Automaton:
    """Arcs in an open hash table by state and symbol; state 0 is the empty context."""

    slots: np.ndarray  # state * 256 + symbol, or -1
    goal: np.ndarray
    weight: np.ndarray  # log10 of the probability
    backoff: np.ndarray  # log10, by state
    failure: np.ndarray  # by state
    shift: int
    order: int

    @classmethod
    def build(cls, key: np.ndarray, n: np.ndarray, order: int = ORDER, discount: float = DISCOUNT) -> Automaton:
        """From n-gram keys and counts: with an n-gram its prefix and suffix must be there too."""
        sort = np.argsort(key)
        key, n = key[sort], n[sort].astype(np.float64)
        length = (key >> np.uint64(_LENGTH)).astype(np.int64)
        code = key & np.uint64((1 << _LENGTH) - 1)

        def tagged(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            return codes | lengths.astype(np.uint64) << np.uint64(_LENGTH)

        def tail(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            return codes & ((np.uint64(1) << (np.uint64(8) * np.maximum(lengths, 0).astype(np.uint64))) - np.uint64(1))

        contexts = tagged(code >> np.uint64(8), length - 1)
        states = np.unique(np.concatenate([np.zeros(1, np.uint64), contexts]))  # the empty context sorts first
        state = np.searchsorted(states, contexts)
        state_length = (states >> np.uint64(_LENGTH)).astype(np.int64)
        state_code = states & np.uint64((1 << _LENGTH) - 1)
        failure = np.searchsorted(states, tagged(tail(state_code, state_length - 1), np.maximum(state_length - 1, 0)))
        # symbols at the root get half a count more, so every byte has an arc there
        root = length == 1
        counts = np.full(256, 0.5)
        counts[(code[root] & np.uint64(255)).astype(np.int64)] += n[root]
        chance = np.zeros(len(key))
        chance[root] = counts[(code[root] & np.uint64(255)).astype(np.int64)] / counts.sum()
        at = np.searchsorted(key, states[1:])
        total = np.append(1.0, n[at])
        share = np.maximum(n - discount, 0) / total[state]
        left = 1 - np.bincount(state, np.where(root, 0, share), minlength=len(states))
        for k in range(2, order + 1):
            rows = np.flatnonzero(length == k)
            lower = np.searchsorted(key, tagged(tail(code[rows], length[rows] - 1), length[rows] - 1))
            chance[rows] = share[rows] + left[state[rows]] * chance[lower]
        symbol = (code & np.uint64(255)).astype(np.int64)
        # the longest known context after an arc; after the end symbol only the start of a text is known
        keep = np.where(symbol == END, 1, np.minimum(length, order - 1))
        goal = np.full(len(key), -1)
        while True:
            open_ = np.flatnonzero(goal < 0)
            if not len(open_):
                break
            wanted = tagged(tail(code[open_], keep[open_]), keep[open_])
            found = np.minimum(np.searchsorted(states, wanted), len(states) - 1)
            good = states[found] == wanted
            goal[open_[good]] = found[good]
            keep[open_[~good]] -= 1
        rest = np.setdiff1d(np.arange(256), symbol[root])
        arcs = np.concatenate([state[~root] * 256 + symbol[~root], symbol[root], rest])
        goals = np.concatenate([goal[~root], goal[root], np.zeros(len(rest), np.int64)])
        weights = np.log10(np.concatenate([chance[~root], chance[root], counts[rest] / counts.sum()]))
        bits = max(10, int(3 * len(arcs)).bit_length())
        out = cls(
            np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.float32),
            np.log10(np.maximum(left, 1e-12)).astype(np.float32), failure.astype(np.int32), 64 - bits, order,
        )
        slot = out._slot(arcs)
        waiting = np.arange(len(arcs))
        while len(waiting):
            free = out.slots[slot[waiting]] < 0
            mine, first = np.unique(slot[waiting[free]], return_index=True)
            won = waiting[free][first]
            out.slots[mine], out.goal[mine], out.weight[mine] = arcs[won], goals[won], weights[won]
            waiting = np.setdiff1d(waiting, won, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & ((1 << bits) - 1)
        return out

    def _slot(self, arc: np.ndarray) -> np.ndarray:
        return ((arc.astype(np.uint64) * _HASH) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) for each cursor."""
        arc = state.astype(np.int64) * 256 + symbol
        slot = self._slot(arc)
        there = self.slots[slot]
        goal, weight = self.goal[slot], self.weight[slot]
        wrong = np.flatnonzero(there != arc)
        price = np.zeros(len(wrong), np.float32)
        while len(wrong):
            empty = there[wrong] < 0
            lost = wrong[empty]
            price[empty] += self.backoff[state[lost]]
            state[lost] = self.failure[state[lost]]
            arc[lost] = state[lost].astype(np.int64) * 256 + symbol[lost]
            slot[lost] = self._slot(arc[lost])
            on = wrong[~empty]
            slot[on] = (slot[on] + 1) & (len(self.slots) - 1)
            there[wrong] = self.slots[slot[wrong]]
            right = there[wrong] == arc[wrong]
            done = wrong[right]
            goal[done] = self.goal[slot[done]]
            weight[done] = self.weight[slot[done]] + price[right]
            wrong, price = wrong[~right], price[~right]
        return goal, weight

    def walk(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of every symbol of rows one after the other.

        The stream is traversed in pieces side by side. A state depends on the last ``order - 1`` symbols
        only, so a piece that begins that much earlier, at the empty context, arrives in the right state.
        """
        n, lead = len(symbols), self.order - 1
        pieces = max(1, -(-n // _STEPS))
        padded = np.full(lead + pieces * _STEPS, END, np.uint8)
        padded[lead : lead + n] = symbols
        view = np.lib.stride_tricks.as_strided(padded, (lead + _STEPS, pieces), (1, _STEPS), writeable=False)
        out = np.empty((_STEPS, pieces), np.float32)
        state = np.zeros(pieces, np.int32)
        for j in range(lead + _STEPS):
            state, weight = self.step(state, view[j])
            if j >= lead:
                out[j - lead] = weight
        return out.T.ravel()[:n]

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        symbols, at = stream(buf, off)
        return np.add.reduceat(self.walk(symbols).astype(np.float64), at[:-1])


class BlockAutomaton:
    """The arcs that a block's texts use: states are contexts, arcs lie in order of state and symbol.

    A state's symbols are a map of 256 bits with running counts, so the arc of (state, symbol) is found in
    one step; its goal is the context that it leads to, -1 where no text of the block goes on.
    """

    def __init__(self, key: np.ndarray, weight: np.ndarray, order: int = ORDER):
        sort = np.argsort(key)
        key, self.weight = key[sort], weight[sort]
        length = key >> np.uint64(_LENGTH)
        code = key & np.uint64((1 << _LENGTH) - 1)
        context = (code >> np.uint64(8)) | (length - np.uint64(1)) << np.uint64(_LENGTH)
        # contexts come in the order of their n-grams
        self.states, self.first = np.unique(context, return_index=True)
        state = np.repeat(np.arange(len(self.states)), np.diff(np.append(self.first, len(key))))
        self.symbol = (code & np.uint64(255)).astype(np.uint8)
        self.bits = np.zeros((len(self.states), 4), np.uint64)
        np.bitwise_or.at(self.bits, (state, self.symbol >> 6), np.uint64(1) << (self.symbol & 63).astype(np.uint64))
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = self.first[:, None] + np.cumsum(ones, axis=1) - ones
        keep = np.minimum(length, np.uint64(order - 1))
        wanted = (code & ((np.uint64(1) << np.uint64(8) * keep) - np.uint64(1))) | keep << np.uint64(_LENGTH)
        at = np.minimum(np.searchsorted(self.states, wanted), max(len(self.states) - 1, 0))
        self.goal = np.where(self.states[at] == wanted, at, -1) if len(key) else at
        self.order = order

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The summed weights of each row (from ``at[i]`` to ``at[i + 1]``); long rows are walked in pieces side by side,
        each from the state that its place in the row gives."""
        size = np.diff(at)
        pieces = -(-size // _PIECE)
        row = np.repeat(np.arange(len(size)), pieces)
        start = at[row] + _PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        steps = np.minimum(_PIECE, at[row + 1] - start)
        deal = np.argsort(-steps, kind="stable")
        row, start, steps = row[deal], start[deal], steps[deal]
        gram = keys(symbols, at, self.order)[start]
        context = ((gram & np.uint64((1 << _LENGTH) - 1)) >> np.uint64(8)) | ((gram >> np.uint64(_LENGTH)) - np.uint64(1)) << np.uint64(_LENGTH)
        state = np.minimum(np.searchsorted(self.states, context), len(self.states) - 1)
        if not np.array_equal(self.states[state], context):
            raise ValueError("a text's context has no state")
        total = np.zeros(len(row))
        going = np.searchsorted(-steps, -np.arange(_PIECE), "left")  # pieces with more than j steps
        for j in range(int(steps[0]) if len(steps) else 0):
            n = going[j]
            here, sign = state[:n], symbols[start[:n] + j]
            part = sign >> 6
            below = self.bits[here, part] & ((np.uint64(1) << (sign & 63).astype(np.uint64)) - np.uint64(1))
            arc = self.before[here, part] + np.bitwise_count(below)
            if not np.array_equal(self.symbol.take(arc, mode="clip"), sign):
                raise ValueError("an n-gram of a text has no arc")
            total[:n] += self.weight[arc]
            state[:n] = self.goal[arc]
        return np.bincount(row, total, len(size))


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value) in base 128, low digits first, the top bit set on all but the last."""
    width = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(5):
        has = width > k
        out[at[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(width[has] > k + 1, 128, 0)
    return out, width


def _unvarints(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.append(0, last[:-1] + 1) if len(last) else last
    width = last - begin + 1
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = width > k
        out[has] |= (data[begin[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class Words:
    """The words of some documents, to be numbered by frequency and spelled once each."""

    def __init__(self) -> None:
        self.bytes = 0
        self.parts: list[tuple] = []

    def add(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words' hashes, number there of every word, its row, words by row) of the texts."""
        start, end, doc = tb.words(buf, off)
        distinct, first, where = np.unique(tb.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        where, n = where.astype(np.int32), tb.per_row(doc, len(off) - 1)
        self.parts.append((distinct, where, n, *_spelled(buf, start[first], end[first] - start[first])))
        self.bytes += len(buf)
        return distinct, where, doc, n

    def close(self) -> tuple[list[pa.Array], bytes, list[np.ndarray], np.ndarray]:
        """(every part's texts as word numbers, the words in order with a blank after each, the number
        of every part's distinct words, the words' hashes in order)."""
        distinct, first, where = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True, return_inverse=True)
        cuts = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        used = np.zeros(len(distinct), np.int64)
        for p, a, b in zip(self.parts, cuts, cuts[1:], strict=False):
            used[where[a:b]] += np.bincount(p[1], minlength=b - a)
        order = np.argsort(-used, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        letters, size = np.concatenate([p[3] for p in self.parts]), np.concatenate([p[4] for p in self.parts])
        pick = first[order]
        spelling, _ = _spelled(letters, (np.cumsum(size) - size)[pick], size[pick] - 1)
        texts, numbers = [], [number[where[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        for p, mine in zip(self.parts, numbers, strict=True):
            data, width = _varints(mine[p[1]])
            ends = np.concatenate([[0], np.cumsum(p[2])])
            off = np.concatenate([[0], np.cumsum(width)])[ends].astype(np.int64)
            texts.append(pa.Array.from_buffers(pa.large_binary(), len(p[2]), [None, pa.py_buffer(off), pa.py_buffer(data)]).cast(pa.binary()))
        return texts, spelling.tobytes(), numbers, distinct[order]


def _spelled(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the spans' bytes with a blank after each, sizes with the blank)."""
    size = size + 1
    last = np.cumsum(size) - 1
    at = np.repeat(start - (last + 1 - size), size) + np.arange(size.sum())
    at[last] = 0
    out = buf[at] if len(buf) else np.zeros(0, np.uint8)
    out[last] = 32
    return out, size


def respelled(spelling: bytes, texts: list[np.ndarray], limit: int = tb.SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of texts given as numbers of words, about ``limit`` bytes at a time."""
    letters = np.frombuffer(spelling, np.uint8)
    blank = np.flatnonzero(letters == 32)
    start = np.concatenate([[0], blank[:-1] + 1]) if len(blank) else blank
    size = blank - start
    long = np.array([int(size[t].sum()) + len(t) for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(long)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        at = np.concatenate(texts[lo:hi])
        yield lo, hi, _spelled(letters, start[at], size[at])[0], ends[lo : hi + 1] - ends[lo]
        lo = hi


def text_walks(spelling: bytes, texts: list[np.ndarray], model: BlockAutomaton) -> np.ndarray:
    """log10 probability of each text, already in lower case."""
    out = [np.zeros(0)]
    for _, _, buf, off in respelled(spelling, texts, 4 * tb.SLICE):
        out.append(model.walk(*stream(buf, off, fold=False)))
    return np.concatenate(out)


def packed_weights(weights: DataFrame) -> DataFrame:
    """(block, lang, packed): the rows (block, lang, key, weight) as compressed arrays, many rows to one."""

    def flush(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        block, key = table.column("block").to_numpy(), table.column("key").to_numpy()
        code, weight = langs.indices.to_numpy(), table.column("weight").to_numpy().astype("<f4")
        sort = np.lexsort((key, code, block))
        block, code, key, weight = block[sort], code[sort], key[sort], weight[sort]
        first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])))
        out = []
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            steps = np.diff(key[a:b], prepend=0).astype("<i8")
            # equal places of the numbers side by side
            planes = [x.view(np.uint8).reshape(b - a, -1).T.tobytes() for x in (steps, weight[a:b])]
            out.append(int(b - a).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[first]), langs.dictionary.take(pa.array(code[first])), pa.array(out, pa.binary())], ["block", "lang", "packed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(len(t) for t in held) >= 1_000_000:
                yield flush(held)
                held = []
        if sum(len(t) for t in held):
            yield flush(held)

    return weights.select("block", "lang", "key", "weight").mapInArrow(run, "block long, lang string, packed binary")


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of packed rows."""
    key, weight = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        data = np.frombuffer(pa.decompress(blob[8:], 12 * n, "zstd", asbytes=True), np.uint8)
        steps = np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view("<i8").ravel()
        key.append(np.cumsum(steps).astype(np.uint64))
        weight.append(np.ascontiguousarray(data[8 * n :].reshape(4, n).T).view("<f4").ravel().astype(np.float64))
    return np.concatenate(key), np.concatenate(weight)


class _Block:
    """The words of some documents, numbered by frequency once the block is full, and their n-grams."""

    def __init__(self) -> None:
        self.words = Words()
        self.parts: list[tuple] = []
        self.grams: list[tuple] = []

    def add(self, ids: pa.Array, held: np.ndarray, buf: np.ndarray, off: np.ndarray) -> None:
        low = tb.LOWER[buf]
        distinct, where, doc, _ = self.words.add(low, off)
        self.parts.append((ids, held, np.bincount(where, ~held[doc], minlength=len(distinct)).astype(np.int64)))
        symbols, at = stream(low, off, fold=False)
        self.grams.append(count_runs(keys(symbols, at), np.repeat((~held).astype(np.int64), np.diff(at))))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        texts, spelling, numbers, distinct = self.words.close()
        learned = np.zeros(len(distinct), np.int64)
        for (ids, held, n), words, number in zip(self.parts, texts, numbers, strict=True):
            learned[number] += n
            yield _row(ids, block, held_out=held, words=words)
        kind = self.parts[0][0].type
        yield _row(pa.nulls(1, kind), block, spelling=[spelling])
        for a in range(0, len(distinct), 100_000):
            n = len(distinct[a : a + 100_000])
            yield _row(pa.nulls(n, kind), block, slot=a + np.arange(n), word=distinct[a : a + n].view(np.int64), learned=learned[a : a + n])
        key, times = count_runs(np.concatenate([k for k, _ in self.grams]), np.concatenate([n for _, n in self.grams]))
        for a in range(0, len(key), 100_000):
            n = len(key[a : a + 100_000])
            yield _row(pa.nulls(n, kind), block, key=key[a : a + n].view(np.int64), learned=times[a : a + n])


_ROW = {"block": pa.int64(), "held_out": pa.bool_(), "words": pa.binary(), "spelling": pa.binary(), "slot": pa.int32(),
        "word": pa.int64(), "learned": pa.int64(), "key": pa.int64()}


def _row(ids: pa.Array, block: int, **columns) -> pa.RecordBatch:
    columns["block"] = np.full(len(ids), block)
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(columns[c], t) if c in columns else pa.nulls(len(ids), t) for c, t in _ROW.items())], ["doc_id", *_ROW]
    )


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            out = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in tb.slices(batch.column(1), 2 * tb.SLICE):
                block.add(batch.column(0).slice(lo, hi - lo), out[lo:hi], buf, off)
                if block.words.bytes >= BLOCK_BYTES:
                    yield from block.rows(number)
                    number, block = number + 1, _Block()
        yield from block.rows(number)

    told, _ = keep(rows.select("doc_id", "text", "held_out").mapInArrow(
        first, f"doc_id {kind}, block long, held_out boolean, words binary, spelling binary, slot int, word long, learned long, key long"
    ))
    by_word = Window.partitionBy("word")
    entries = told.where(F.col("slot").isNotNull()).select("word", "block", "slot", "learned")
    counts, _ = keep(entries.select(
        "block", "slot", F.sum("learned").over(by_word).alias("n"),
        (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"),
    ))
    names = ["doc_id", "block", "held_out", "words", "spelling"]
    texts = told.where("slot IS NULL AND key IS NULL").select(names).toDF(*names)  # new columns, as both sides come from one table
    learned_docs = texts.where(~F.col("held_out")).count()
    grams = told.where("key IS NOT NULL")
    table, levels = chances(grams.select("key", F.col("learned").alias("n")))
    weights, _ = keep(packed_weights(grams.select("block", "key").join(table, "key").withColumn("lang", F.lit(""))))
    del table
    for frame, path in levels:
        discard(frame, path)
    given = counts.select("block", "slot", "n", F.lit(None).cast("binary").alias("packed")).union(
        weights.select("block", F.lit(None).cast("int"), F.lit(None).cast("long"), "packed")
    )
    sums = counts.where("first AND n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens = (sums["n"] or 0) + learned_docs
    kinds = sums["v"] + (1 if learned_docs else 0)
    denominator = float(np.log10(tokens + kinds + 1))

    free_shuffles(docs.sparkSession)
    blocks = max(1, texts.where(F.col("spelling").isNotNull()).count())

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        spelling = next(x.as_py() for x in left.column("spelling") if x.is_valid)
        left = left.filter(left.column("spelling").is_null())
        key, weight = unpacked(right.column("packed").drop_null().to_pylist())
        slots = right.filter(right.column("slot").is_valid())
        n = np.zeros(slots.num_rows, np.int64)
        n[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
        gain = np.log10(n + 1.0)
        base, known, size = [], [], []
        numbers = [_unvarints(np.frombuffer(blob.as_buffer(), np.uint8)) for blob in left.column("words")]
        told = text_walks(spelling, numbers, BlockAutomaton(key, weight))
        for at in numbers:
            size.append(len(at) + 1)
            known.append(int(np.count_nonzero(n[at])) + (learned_docs > 0))
            base.append(float(gain[at].sum()) + np.log10(learned_docs + 1.0) - (len(at) + 1) * denominator)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(size, pa.int64()),
            "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * len(size), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(told),
        })

    return (
        texts.repartition(blocks, "block").groupBy("block").cogroup(given.repartition(blocks, "block").groupBy("block")).applyInArrow(
            second,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )

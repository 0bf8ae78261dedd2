"""Quality classifier: a small byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that cover all of it. In every chunk learned
filters of ``WIDTH`` bytes run over learned byte vectors, each filter is max-pooled over the chunk, and a
hidden layer describes the chunk. The descriptions are combined over the whole text by their maximum
and by their mean, which one logistic unit turns into a probability. Only text bytes are inputs.

Training is a bounded fit: ``per_class`` labelled rows of either class at most, and of each at most
``TRAIN_CHUNKS`` evenly spread chunks, which Spark cuts out before anything reaches the driver.
Scoring reads every chunk of every text in Spark tasks; memory is bounded by the slice of chunks at hand.

Defined results: null and empty texts are one chunk of padding and get the score of that; without any
learnable label the score is 0.5 everywhere; a label other than 0 or 1 is not learned from; repeated
rows get the same score; other columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.common import fold, labelled_sample

CHUNK, ADVANCE, WIDTH, STRIDE = 256, 192, 8, 4
FACTORS, FILTERS, HIDDEN = 6, 32, 16
PER_CLASS = 1500
TRAIN_CHUNKS = 24
EPOCHS = 8
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
THRESHOLD = 0.3
_CHUNKS_AT_ONCE = 512


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks of a text of ``n`` bytes: the last one reaches its end."""
    return np.arange(0, max(1, n - (CHUNK - ADVANCE)), ADVANCE)


def chunk_rows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as symbols 0..256 with 0 for padding, row of each chunk)."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - (CHUNK - ADVANCE)) // ADVANCE))
    row = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    start = (np.arange(len(row)) - first[row]) * ADVANCE
    at = start[:, None] + np.arange(CHUNK)
    within = at < size[row][:, None]
    padded = np.append(buf, 0).astype(np.int16) + 1
    return np.where(within, padded[np.minimum(at + off[row][:, None], len(buf))], 0), row


@dataclass
class Network:
    byte: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    @classmethod
    def start(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            draw(0.5, 257, FACTORS), draw((WIDTH * FACTORS) ** -0.5, WIDTH * FACTORS, FILTERS),
            np.zeros(FILTERS, np.float32), draw(FILTERS**-0.5, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32),
            draw(HIDDEN**-0.5, 2 * HIDDEN),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """The byte vectors under each filter position: (chunk x position, width x factors)."""
        x = self.byte[chunks]
        n, step = len(x), x.strides
        view = np.lib.stride_tricks.as_strided(
            x, (n, POSITIONS, WIDTH * FACTORS), (step[0], STRIDE * step[1], step[2]), writeable=False
        )
        return view.reshape(n * POSITIONS, WIDTH * FACTORS)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, filter responses by chunk and position)."""
        seen = self.windows(chunks)
        return seen, (seen @ self.filters).reshape(len(chunks), POSITIONS, FILTERS)

    def describe(self, chunks: np.ndarray) -> np.ndarray:
        top = self.pooled(chunks)[1].max(axis=1) + self.bias
        return np.tanh(np.maximum(top, 0) @ self.hidden + self.hidden_bias)

    def probabilities(self, told: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Combine chunk descriptions, given in row order, to one probability by row."""
        first = np.searchsorted(row, np.arange(n))
        most = np.maximum.reduceat(told, first)
        mean = np.add.reduceat(told, first) / np.bincount(row, minlength=n)[:, None]
        return 1 / (1 + np.exp(-(np.concatenate([most, mean], axis=1) @ self.out + self.out_bias[0])))

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, buf, off in tb.slices(texts, tb.SLICE // 4):
            told, rows = [], []
            for part, row in self._parts(buf, off):
                told.append(self.describe(part))
                rows.append(row)
            out[lo:hi] = self.probabilities(np.concatenate(told), np.concatenate(rows), hi - lo)
        return out

    @staticmethod
    def _parts(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        chunks, row = chunk_rows(buf, off)
        for i in range(0, len(row), _CHUNKS_AT_ONCE):
            yield chunks[i : i + _CHUNKS_AT_ONCE], row[i : i + _CHUNKS_AT_ONCE]

    def gradients(self, chunks: np.ndarray, row: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss of a batch."""
        n, docs = len(chunks), len(label)
        seen, response = self.pooled(chunks)
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + self.bias
        open_ = np.maximum(top, 0)
        told = np.tanh(open_ @ self.hidden + self.hidden_bias)
        first = np.searchsorted(row, np.arange(docs))
        most = np.maximum.reduceat(told, first)
        size = np.bincount(row, minlength=docs)[:, None]
        both = np.concatenate([most, np.add.reduceat(told, first) / size], axis=1)
        miss = (1 / (1 + np.exp(-(both @ self.out + self.out_bias[0]))) - label) / docs
        d_both = miss[:, None] * self.out
        is_most = told == most[row]
        shares = np.add.reduceat(is_most.astype(np.float32), first)
        d_told = is_most * (d_both[:, :HIDDEN] / shares)[row] + (d_both[:, HIDDEN:] / size)[row]
        d_pre = (d_told * (1 - told**2)).astype(np.float32)
        d_top = (d_pre @ self.hidden.T) * (top > 0)
        which = (np.arange(n)[:, None] * POSITIONS + best).ravel()
        d_flat, filter_of = d_top.ravel(), np.tile(np.arange(FILTERS), n)
        d_filters = np.einsum("nfw,nf->wf", seen[which].reshape(n, FILTERS, -1), d_top)
        d_seen = (d_flat[:, None] * self.filters.T[filter_of]).reshape(-1, WIDTH, FACTORS)
        symbol = chunks[(which // POSITIONS)[:, None], ((which % POSITIONS) * STRIDE)[:, None] + np.arange(WIDTH)]
        d_byte = np.stack(
            [np.bincount(symbol.ravel(), d_seen[:, :, k].ravel(), minlength=257) for k in range(FACTORS)], axis=1
        )
        return [d_byte, d_filters, d_top.sum(0), open_.T @ d_pre, d_pre.sum(0), both.T @ miss, miss.sum(keepdims=True)]


def train(chunks: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit by Adam on batches of texts; ``chunks[i]`` are the symbol rows of text i."""
    net, rng = Network.start(), np.random.default_rng(seed)
    first, second, step = ([np.zeros_like(p) for p in net.parameters()] for _ in range(3))
    t = 0
    for epoch in range(epochs):
        rate = 0.006 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(chunks))
        for i in range(0, len(order), 16):
            pick = order[i : i + 16]
            row = np.repeat(np.arange(len(pick)), [len(chunks[k]) for k in pick])
            found = net.gradients(np.concatenate([chunks[k] for k in pick]), row, label[pick])
            t += 1
            for p, g, m, v in zip(net.parameters(), found, first, second, strict=True):
                g = g.astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def training_chunks(docs: DataFrame, sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Evenly spread chunks of the sampled texts, cut in Spark tasks, in id order."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    kind = dict(texts.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, buf, off in tb.slices(batch.column(2), 1):
                start = chunk_starts(len(buf))
                if len(start) > TRAIN_CHUNKS:
                    start = start[np.linspace(0, len(start) - 1, TRAIN_CHUNKS).astype(int)]
                at = start[:, None] + np.arange(CHUNK)
                padded = np.append(buf, 0).astype(np.int16) + 1
                parts.append(np.where(at < len(buf), padded[np.minimum(at, len(buf))], 0).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["doc_id", "label", "chunks"]
            )

    got = texts.mapInArrow(cut, f"doc_id {kind}, label int, chunks binary").toPandas()
    got = got.sort_values(["doc_id", "chunks"], kind="stable")
    return (
        [np.frombuffer(c, "<i2").reshape(-1, CHUNK) for c in got["chunks"]],
        got["label"].to_numpy(np.float32),
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0,
        per_class: int = PER_CLASS) -> Network | None:
    """Learn from rows outside the held-out fold; None if there is nothing to learn from."""
    sample = labelled_sample(labels, label, fold(F.col("doc_id"), folds) != held, per_class)
    chunks, y = training_chunks(docs, sample)
    return train(chunks, y) if len(y) else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.score(batch.column(1)) if model.value else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all their columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.value:
                batch = batch.filter(pa.array(model.value.score(batch.column(at)) >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)

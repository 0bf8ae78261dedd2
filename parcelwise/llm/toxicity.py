"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence in a text of a hashed run of 3, 4 or 5 bytes (A-Z in lower case, white space as one
kind of blank). Each feature's log-count ratio compares its smoothed share of toxic texts with its share of the
others; features are scaled by it and a logistic regression is fitted on top. Only text bytes are inputs.

Training is a bounded fit: ``per_class`` labelled rows of either class at most; Spark tasks turn their texts into
feature sets before anything reaches the driver, and the intercept is moved from the sample's class balance
to that of all learnable labels. Scoring reads every whole text in Spark tasks, slice by slice.

Defined results: null and empty texts have no feature and score as the intercept says; if either class has
no learnable label the score is that class balance (0 or 1; 0 without any label); a label other than 0 or
1 is not learned from; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import textbytes as tb
from parcelwise.llm.common import fold, labelled_sample

SIZES = (3, 4, 5)
BITS = 18
PER_CLASS = 2000
THRESHOLD = 0.7
ROUNDS = 80
PENALTY = 1e-3
LEAST_DOCS = 3
LEAST_RATIO = 1.0  # nearly balanced features only add up to noise in long texts
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD1B54A32D192ED03)
_FOLDED = tb.LOWER.copy()
_FOLDED[tb.GAP] = 32


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): the distinct features of each row, in order."""
    text = _FOLDED[buf].astype(np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys = []
    for n, spread in zip(SIZES, _SPREAD, strict=True):
        m = len(text) - n + 1
        if m <= 0:
            continue
        code = text[:m].copy()
        for i in range(1, n):
            code |= text[i : i + m] << np.uint64(8 * i)
        slot = (code * np.uint64(spread)) >> np.uint64(64 - BITS)
        inside = row[:m] == row[n - 1 :]
        keys.append((row[:m][inside] << BITS) | slot[inside].astype(np.int64))
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray  # by feature, the log-count ratio multiplied in
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, buf, off in tb.slices(texts):
            row, feature = features(buf, off)
            out[lo:hi] = tb.per_row(row, hi - lo, self.weight[feature])
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """By feature, from its numbers of toxic and other texts; 0 for features that are rare or balanced."""
    p, q = toxic + smooth, other + smooth
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(toxic + other < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def train(sets: list[np.ndarray], label: np.ndarray, prior: float) -> Model:
    """Fit on the feature sets of the sample; ``prior`` is the share of toxic texts among all labels."""
    counts = np.zeros((2, 1 << BITS))
    for s, y in zip(sets, label, strict=True):
        counts[int(y), s] += 1
    ratio = log_count_ratios(counts[1], counts[0])
    used = ratio != 0
    number = np.cumsum(used) - 1
    kept = [number[s[used[s]]].astype(np.int32) for s in sets]
    column = np.concatenate(kept)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(k) for k in kept])
    scale = ratio[used]
    w, m, v = (np.zeros(len(scale)) for _ in range(3))
    b = mb = vb = 0.0
    step = 0.05
    for t in range(1, ROUNDS + 1):
        z = np.bincount(doc, (w * scale)[column], minlength=len(sets)) + b
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / len(sets)
        g = np.bincount(column, miss[doc], minlength=len(scale)) * scale + PENALTY * w / len(sets)
        gb = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= step * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= step * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weight = np.zeros(1 << BITS)
    weight[used] = w * scale
    share = label.mean()
    return Model(weight, b + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def training_sets(docs: DataFrame, sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The feature sets of the sampled texts, in id order."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for lo, hi, buf, off in tb.slices(batch.column(2)):
                row, feature = features(buf, off)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                sets += [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["doc_id", "label", "sets"]
            )

    got = texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, label int, sets binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("sets", "ascending")])
    sets = [np.frombuffer(s.as_buffer(), "<u4") for s in got.column("sets")]
    return sets, got.column("label").to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1,
        per_class: int = PER_CLASS) -> Model:
    """Learn from rows outside the held-out fold."""
    learn = fold(F.col("doc_id"), folds) != held
    share = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).agg(F.avg(label)).first()[0]
    sets, y = training_sets(docs, labelled_sample(labels, label, learn, per_class))
    if share is None or not len(y) or y.min() == y.max() or not 0 < share < 1:
        only = share if share is not None else 0.0
        only = min(max(only, 0.0), 1.0)
        return Model(np.zeros(1 << BITS), 500.0 if only > 0.5 else -500.0)
    return train(sets, y, float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["doc_id", "score"]
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")

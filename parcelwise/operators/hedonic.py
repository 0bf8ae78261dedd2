"""Robust hedonic regression of log price per m2, one model per (city, type, ownership).

Huber M-estimation by iteratively reweighted least squares: tuning constant 1.345, scale from the
median absolute residual, at most 50 rounds, until the deviance settles within 1e-8.

One solver serves every group. A group's rows lie in blocks of about ``BLOCK_ROWS``; a weighted block is reduced to
the triangular factor of a QR decomposition, factors merge in a tree, and the last one gives the least squares
solution of smallest norm. The factor has the singular values of the whole design, so precision and rank do not
suffer from squaring, and collinear columns share their effect alike whatever a group's size. Listings that are alike in
every feature share one row of the design and are dealt to one block, so that a large group keeps little more than its
targets. A group of one block goes through its rounds in the task that holds the block; for all others a round is one
pass for the factors and mostly one for the median absolute residual, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import scoring as s
from parcelwise.operators.order_stats import order_stats
from parcelwise.session import materialize

GROUP = ["city", "property_type", "ownership_type"]
MIN_FIT_ROWS = 50
BLOCK_ROWS = 250_000
HUBER_T = 1.345
MAD_TO_SIGMA = 0.6744897501960817
TOLERANCE = 1e-8
MAX_ROUNDS = 50
#: Singular values below this share of the largest count as zero, at every number of rows.
RANK_CUT = 1e-12

CONTINUOUS = ["log_size_m2", "floor_current"]
BINARY = ["has_balcony", "has_loggia", "has_terrace", "has_cellar", "has_parking",
          "top_floor_walkup"]
CATEGORICAL = ["building_type", "disposition", "condition", "energy_class", "city_district",
               "year_built_bucket"]

MODEL_SCHEMA = (
    "city string, property_type string, ownership_type string, intercept double, "
    "coefficients map<string,double>, n_samples bigint, n_features int, residual_stddev double"
)


def design_columns(have: set[str]) -> list[Column]:
    """Group columns, the target ``y`` and the features, from listing columns.

    Missing toggles count as absent, a missing floor as 0; categories stay NULL when unknown.
    """
    flag = lambda c: (
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    )
    text = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    size = F.col("size_m2").cast("double")
    return [
        s.parent_city(F.col("city_district")).alias("city"),
        F.col("property_type"),
        F.col("ownership_type"),
        F.log(s.ppm2(F.col("price"), F.col("size_m2"))).alias("y"),
        F.when(size > 0, F.log(F.when(size > 0, size))).alias("log_size_m2"),
        F.coalesce(F.col("floor_current").cast("double"), F.lit(0.0)).alias("floor_current"),
        *[flag(c).alias(c) for c in BINARY[:-1]],
        s.top_floor_walkup(F.col("floor_current"), F.col("floor_total"), F.col("has_lift"))
        .cast("double").alias("top_floor_walkup"),
        *[text(c).alias(c) for c in CATEGORICAL[:-1]],
        s.year_bucket(F.col("year_built")).alias("year_built_bucket"),
    ]


def design(listings: DataFrame) -> DataFrame:
    return listings.select(*design_columns(set(listings.columns)))


def trainable(rows: DataFrame) -> DataFrame:
    return rows.where(
        F.col("city").isNotNull() & F.col("ownership_type").isNotNull() & F.col("y").isNotNull()
        & F.col("log_size_m2").isNotNull()
    )


def category_levels(rows: DataFrame) -> DataFrame:
    """Per group and categorical feature the sorted levels without the first, the reference."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in CATEGORICAL]
    )
    seen = (
        rows.select(*GROUP, F.explode(pairs).alias("p"))
        .select(*GROUP, "p.feature", "p.level")
        .where(F.col("level").isNotNull())
        .distinct()
    )
    levels = F.sort_array(F.collect_list("level"))
    return seen.groupBy(*GROUP, "feature").agg(
        F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))).alias("levels")
    )


def factor(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of the weighted design with the target as its last column."""
    a = np.column_stack([x, y])
    return np.linalg.qr(a if weight is None else a * np.sqrt(weight)[:, None], mode="r")


def merged(factors: Sequence[np.ndarray]) -> np.ndarray:
    """The factor of all the rows that the factors stand for."""
    return np.linalg.qr(np.vstack(factors), mode="r") if len(factors) > 1 else factors[0]


def least_squares(r: np.ndarray) -> np.ndarray:
    """The solution of smallest norm of the least squares problem behind a factor."""
    return np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=RANK_CUT)[0]


def huber_weight(resid: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """(weights, loss) of residuals at a scale."""
    z = np.abs(resid) / scale
    loss = np.where(z <= HUBER_T, 0.5 * z * z, HUBER_T * z - 0.5 * HUBER_T**2).sum()
    return np.where(z <= HUBER_T, 1.0, HUBER_T / np.maximum(z, HUBER_T)), float(loss)


def shared_factor(x: np.ndarray, y: np.ndarray, runs: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """:func:`factor` where each row of ``x`` stands for the next ``runs`` targets.

    Equal rows of a design add up to one of their summed weight at their mean target; what the targets differ from that mean is
    orthogonal to the design and would change the last diagonal value only.
    """
    starts = np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(int)
    total = runs.astype(float) if weight is None else np.add.reduceat(weight, starts)
    return factor(x, np.add.reduceat(y if weight is None else y * weight, starts) / total, total)


def huber_fit(x: np.ndarray, y: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residuals of one block: the rounds of ``_fit_in_rounds`` without an exchange."""
    beta, before = least_squares(shared_factor(x, y, runs)), np.inf
    for turn in range(MAX_ROUNDS):
        resid = y - np.repeat(x @ beta, runs)
        scale = np.median(np.abs(resid)) / MAD_TO_SIGMA
        if scale == 0.0 or turn == MAX_ROUNDS - 1:
            break
        weight, loss = huber_weight(resid, scale)
        if turn:
            if abs(loss - before) <= TOLERANCE:
                break
            before = loss
        beta = least_squares(shared_factor(x, y, runs, weight))
    return beta, resid


_PLAIN = 1 + len(CONTINUOUS) + len(BINARY)


FITTED = "gid long, widths array<int>, block binary, runs binary, targets binary, beta array<double>, residual_stddev double"


def _shared_rows(key: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order that brings equal rows of ``data`` together, how many follow each other); equal rows have equal keys."""
    order = np.argsort(key, kind="stable")
    sorted_ = data[order]
    new = np.ones(len(data), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (sorted_[1:] != sorted_[:-1]).any(axis=1)
    return order, np.diff(np.append(np.flatnonzero(new), len(data)))


def _one_block(table: pa.Table) -> pa.Table:
    """A block of a group, a design row for all targets that share it; with its coefficients and residual deviation where it
    is the group's only one."""
    gid, parts, widths = table["gid"][0].as_py(), table["parts"][0].as_py(), table["widths"][0].as_py()
    column = lambda c: table[c].to_numpy()
    names = [*CONTINUOUS, *BINARY, *[f"c_{f}" for f in CATEGORICAL]]
    data = np.column_stack([np.zeros(len(table)), *[column(c) for c in names]])
    order, runs = _shared_rows(column("alike"), data)
    y = column("y")[order]
    block = data[order[np.cumsum(runs) - runs]].tobytes()
    if parts > 1:
        row = (gid, widths, block, runs.tobytes(), y.tobytes(), None, None)
    else:
        beta, resid = huber_fit(_unpack(block, widths)[0], y, runs)
        row = (gid, None, None, None, None, beta.tolist(), float(np.std(resid)))
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
    names = ["gid", "widths", "block", "runs", "targets", "beta", "residual_stddev"]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=names)


def _unpack(block: bytes, widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(design matrix, target) of a block; ``widths`` are the levels of each category."""
    data = np.frombuffer(block).reshape(-1, _PLAIN + len(CATEGORICAL))
    parts = [np.ones((len(data), 1)), data[:, 1:_PLAIN]]
    for i, width in enumerate(widths):
        parts.append((data[:, _PLAIN + i, None] == np.arange(1, width + 1)).astype(float))
    return np.concatenate(parts, axis=1), data[:, 0]


def _read(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(design matrix, targets, how many of them share each design row); a block without runs holds a row per target."""
    x, y = _unpack(r.block, r.widths)
    if getattr(r, "runs", None) is None:
        return x, y, np.ones(len(y), int)
    return x, np.frombuffer(r.targets), np.frombuffer(r.runs, np.int64)


FACTORS = "gid long, part int, widths array<int>, factor binary, loss double"
#: Low bits of a residual that its bin drops: a bin is 0.05 % wide.
_BIN_BITS = 41


@dataclass
class _State:
    """Where a group's rounds stand; a few numbers per group of several blocks."""

    beta: np.ndarray | None = None
    scale: float = 0.0
    before: float | None = None
    #: bin of the last median, and how far the bins are from it in which the next one is looked for first
    bin: int | None = None
    reach: int | None = None


def _away(r, state: dict[int, _State]) -> np.ndarray:
    x, y, runs = _read(r)
    return y - np.repeat(x @ state[r.gid].beta, runs)


def _factors(state: Broadcast):
    """One row per group and task: the merged factor of its blocks at the state's coefficients and scale."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                at = state.value.get(r.gid)
                if at is None:
                    continue
                x, y, runs = _read(r)
                if not len(y):
                    continue
                w, loss = (None, 0.0) if at.beta is None else huber_weight(y - np.repeat(x @ at.beta, runs), at.scale)
                new = shared_factor(x, y, runs, w)
                if r.gid in held:
                    new, loss = merged([held[r.gid][1], new]), held[r.gid][2] + loss
                held[r.gid] = r.widths, new, loss
        part = TaskContext.get().partitionId() % 32
        rows = [(gid, part, widths, f.tobytes(), loss) for gid, (widths, f, loss) in held.items()]
        yield pd.DataFrame(rows, columns=["gid", "part", "widths", "factor", "loss"])

    return run


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, float]:
    width = _PLAIN + int(sum(pdf["widths"].iloc[0])) + 1
    return merged([np.frombuffer(f).reshape(-1, width) for f in pdf["factor"]]), float(pdf["loss"].sum())


def _merge_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    f, loss = _merged(pdf)
    row = (pdf["gid"].iloc[0], 0, pdf["widths"].iloc[0], f.tobytes(), loss)
    return pd.DataFrame([row], columns=["gid", "part", "widths", "factor", "loss"])


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    f, loss = _merged(pdf)
    return pd.DataFrame([(pdf["gid"].iloc[0], least_squares(f).tolist(), loss)], columns=["gid", "next", "loss"])


#: Keys of the rows below a group's bins and of those above.
_BELOW, _ABOVE = -1, -2


def _counted(state: Broadcast, bins: dict[int, tuple[int, int]] | None):
    """(gid, key, n): absolute residuals counted by bin, or by value (its bits) inside the groups' ``bins``; what lies
    outside them is counted as a whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.gid not in state.value:
                    continue
                # bits of doubles that are not negative are in the order of the doubles
                bits = np.abs(_away(r, state.value)).view(np.int64)
                own = bits >> _BIN_BITS
                if bins is not None:
                    low, high = bins[r.gid]
                    below, above = own < low, own > high
                    own = np.concatenate([bits[~(below | above)], np.full(below.sum(), _BELOW), np.full(above.sum(), _ABOVE)])
                key, n = np.unique(own, return_counts=True)
                yield pd.DataFrame({"gid": r.gid, "key": key, "n": n})

    return run


def _at_rank(keys: np.ndarray, n: np.ndarray, rank: int) -> int:
    return int(keys[np.searchsorted(np.cumsum(n), rank, side="right")])


def _bin(value: float) -> int:
    return int(np.float64(value).view(np.int64)) >> _BIN_BITS


def _medians(blocks: DataFrame, state: Broadcast) -> dict[int, float]:
    """The exact median absolute residual of every group of the state. Where the one before tells about where it is, the values of
    a few bins are counted at once; else first all bins, then the values of the middle ones. What comes to the driver is a row
    per bin and the values of a few of them, a thousandth or so of a group."""
    spark = blocks.sparkSession

    def counts(of: Broadcast, bins: dict[int, tuple[int, int]] | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        seen = blocks.mapInPandas(_counted(of, bins), "gid long, key long, n long").groupBy("gid", "key").agg(F.sum("n").alias("n"))
        return {gid: tuple(g.sort_values("key")[c].to_numpy() for c in ("key", "n")) for gid, g in seen.toPandas().groupby("gid")}

    def found(bins: dict[int, tuple[int, int]], of: Broadcast) -> dict[int, float]:
        """The medians that lie in the bins."""
        out = {}
        for gid, (keys, n) in counts(of, bins).items():
            inside, below = keys >= 0, int(n[keys == _BELOW].sum())
            ranks = [int(r) - below for r in ((n.sum() - 1) // 2, n.sum() // 2)]
            if ranks[0] >= 0 and ranks[1] < n[inside].sum():
                # between the two bins of a gap there are no values
                middle = np.array([_at_rank(keys[inside], n[inside], r) for r in ranks])
                out[gid] = float(np.mean(middle.view(np.float64)))
        return out

    near = {gid: (at.bin - at.reach, at.bin + at.reach) for gid, at in state.value.items() if at.reach is not None}
    if near:
        some = spark.sparkContext.broadcast({gid: state.value[gid] for gid in near})
        out = found(near, some)
        some.unpersist()
    else:
        out = {}
    rest = {gid: at for gid, at in state.value.items() if gid not in out}
    if rest:
        left, bins = spark.sparkContext.broadcast(rest), {}
        for gid, (keys, n) in counts(left, None).items():
            bins[gid] = tuple(_at_rank(keys, n, r) for r in ((n.sum() - 1) // 2, n.sum() // 2))
        out |= found(bins, left)
        left.unpersist()
    return out


def _moments(state: Broadcast):
    """(gid, n, mean, m2) of the residuals of every block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                resid = _away(r, state.value)
                yield pd.DataFrame({"gid": [r.gid], "n": [float(len(resid))], "mean": [resid.mean()], "m2": [resid.var() * len(resid)]})

    return run


def _label(feature: str):
    return lambda level: F.concat(F.lit(f"cat__{feature}__"), level)


def _fit_in_rounds(blocks: DataFrame) -> DataFrame:
    """(gid, beta, residual_stddev) of the groups of several blocks (gid, widths, block); every round serves those that
    have not settled. Between the rounds the driver holds the groups' coefficients and scales, nothing that grows with their rows."""
    spark = blocks.sparkSession
    state = {r.gid: _State() for r in blocks.select("gid").distinct().collect()}
    settled: dict[int, _State] = {}
    many = blocks.rdd.getNumPartitions() > 32
    for turn in range(MAX_ROUNDS + 1):
        now = spark.sparkContext.broadcast(state)
        factors = blocks.mapInPandas(_factors(now), FACTORS)
        if many:
            factors = factors.groupBy("gid", "part").applyInPandas(_merge_parts, FACTORS)
        solved = factors.groupBy("gid").applyInPandas(_solve, "gid long, next array<double>, loss double").collect()
        going = {}
        for r in solved:
            at = state[r.gid]
            # the loss belongs to the coefficients that the round began with
            if turn == MAX_ROUNDS or (at.before is not None and abs(r.loss - at.before) <= TOLERANCE):
                settled[r.gid] = at
            else:
                going[r.gid] = _State(np.asarray(r.next), before=r.loss if turn > 1 else None, bin=at.bin, reach=at.reach)
        now.unpersist()
        if not going:
            break
        now = spark.sparkContext.broadcast(going)
        for gid, middle in _medians(blocks, now).items():
            at, own = going[gid], _bin(middle)
            moved = None if at.bin is None else abs(own - at.bin)
            at.scale, at.bin, at.reach = middle / MAD_TO_SIGMA, own, None if moved is None or moved > 3 else 1 + moved
        now.unpersist()
        settled |= {gid: at for gid, at in going.items() if at.scale == 0}
        state = {gid: at for gid, at in going.items() if at.scale > 0}
        if not state:
            break
    parts = blocks.mapInPandas(_moments(spark.sparkContext.broadcast(settled)), "gid long, n double, mean double, m2 double")
    whole = parts.groupBy("gid").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))
    spread = parts.join(whole, "gid").groupBy("gid").agg(
        F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) ** 2) / F.sum("n")).alias("residual_stddev")
    )
    fits = spark.createDataFrame([(gid, at.beta.tolist()) for gid, at in settled.items()], "gid long, beta array<double>")
    return fits.join(spread, "gid")


def fit_models(listings: DataFrame, min_rows: int = MIN_FIT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per fitted group; groups with fewer than ``min_rows`` usable rows have none.

    ``block_rows`` bounds what a task holds; models do not depend on it.
    """
    rows = materialize(trainable(design(listings)).withColumn("row", F.monotonically_increasing_id()))
    groups = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    by_feature = category_levels(rows).groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "levels"))).alias("levels")
    )
    levels = {f: F.coalesce(F.col("levels")[f], F.array().cast("array<string>")) for f in CATEGORICAL}
    named = materialize(
        groups.join(by_feature, GROUP, "left").select(
            F.monotonically_increasing_id().alias("gid"), *GROUP, "n", F.ceil(F.col("n") / block_rows).alias("parts"),
            *[levels[f].alias(f"__{f}") for f in CATEGORICAL],
            F.array(*[F.size(levels[f]) for f in CATEGORICAL]).alias("widths"),
        )
    )
    codes = [
        F.coalesce(F.array_position(F.col(f"__{f}"), F.col(f)), F.lit(0)).cast("double").alias(f"c_{f}")
        for f in CATEGORICAL
    ]
    names = [*CONTINUOUS, *BINARY, *[f"c_{f}" for f in CATEGORICAL]]
    coded = rows.join(named, GROUP).select("gid", "parts", "widths", "row", "y", *CONTINUOUS, *BINARY, *codes).withColumn(
        "alike", F.xxhash64(*names)
    )
    # what is alike meets in one block, unless it is so much that it is dealt out by row
    large = coded.where("parts > 1").groupBy("gid", "alike").agg(F.count(F.lit(1)).alias("n"))
    frequent = materialize(large.where(F.col("n") > block_rows / 4).select("gid", "alike", F.lit(True).alias("frequent")))
    coded = coded.join(F.broadcast(frequent), ["gid", "alike"], "left")
    dealt = F.when(F.col("frequent"), F.col("row")).otherwise(F.col("alike"))
    coded = coded.select("gid", "parts", F.pmod(dealt, "parts").alias("part"), "widths", "alike", "y", *names)
    fitted = materialize(coded.groupBy("gid", "part").applyInArrow(_one_block, FITTED))
    done = fitted.where("block IS NULL").select("gid", "beta", "residual_stddev")
    blocks = fitted.where("block IS NOT NULL").select("gid", "widths", "block", "runs", "targets")
    if not blocks.select("gid").isEmpty():
        done = done.unionByName(_fit_in_rounds(blocks))
    labels = F.concat(
        F.array(*[F.lit(c) for c in CONTINUOUS + BINARY]),
        *[F.transform(F.col(f"__{f}"), _label(f)) for f in CATEGORICAL],
    )
    return materialize(
        named.join(done, "gid").select(
            *GROUP, F.col("beta")[0].alias("intercept"),
            F.map_from_arrays(labels, F.slice("beta", F.lit(2), F.size(labels))).alias("coefficients"),
            F.col("n").alias("n_samples"), F.size(labels).alias("n_features"), "residual_stddev",
        )
    )


def score_equations(listings: DataFrame, models: DataFrame) -> DataFrame:
    """(GROUP, feature, n_samples, excess): how far each model is from solving its equations.

    A Huber fit makes the residuals, cut at 1.345 scales, orthogonal to every column of the design; ``excess`` is the
    largest mean product, in scales, per column. The scale is the median absolute residual, found anew here.
    """
    rows = design(listings).transform(trainable).join(
        models.select(*GROUP, "intercept", "coefficients", "n_samples"), GROUP
    )
    away = materialize(rows.withColumn("resid", F.col("y") - predicted_log(F.col("coefficients"), F.col("intercept"), F.struct(
        *CONTINUOUS, *BINARY, *CATEGORICAL
    ))).withColumn("away", F.abs("resid")))
    middle = order_stats(away, GROUP, "away", {"m": 0.5}).select(*GROUP, (F.col("m") / MAD_TO_SIGMA).alias("scale"))
    cut = F.greatest(F.least(F.col("resid") / F.col("scale"), F.lit(HUBER_T)), F.lit(-HUBER_T))
    columns = F.filter(
        F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ["intercept", *CONTINUOUS, *BINARY]],
            *[F.struct(F.concat(F.lit(f"cat__{c}__"), F.col(c)).alias("feature"), F.lit(1.0).alias("x")) for c in CATEGORICAL],
        ),
        lambda e: e["feature"].isNotNull() & (e["x"] != 0),
    )
    sums = (
        away.join(middle, GROUP).withColumn("intercept", F.lit(1.0))
        .select(*GROUP, F.when(F.col("scale") > 0, cut).otherwise(0.0).alias("cut"), F.explode(columns).alias("e"))
        .groupBy(*GROUP, F.col("e.feature").alias("feature")).agg(F.sum(F.col("cut") * F.col("e.x")).alias("total"))
    )
    features = models.select(*GROUP, "n_samples", F.explode(F.concat(F.array(F.lit("intercept")), F.map_keys("coefficients"))).alias("feature"))
    return features.join(sums, [*GROUP, "feature"], "left").select(
        *GROUP, "feature", "n_samples", F.coalesce(F.abs("total") / F.col("n_samples"), F.lit(0.0)).alias("excess")
    )


def predicted_log(coefficients: Column, intercept: Column, row: Column) -> Column:
    """Prediction from a design row; a level the model never saw counts as the reference."""
    total = intercept
    for name in CONTINUOUS + BINARY:
        total = total + F.coalesce(coefficients[name], F.lit(0.0)) * row[name]
    for name in CATEGORICAL:
        label = F.concat(F.lit(f"cat__{name}__"), row[name])
        total = total + F.coalesce(coefficients[label], F.lit(0.0))
    return total


def with_predictions(listings: DataFrame, models: DataFrame) -> DataFrame:
    """Add predicted_log, actual_log and hedonic_fit to every listing: one join with the model table.

    A model is one row per city, type and ownership, so the models go to the listings: by these few keys all
    listings of a city would meet in one task."""
    side = models.select(
        *[F.col(g).alias(f"__{g}") for g in GROUP], F.col("intercept").alias("__intercept"),
        F.col("coefficients").alias("__coefficients"),
    )
    rows = listings.withColumn("__x", F.struct(*design_columns(set(listings.columns))))
    same = F.lit(True)
    for g in GROUP:
        same = same & (F.col(f"__x.{g}") == F.col(f"__{g}"))
    joined = rows.join(F.broadcast(side), same, "left")
    return joined.select(
        *listings.columns,
        predicted_log(F.col("__coefficients"), F.col("__intercept"), F.col("__x"))
        .alias("predicted_log"),
        F.col("__x.y").alias("actual_log"),
        F.col("__intercept").isNotNull().alias("hedonic_fit"),
    )


def predict(
    listings: DataFrame, models: DataFrame, keep: Sequence[str] = ("listing_id",)
) -> DataFrame:
    """The ``keep`` columns with predicted_log, actual_log and hedonic_fit."""
    return with_predictions(listings, models).select(
        *keep, "predicted_log", "actual_log", "hedonic_fit"
    )

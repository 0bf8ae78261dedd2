"""Order statistics: both ways of computing them against numpy, with a dominant group."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import order_stats as o
from parcelwise.operators import segments as seg
from parcelwise.operators.ordered import with_previous
from parcelwise.operators.skew import group_facts, latest_per_key

Q = {"median": 0.5, "p25": 0.25, "p75": 0.75}


def expected(values, trim=0.1):
    v = sorted(x for x in values if x is not None)
    k = int(len(v) * trim)
    kept = v[k : len(v) - k] if len(v) - 2 * k > 0 else v
    return {
        "n_samples": len(v), "median": float(np.quantile(v, 0.5)), "p25": float(np.quantile(v, 0.25)),
        "p75": float(np.quantile(v, 0.75)), "trimmed_mean": sum(kept) / len(kept), "stddev": statistics.pstdev(v),
        "min": v[0], "max": v[-1], "mean": sum(v) / len(v),
    }


def test_documented_cases(spark):
    df = spark.createDataFrame(
        [("a", float(x)) for x in range(1, 10)] + [("b", float(x)) for x in [*range(1, 10), 1000]] + [("c", 7.0)], "k string, v double")
    rows = {r.k: r for r in o.order_stats(df, ["k"], "v", Q, 0.1).collect()}
    assert (rows["a"].median, rows["a"].p25, rows["a"].p75) == (5.0, 3.0, 7.0)
    assert rows["b"].trimmed_mean == 5.5
    assert (rows["c"].n_samples, rows["c"].stddev, rows["c"].trimmed_mean) == (1, 0.0, 7.0)


def test_random_groups_with_hot_group_nulls_and_ties(spark):
    rng = np.random.default_rng(7)
    data = [(None, float(x)) for x in rng.lognormal(6, 1, 3000)]
    data += [("tied", 12.5)] * 900 + [("tied", float(x)) for x in rng.normal(0, 5, 100)]
    data += [(f"g{i % 17}", float(x)) for i, x in enumerate(rng.normal(0, 1000, 700))]
    data += [("g1", None), ("g1", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.asDict() for r in o.order_stats(df, ["k"], "v", Q, 0.1, extra={"total": ("v", "sum")}).collect()}
    groups = {}
    for k, v in data:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, want in expected(values).items():
            assert got[k][name] == pytest.approx(want, rel=1e-9, abs=1e-9), (k, name)
        assert got[k]["total"] == pytest.approx(sum(values), rel=1e-9, abs=1e-6)


def test_whole_table_without_keys(spark):
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("v"))
    assert o.order_stats(df, [], "v", {"m": 0.5}).head()["m"] == 500.0


def test_distributed_rank_equals_competition_rank(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.integers(-50, 50, 800)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    got = {r.id: r["rank"] for r in o.distributed_rank(df, "v").collect()}
    assert got == {i: 1 + sum(w > v for w in values) for i, v in enumerate(values)}


def test_ladder_against_plain_pools(spark):
    rng = np.random.default_rng(5)
    rows = [
        (["Praha 1", "Praha 2", "Brno", None][rng.integers(4)], "byt", ["2+kk", "3+1", None][rng.integers(3)],
         ["osobni", None][int(rng.random() < 0.1)], ["panel", "cihla"][rng.integers(2)], float(rng.integers(20, 200)),
         ["dobry", "spatny", None][rng.integers(3)], float(rng.lognormal(15, 0.4)))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, "city_district string, property_type string, disposition string, ownership_type string, "
                                     "building_type string, size_m2 double, condition string, price double")
    got = {r.segment_key: r.asDict() for r in seg.relaxed_stats(df).collect()}
    bases = seg.with_segment(df.withColumn("v", F.col("price") / F.col("size_m2"))).select("segment", "segment_key", "v")
    levels = seg.with_levels(bases).select("segment_key", "v", F.explode("__levels").alias("l")).select("segment_key", "v", "l.level", "l.rkey").collect()
    pools, routes = {}, {}
    for r in levels:
        pools.setdefault((r.level, r.rkey), []).append(r.v)
        routes.setdefault(r.segment_key, {})[r.level] = r.rkey
    assert got.keys() == routes.keys()
    for k, route in routes.items():
        level = next((lv for lv in sorted(route) if len(pools[lv, route[lv]]) >= 30), None)
        assert got[k]["relaxation_level"] == level
        if level is not None:
            for name, want in expected(pools[level, route[level]]).items():
                if name in got[k]:
                    assert got[k][name] == pytest.approx(want, rel=1e-9), (k, name)
    assert any(r["relaxation_level"] == 0 for r in got.values()) or any(r["relaxation_level"] for r in got.values())


def test_previous_row_matches_plain_lag(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.integers(5)}", int(t), f"h{rng.integers(3)}") for t in rng.permutation(2000) * 3000]
    rows.append((None, 5, "x"))
    df = spark.createDataFrame(rows, "k string, s bigint, h string").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.k, r.s): r.prev_h for r in with_previous(df, ["k"], ["t"], ["h"]).collect()}
    want, last = {}, {}
    for k, s, h in sorted(rows, key=lambda r: r[1]):
        want[(k, s)] = last.get(k)
        last[k] = h
    assert got == want


def test_latest_and_group_facts_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 5, "c")], "k string, t int, v string")
    assert {(r.k, r.v) for r in latest_per_key(df, ["k"], ["t"]).collect()} == {(None, "b"), ("x", "c")}
    counted = group_facts(df, ["k"], [F.count(F.lit(1)).alias("n")])
    assert {(r.k, r.t, r.n) for r in counted.collect()} == {(None, 1, 2), (None, 2, 2), ("x", 5, 1)}

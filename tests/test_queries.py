"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(float(v) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def frame(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = frame(df.columns, [tuple(r) for r in df.collect()])
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    rel = duck.execute(sql)
    assert got == frame([d[0] for d in rel.description], rel.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_scores_meet_statistics_of_known_size(spark):
    plan = driver.queries()["K3_score_rows_without_model"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan

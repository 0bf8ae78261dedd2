"""Breakdown, yield and segment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions import scoring as s
from parcelwise.operators import segments as seg
from parcelwise.plans import analytics as an
from workloads.registry import AS_OF_SQL, VERSIONS, L, P, as_of, query, rounded, versions

_KEYS = {
    "disposition": "coalesce(l.disposition, '(neuvedeno)')",
    "locality": "coalesce(p.locality, '(neuvedeno)')",
    "city_district": "coalesce(p.city_district, '(neuvedeno)')",
}


def _breakdown_sql(group_by: str, extra: str = "") -> str:
    return f"""
WITH l AS ({L}), p AS ({P}), v AS ({VERSIONS}),
active AS (
  SELECT l.listing_id, l.price, l.size_m2, l.first_seen_at, {_KEYS[group_by]} AS group_key, p.lat, p.lon
  FROM l LEFT JOIN p ON p.property_id = l.property_id
  WHERE l.status = 'active' AND l.listing_kind = 'prodej' AND l.price IS NOT NULL
    AND l.size_m2 IS NOT NULL AND l.size_m2 > 0 {extra}),
today AS (
  SELECT group_key, count(*) AS n, avg(price) AS avg_price, min(price) AS min_price,
         max(price) AS max_price, avg(price / size_m2) AS avg_ppm2,
         quantile_cont(price / size_m2, 0.5) AS median_ppm2, avg(lat) AS lat, avg(lon) AS lon
  FROM active GROUP BY group_key),
known AS (
  SELECT listing_id, arg_max(price, observed_at) AS price FROM v
  WHERE observed_at <= {AS_OF_SQL} - INTERVAL 180 DAY AND price IS NOT NULL GROUP BY listing_id),
past AS (
  SELECT group_key, quantile_cont(coalesce(known.price, a.price) / a.size_m2, 0.5) AS median_ppm2_then
  FROM active a LEFT JOIN known USING (listing_id)
  WHERE a.first_seen_at <= {AS_OF_SQL} - INTERVAL 180 DAY GROUP BY group_key)
SELECT group_key, n, round(avg_price + 1.3e-7, 4) AS avg_price, round(min_price + 1.3e-7, 4) AS min_price,
       round(max_price + 1.3e-7, 4) AS max_price, round(avg_ppm2 + 1.3e-7, 4) AS avg_ppm2,
       round(median_ppm2 + 1.3e-7, 4) AS median_ppm2, round(lat + 1.3e-7, 4) AS lat, round(lon + 1.3e-7, 4) AS lon,
       round(median_ppm2_then + 1.3e-7, 4) AS median_ppm2_then,
       round(CASE WHEN median_ppm2_then > 0
             THEN (median_ppm2 - median_ppm2_then) / median_ppm2_then * 100 END + 1.3e-7, 4) AS change_pct
FROM today LEFT JOIN past USING (group_key)
"""


def _breakdown(group_by: str, **criteria):
    def run(spark, sf_dir):
        return rounded(
            an.breakdown(
                ad.listings(spark, sf_dir), ad.properties(spark, sf_dir),
                versions(spark, sf_dir), group_by, as_of(), **criteria,
            ), 4,
        )

    return run


query("A1_A2_J7_breakdown_by_disposition", _breakdown_sql("disposition"))(_breakdown("disposition"))
query("A1_A2_F12_breakdown_by_locality", _breakdown_sql("locality"))(_breakdown("locality"))
query("A1_A2_J1_breakdown_by_district", _breakdown_sql("city_district"))(_breakdown("city_district"))
query(
    "F3_breakdown_filtered",
    _breakdown_sql(
        "disposition",
        "AND p.city_district = 'Praha 5' AND l.ownership_type = 'A' AND l.price >= 2000 "
        "AND l.size_m2 <= 150",
    ),
)(_breakdown("disposition", city_district="Praha 5", ownership_type="A", min_price=2000, max_size=150))


@query(
    "T5_top_groups_on_map",
    f"""
WITH l AS ({L}), p AS ({P})
SELECT coalesce(p.locality, '(neuvedeno)') AS group_key, count(*) AS n
FROM l LEFT JOIN p ON p.property_id = l.property_id
WHERE l.status = 'active' AND l.listing_kind = 'prodej' AND l.size_m2 > 0
GROUP BY 1 HAVING avg(lat) IS NOT NULL ORDER BY n DESC, group_key LIMIT 12""",
)
def _top_groups(spark, sf_dir):
    pop = an.breakdown_population(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), "locality")
    groups = pop.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
    return an.top_groups(groups, 12).select("group_key", "n")


@query(
    "A3_yield_by_district",
    f"""
WITH l AS ({L}), p AS ({P}),
active AS (SELECT coalesce(p.city_district, '(neuvedeno)') AS city_district, listing_kind, lat, lon,
                  price / size_m2 AS ppm2
           FROM l LEFT JOIN p ON p.property_id = l.property_id
           WHERE status = 'active' AND price IS NOT NULL AND size_m2 > 0
             AND listing_kind IN ('prodej', 'pronajem')),
g AS (SELECT city_district, count(*) FILTER (WHERE listing_kind = 'prodej') AS sale_count,
        count(*) FILTER (WHERE listing_kind = 'pronajem') AS rent_count,
        quantile_cont(ppm2, 0.5) FILTER (WHERE listing_kind = 'prodej') AS s,
        quantile_cont(ppm2, 0.5) FILTER (WHERE listing_kind = 'pronajem') AS r,
        avg(lat) AS lat, avg(lon) AS lon
      FROM active GROUP BY city_district)
SELECT city_district, sale_count, rent_count, round(lat + 1.3e-7, 4) AS lat, round(lon + 1.3e-7, 4) AS lon,
       round(s + 1.3e-7, 4) AS sale_median_ppm2, round(r + 1.3e-7, 4) AS rent_median_ppm2,
       round(CASE WHEN sale_count >= 5 AND rent_count >= 5 AND s > 0 THEN r * 12 / s * 100 END + 1.3e-7, 4) AS yield_pct
FROM g""",
)
def _yield(spark, sf_dir):
    return rounded(an.yield_by_district(ad.listings(spark, sf_dir), ad.properties(spark, sf_dir)), 4)


def _stats_sql(source: str, keys: str) -> str:
    """Statistics of ``ppm2`` per group of ``source``, with the 10 % symmetric trim."""
    return f"""
SELECT {keys}, count(*) AS n_samples, round(quantile_cont(ppm2, 0.5) + 1.3e-7, 4) AS median,
       round(quantile_cont(ppm2, 0.25) + 1.3e-7, 4) AS p25, round(quantile_cont(ppm2, 0.75) + 1.3e-7, 4) AS p75,
       round(stddev_pop(ppm2) + 1.3e-7, 4) AS stddev,
       round(avg(ppm2) FILTER (WHERE rn > floor(cnt * 0.1) AND rn <= cnt - floor(cnt * 0.1)) + 1.3e-7, 4) AS trimmed_mean
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ppm2) AS rn,
             count(*) OVER (PARTITION BY {keys}) AS cnt
      FROM {source} WHERE ppm2 > 0)
GROUP BY {keys}"""


STAT_COLUMNS = ["n_samples", "median", "p25", "p75", "stddev", "trimmed_mean"]


@query(
    "A4_W4_segment_price_stats",
    f"""WITH l AS (SELECT disposition, ownership_type, building_type, price / size_m2 AS ppm2 FROM ({L}))
{_stats_sql("l", "disposition, ownership_type, building_type")}""",
)
def _segment_stats(spark, sf_dir):
    keys = ["disposition", "ownership_type", "building_type"]
    rows = ad.listings(spark, sf_dir).select(
        *keys, s.ppm2(F.col("price"), F.col("size_m2")).alias("ppm2")
    )
    return rounded(seg.segment_stats(rows, keys).select(*keys, *STAT_COLUMNS), 4)


SIZE_SQL = """CASE WHEN size_m2 IS NULL OR size_m2 <= 0 THEN 'unknown' WHEN size_m2 < 35 THEN '<35'
 WHEN size_m2 < 50 THEN '35-50' WHEN size_m2 < 70 THEN '50-70' WHEN size_m2 < 90 THEN '70-90'
 WHEN size_m2 < 120 THEN '90-120' WHEN size_m2 < 160 THEN '120-160' ELSE '>160' END"""
COND_SQL = """CASE condition WHEN 'novostavba' THEN 'new' WHEN 'projekt' THEN 'new'
 WHEN 'velmi_dobry' THEN 'very_good' WHEN 'po_rekonstrukci' THEN 'very_good' WHEN 'dobry' THEN 'good'
 WHEN 'pred_rekonstrukci' THEN 'needs_work' WHEN 'v_rekonstrukci' THEN 'needs_work'
 WHEN 'spatny' THEN 'ruin' ELSE 'unknown' END"""
WIDE_SIZE = """CASE WHEN {0} IN ('<35', '35-50') THEN '<50' WHEN {0} IN ('50-70', '70-90') THEN '50-90'
 WHEN {0} IN ('90-120', '120-160') THEN '90-160' WHEN {0} = '>160' THEN '>160' ELSE 'unknown' END"""
WIDE_COND = "CASE WHEN {0} IN ('unknown', 'ruin') THEN {0} ELSE 'any_habitable' END"
CITY = "CASE WHEN lower({0}) LIKE 'praha%' THEN 'Praha' ELSE {0} END"

# Base segments of the active sale listings with a district, and their six relaxed forms.
BASE_SQL = f"""
SELECT p.city_district AS d, disposition AS disp, ownership_type AS own, building_type AS bld,
       {SIZE_SQL} AS sz, {COND_SQL} AS cond, price, size_m2, price / size_m2 AS ppm2, l.first_seen_at, l.last_seen_at
FROM ({L}) l JOIN ({P}) p ON p.property_id = l.property_id
WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY"""


def level_select(level: int, source: str) -> str:
    size = WIDE_SIZE.format("sz") if level >= 1 else "sz"
    cond = WIDE_COND.format("cond") if level >= 2 else "cond"
    bld = "NULL" if level >= 3 else "bld"
    dist = CITY.format("d") if level >= 4 else "d"
    disp = "NULL" if level >= 5 else "disp"
    return (
        f"SELECT *, {level} AS level, concat_ws('|', coalesce({dist}, '~'), coalesce({disp}, '~'), "
        f"coalesce(own, '~'), coalesce({bld}, '~'), {size}, {cond}) AS rkey FROM {source}"
    )


def ladder_sql(base: str, min_n: int = 30) -> str:
    levels = " UNION ALL ".join(level_select(i, "keys") for i in range(6))
    rows = " UNION ALL ".join(level_select(i, "base") for i in range(6))
    return f"""
WITH base AS ({base}),
keys AS (SELECT DISTINCT d, disp, own, bld, sz, cond FROM base WHERE ppm2 > 0),
key_levels AS ({levels}),
row_levels AS ({rows}),
stats AS ({_stats_sql("row_levels", "level, rkey")}),
first_level AS (
  SELECT k.d, k.disp, k.own, k.bld, k.sz, k.cond, min(k.level) AS lv
  FROM key_levels k JOIN stats s USING (level, rkey) WHERE s.n_samples >= {min_n} GROUP BY ALL),
resolved AS (
  SELECT k.d, k.disp, k.own, k.bld, k.sz, k.cond, f.lv AS relaxation_level, kl.rkey
  FROM keys k LEFT JOIN first_level f ON (k.d, k.disp, k.own, k.bld, k.sz, k.cond) = (f.d, f.disp, f.own, f.bld, f.sz, f.cond)
  LEFT JOIN key_levels kl ON (k.d, k.disp, k.own, k.bld, k.sz, k.cond) = (kl.d, kl.disp, kl.own, kl.bld, kl.sz, kl.cond)
       AND kl.level = f.lv)
SELECT r.d AS city_district, r.disp AS disposition, r.own AS ownership_type, r.bld AS building_type,
       r.sz AS size_bucket, r.cond AS condition_bucket, r.relaxation_level, s.n_samples, s.median, s.p25,
       s.p75, s.stddev, s.trimmed_mean
FROM resolved r LEFT JOIN stats s ON s.level = r.relaxation_level AND s.rkey = r.rkey"""


def active_population(spark, sf_dir):
    from parcelwise.plans.search import scoring_population

    return scoring_population(
        ad.listings(spark, sf_dir), ad.properties(spark, sf_dir), as_of(), city_prefix=""
    )


@query("A5_J15_G2_G3_relaxation_ladder", ladder_sql(BASE_SQL))
def _ladder(spark, sf_dir):
    stats = seg.relaxed_stats(active_population(spark, sf_dir))
    parts = ["city_district", "disposition", "ownership_type", "building_type", "size_bucket",
             "condition_bucket"]
    return rounded(
        stats.select(*[F.col(f"segment.{p}").alias(p) for p in parts], "relaxation_level",
                     *STAT_COLUMNS), 4,
    )

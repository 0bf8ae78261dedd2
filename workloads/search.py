"""Search, detail and list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions import scoring as s
from parcelwise.operators.history import history_of
from parcelwise.plans import search
from workloads.registry import AS_OF_SQL, VERSIONS, L, P, as_of, query, versions

SOURCES = {1: "portal"}
SLUG = "CASE source_id WHEN 1 THEN 'portal' ELSE 'unknown' END"


def _lp(spark, sf_dir):
    return ad.listings(spark, sf_dir), ad.properties(spark, sf_dir)


SUMMARY = (
    f"listing_id, {SLUG} AS source_slug, property_type, disposition, ownership_type, building_type, condition, "
    "size_m2, price, locality, city_district, status, lat, lon"
)


@query(
    "F1_T1_search_page_newest_first",
    f"""WITH l AS ({L}), p AS ({P})
SELECT {SUMMARY} FROM l LEFT JOIN p USING (property_id)
WHERE status = 'active' AND disposition = 'PROMO' AND price >= 0 AND price <= 60000 AND size_m2 >= 20
ORDER BY last_seen_at DESC, listing_id LIMIT 50 OFFSET 25""",
)
def _page(spark, sf_dir):
    return search.search(
        *_lp(spark, sf_dir), SOURCES, limit=50, offset=25, disposition="PROMO", property_type="",
        min_price=0, max_price=60000, min_size=20,
    )


@query(
    "F1_J2_search_by_district_and_locality",
    f"""WITH l AS ({L}), p AS ({P})
SELECT {SUMMARY} FROM l JOIN p USING (property_id)
WHERE status = 'active' AND city_district = 'Praha 2' AND locality IN ('obec 2', 'obec 12')
  AND locality = 'obec 2' ORDER BY last_seen_at DESC, listing_id LIMIT 200""",
)
def _district(spark, sf_dir):
    return search.search(*_lp(spark, sf_dir), SOURCES, limit=200, city_district="Praha 2",
                         locality="obec 2")


@query(
    "A6_count_of_matches",
    f"""WITH l AS ({L}), p AS ({P})
SELECT count(*) AS total FROM l JOIN p USING (property_id)
WHERE status = 'active' AND ownership_type = 'R' AND city_district = 'Praha 5' AND size_m2 <= 120""",
)
def _count(spark, sf_dir):
    return search.count_matches(*_lp(spark, sf_dir), ownership_type="R", city_district="Praha 5",
                                max_size=120)


@query(
    "F2_scoring_population",
    f"""WITH l AS ({L}), p AS ({P})
SELECT listing_id, city_district FROM l JOIN p USING (property_id)
WHERE status = 'active' AND last_seen_at >= {AS_OF_SQL} - INTERVAL 90 DAY AND city_district ILIKE 'praha%'""",
)
def _population(spark, sf_dir):
    return search.scoring_population(*_lp(spark, sf_dir), as_of(), "praha").select(
        "listing_id", "city_district"
    )


@query(
    "F7_F10_J1_J14_listing_summaries",
    f"""WITH l AS ({L}), p AS (SELECT * FROM ({P}) WHERE city_district <> 'Brno')
SELECT listing_id, {SLUG} AS source_slug, city_district, lat, lon FROM l LEFT JOIN p USING (property_id)""",
)
def _summaries(spark, sf_dir):
    l, p = _lp(spark, sf_dir)
    joined = search.with_property(l, p.where(F.col("city_district") != "Brno"))
    return search.with_source_slug(joined, SOURCES).select(
        "listing_id", "source_slug", "city_district", "lat", "lon"
    )


@query(
    "F4_J2_places_in_box",
    f"""SELECT property_id, lat, lon FROM ({P}) WHERE lat BETWEEN 49.95 AND 50.1 AND lon BETWEEN 14.25 AND 14.6""",
)
def _box(spark, sf_dir):
    from parcelwise.functions.geo import in_box

    return ad.properties(spark, sf_dir).where(
        in_box(F.col("lat"), F.col("lon"), (49.95, 50.1, 14.25, 14.6))
    ).select("property_id", "lat", "lon")


def _photos(listings):
    """As many photo rows as a listing counts, last ordinal first."""
    return listings.where(F.col("photo_count") > 0).select(
        "listing_id", F.explode(F.reverse(F.sequence(F.lit(0), F.col("photo_count") - 1))).alias("ord")
    ).select(
        "listing_id", "ord", F.concat(F.lit("u"), F.col("ord").cast("string")).alias("url_source"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
    )


@query(
    "F8_T6_listing_detail_with_photos",
    f"""WITH l AS ({L}), p AS ({P}), one AS (SELECT * FROM l WHERE photo_count > 2 ORDER BY listing_id LIMIT 1)
SELECT listing_id, city_district, description,
       (SELECT string_agg('u' || i, ',' ORDER BY i) FROM range(photo_count) r(i)) AS photo_urls
FROM one LEFT JOIN p USING (property_id)""",
)
def _detail(spark, sf_dir):
    l, p = _lp(spark, sf_dir)
    wanted = l.where(F.col("photo_count") > 2).agg(F.min("listing_id")).head()[0]
    return search.detail(l, p, _photos(l), wanted).select(
        "listing_id", "city_district", "description",
        F.array_join(F.transform("photos", lambda x: x["url_source"]), ",").alias("photo_urls"),
    )


@query(
    "J3_A8_photo_counts",
    f"SELECT listing_id, photo_count FROM ({L})",
)
def _photo_counts(spark, sf_dir):
    l = ad.listings(spark, sf_dir)
    return search.with_photo_count(l.select("listing_id"), _photos(l)).select(
        "listing_id", "photo_count"
    )


@query(
    "F9_known_feature_toggles",
    f"""SELECT listing_id, concat_ws(',', CASE WHEN has_lift THEN 'has_lift=true' WHEN NOT has_lift THEN 'has_lift=false' END,
 CASE WHEN has_balcony THEN 'has_balcony=true' ELSE 'has_balcony=false' END) AS toggles, has_lift FROM ({L})""",
)
def _toggles(spark, sf_dir):
    features = F.create_map(F.lit("has_lift"), F.col("has_lift"), F.lit("has_balcony"), F.col("has_balcony"))
    kept = ad.listings(spark, sf_dir).select("listing_id", search.feature_flags(features).alias("f"))
    text = F.transform(
        F.map_entries("f"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return kept.select("listing_id", F.array_join(text, ",").alias("toggles"),
                       F.col("f")["has_lift"].alias("has_lift"))


def _scored(spark, sf_dir):
    """Listings with plain derived score columns."""
    l, p = _lp(spark, sf_dir)
    df = search.with_property(l, p)
    return df.select(
        "listing_id", "status", "price", "size_m2", "disposition", "city_district", "first_seen_at",
        (F.col("floor_current") * 7 - 25).cast("double").alias("undervaluation_pct"),
        (F.col("size_m2") / 200).alias("confidence_score"),
        (F.col("price") / 1100).alias("composite"),
        F.array_compact(F.array(
            F.when(s.legal_encumbrance(F.col("description")), F.lit("legal_encumbrance")),
            F.when(s.poor_energy(F.col("energy_class")), F.lit("class_g_energy")),
        )).alias("risk_flags"),
    ).withColumn("risk_score", s.risk_score(F.col("risk_flags")))


SCORED = f"""SELECT *, floor_current * 7 - 25 AS undervaluation_pct, size_m2 / 200 AS confidence_score,
 price / 1100 AS composite, description LIKE '%EXEKUCE%' AS f1, energy_class IN ('F', 'G') AS f2
FROM ({L}) LEFT JOIN ({P}) USING (property_id)"""


@query(
    "F13_extended_search",
    f"""WITH s AS ({SCORED}) SELECT listing_id FROM s
WHERE status = 'active' AND disposition IN ('PROMO', 'LARGE') AND price / size_m2 >= 300 AND price / size_m2 <= 900
  AND undervaluation_pct >= -5 AND confidence_score >= 0.3 AND NOT f1
  AND (CASE WHEN f1 THEN 3 ELSE 0 END + CASE WHEN f2 THEN 1 ELSE 0 END) / 8.0 * 100 <= 20""",
)
def _extended(spark, sf_dir):
    return _scored(spark, sf_dir).where(
        search.listing_filter(
            disposition=["PROMO", "LARGE"], min_ppm2=300, max_ppm2=900, min_undervaluation_pct=-5,
            min_confidence=0.3, exclude_flags=["legal_encumbrance"], max_risk_score=20,
        )
    ).select("listing_id")


@query(
    "T8_sort_modes_undervaluation",
    f"""WITH s AS ({SCORED}) SELECT listing_id, undervaluation_pct FROM s
ORDER BY undervaluation_pct DESC NULLS LAST, listing_id LIMIT 50""",
)
def _sorted(spark, sf_dir):
    return search.ranked(_scored(spark, sf_dir), "undervaluation_desc").select(
        "listing_id", "undervaluation_pct"
    )


@query(
    "T8_top_opportunities",
    f"""WITH s AS ({SCORED}) SELECT listing_id FROM s WHERE composite > 60 AND confidence_score > 0.6
ORDER BY composite DESC, listing_id LIMIT 10""",
)
def _top(spark, sf_dir):
    return search.top_opportunities(_scored(spark, sf_dir), 60.0).select("listing_id")


@query(
    "T9_change_history_of_one_listing",
    f"""WITH v AS ({VERSIONS}), one AS (SELECT min(listing_id) AS listing_id FROM v)
SELECT listing_id, strftime(observed_at, '%Y-%m-%d') AS observed_on, round(price, 4) AS price
FROM v JOIN one USING (listing_id)""",
)
def _history(spark, sf_dir):
    v = versions(spark, sf_dir)
    one = v.agg(F.min("listing_id")).head()[0]
    return history_of(v, one).select(
        "listing_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed_on"),
        F.round("price", 4).alias("price"),
    )

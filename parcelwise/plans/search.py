"""Listing search, detail and map queries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.functions import scoring as s
from parcelwise.functions.keys import all_of, fixed_map

MAX_PINS = 500
CLUSTER_BELOW_ZOOM = 13


def listing_filter(
    *,
    status: str | None = "active",
    listing_kind: str | None = None,
    property_type: str | None = None,
    disposition: str | Sequence[str] | None = None,
    ownership_type: str | None = None,
    city_district: str | None = None,
    locality: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_size: float | None = None,
    max_size: float | None = None,
    min_ppm2: float | None = None,
    max_ppm2: float | None = None,
    min_undervaluation_pct: float | None = None,
    min_yield_pct: float | None = None,
    max_risk_score: float | None = None,
    min_confidence: float | None = None,
    exclude_flags: Iterable[str] = (),
) -> Column:
    """AND of the given criteria. Empty text means "not given"; the number 0 is a bound."""
    terms: list[Column] = []
    for name, wanted in {
        "status": status,
        "listing_kind": listing_kind,
        "property_type": property_type,
        "disposition": disposition,
        "ownership_type": ownership_type,
        "city_district": city_district,
        "locality": locality,
    }.items():
        if not wanted:
            continue
        col = F.col(name)
        terms.append(col == wanted if isinstance(wanted, str) else col.isin(list(wanted)))
    for name, low, high in [
        ("price", min_price, max_price),
        ("size_m2", min_size, max_size),
        ("undervaluation_pct", min_undervaluation_pct, None),
        ("yield_gross_pct", min_yield_pct, None),
        ("risk_score", None, max_risk_score),
        ("confidence_score", min_confidence, None),
    ]:
        if low is not None:
            terms.append(F.col(name) >= low)
        if high is not None:
            terms.append(F.col(name) <= high)
    value = s.ppm2(F.col("price"), F.col("size_m2"))
    if min_ppm2 is not None:
        terms.append(value >= min_ppm2)
    if max_ppm2 is not None:
        terms.append(value <= max_ppm2)
    banned = list(exclude_flags)
    if banned:
        hit = F.arrays_overlap(F.col("risk_flags"), F.array(*[F.lit(f) for f in banned]))
        terms.append(~F.coalesce(hit, F.lit(False)))
    return all_of(terms)


def scoring_population(listings: DataFrame, properties: DataFrame, as_of: Column,
                       city_prefix: str = "Praha", lookback_days: int = 90) -> DataFrame:
    """Active listings seen lately in the districts starting with the prefix."""
    pattern = city_prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    recent = listings.where(
        (F.col("status") == "active")
        & (F.col("last_seen_at") >= as_of - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    )
    return recent.join(
        properties.where(F.col("city_district").ilike(pattern)), "property_id"
    )


def with_property(listings: DataFrame, properties: DataFrame, how: str = "left") -> DataFrame:
    return listings.join(properties, "property_id", how)


def with_source_slug(listings: DataFrame, sources: dict[int, str]) -> DataFrame:
    """Name of the feed, 'unknown' for an unregistered id. The register is a handful of rows
    known on the driver, so it is a literal, not a join."""
    named = fixed_map(sources)[F.col("source_id")] if sources else F.lit(None)
    return listings.withColumn("source_slug", F.coalesce(named, F.lit("unknown")))


SUMMARY_COLUMNS = [
    "listing_id", "source_slug", "canonical_url", "property_type", "disposition",
    "ownership_type", "building_type", "condition", "size_m2", "price", "locality",
    "city_district", "status", "lat", "lon",
]


def search(
    listings: DataFrame,
    properties: DataFrame,
    sources: dict[int, str],
    limit: int = 50,
    offset: int = 0,
    **criteria,
) -> DataFrame:
    """One page, newest first (ties by listing id). The property is joined before paging only
    when a criterion reads it; otherwise the page is cut first and 200 rows at most are joined."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset >= 0")
    on_property = {"city_district", "locality"} & {k for k, v in criteria.items() if v}
    order = [F.desc("last_seen_at"), F.asc("listing_id")]
    page = listings
    if on_property:
        page = with_property(page, properties)
    page = page.where(listing_filter(**criteria)).orderBy(*order).offset(offset).limit(limit)
    if not on_property:
        page = with_property(page, properties).orderBy(*order)
    page = with_source_slug(page, sources)
    return page.select(*[c for c in SUMMARY_COLUMNS if c in page.columns])


def count_matches(listings: DataFrame, properties: DataFrame, **criteria) -> DataFrame:
    on_property = {"city_district", "locality"} & {k for k, v in criteria.items() if v}
    df = with_property(listings, properties) if on_property else listings
    return df.where(listing_filter(**criteria)).agg(F.count(F.lit(1)).alias("total"))


def photos_per_listing(photos: DataFrame) -> DataFrame:
    return photos.groupBy("listing_id").agg(F.count(F.lit(1)).alias("photo_count"))


def with_photo_count(listings: DataFrame, photos: DataFrame, fill_zero: bool = False) -> DataFrame:
    """Photo count per listing; NULL without photos unless ``fill_zero``."""
    out = listings.join(photos_per_listing(photos), "listing_id", "left")
    return out.fillna(0, ["photo_count"]) if fill_zero else out


def detail(
    listings: DataFrame, properties: DataFrame, photos: DataFrame, listing_id
) -> DataFrame:
    """One listing with its property and its photos in order; no rows for an unknown id."""
    one = listings.where(F.col("listing_id") == listing_id)
    pics = (
        photos.where(F.col("listing_id") == listing_id)
        .groupBy("listing_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "url_source", "width", "height")))
             .alias("photos"))
    )
    empty = F.array().cast("array<struct<ord:int,url_source:string,width:int,height:int>>")
    return (
        with_property(one, properties)
        .join(pics, "listing_id", "left")
        .withColumn("photos", F.coalesce(F.col("photos"), empty))
    )


def feature_flags(features: Column) -> Column:
    """Only the toggles that are known."""
    return F.map_filter(features, lambda _, v: v.isNotNull())


def map_eps(zoom: int) -> float:
    """Clustering distance in degrees for a zoom level."""
    return 0.08 / 2 ** max(0, zoom - 6)


def map_pins(
    listings: DataFrame, properties: DataFrame, box: tuple[float, float, float, float],
    status: str = "active",
) -> DataFrame:
    """The newest 500 listings in the (south, north, west, east) box."""
    inside = properties.where(geo.in_box(F.col("lat"), F.col("lon"), box))
    return (
        listings.where(F.col("status") == status)
        .join(inside, "property_id")
        .orderBy(F.desc("last_seen_at"), F.asc("listing_id"))
        .limit(MAX_PINS)
        .select("listing_id", "lat", "lon", "price", "disposition")
    )


def map_clusters(
    listings: DataFrame, properties: DataFrame, box: tuple[float, float, float, float],
    zoom: int, status: str = "active",
) -> DataFrame:
    """Clusters of the listings in the box: count and mean position, duplicates counted."""
    from parcelwise.operators.clusters import cluster_centroids

    inside = properties.where(geo.in_box(F.col("lat"), F.col("lon"), box))
    points = (
        listings.where(F.col("status") == status)
        .groupBy("property_id")
        .agg(F.count(F.lit(1)).alias("weight"))
        .join(inside.select("property_id", "lat", "lon"), "property_id")
    )
    return cluster_centroids(points, map_eps(zoom), x="lon", y="lat", weight="weight")


def map_view(listings, properties, box, zoom: int, status: str = "active") -> DataFrame:
    """Clusters below zoom 13, pins from there on."""
    if zoom < CLUSTER_BELOW_ZOOM:
        return map_clusters(listings, properties, box, zoom, status)
    return map_pins(listings, properties, box, status)


SORTS = {
    "composite_desc": [("composite", True)],
    "undervaluation_desc": [("undervaluation_pct", True)],
    "price_asc": [("price", False)],
    "listing_date_desc": [("first_seen_at", True)],
}


def ranked(scored: DataFrame, sort: str = "composite_desc", limit: int = 50) -> DataFrame:
    """Spec-only: the top of a scored table in one of the allowed orders."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last()
             for c, down in SORTS[sort]]
    return scored.orderBy(*order, F.asc("listing_id")).limit(limit)


def top_opportunities(scored: DataFrame, min_composite: float, min_confidence: float = 0.6,
                      limit: int = 10) -> DataFrame:
    """Spec-only: best scores above both thresholds."""
    keep = (F.col("composite") > min_composite) & (F.col("confidence_score") > min_confidence)
    return ranked(scored.where(keep), "composite_desc", limit)

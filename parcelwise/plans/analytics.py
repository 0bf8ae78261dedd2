"""Breakdown, price change and rental yield."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.history import price_as_of
from parcelwise.operators.order_stats import order_stats
from parcelwise.plans.search import listing_filter, with_property
from parcelwise.session import materialize

UNSTATED = "(neuvedeno)"
GROUPINGS = ("disposition", "locality", "city_district")


def breakdown_population(
    listings: DataFrame, properties: DataFrame, group_by: str, listing_kind: str = "prodej",
    **criteria,
) -> DataFrame:
    if group_by not in GROUPINGS:
        raise ValueError(f"group_by must be one of {GROUPINGS}")
    priced = listings.where(
        F.col("price").isNotNull() & F.col("size_m2").isNotNull() & (F.col("size_m2") > 0)
    )
    joined = with_property(priced, properties).where(
        listing_filter(listing_kind=listing_kind, **criteria)
    )
    return joined.select(
        F.coalesce(F.col(group_by), F.lit(UNSTATED)).alias("group_key"),
        "listing_id", "price", "size_m2", "first_seen_at", "lat", "lon",
        (F.col("price") / F.col("size_m2")).alias("ppm2"),
        F.col("lat").isNotNull().cast("long").alias("located"),
    )


# Mean position of a group's members, from sums that combine like any other.
CENTROID_SUMS = {"__lat": ("lat", "sum"), "__lon": ("lon", "sum"), "__at": ("located", "sum")}


def _centroid() -> list[Column]:
    members = F.nullif(F.col("__at"), F.lit(0))
    return [(F.col(f"__{c}") / members).alias(c) for c in ("lat", "lon")]


def breakdown(
    listings: DataFrame, properties: DataFrame, versions: DataFrame, group_by: str,
    as_of: Column, days_ago: int = 180, **criteria,
) -> DataFrame:
    """Per group: counts, prices, price per m2, centroid and the change of the median against
    ``days_ago`` days before ``as_of``; largest groups first."""
    active = materialize(breakdown_population(listings, properties, group_by, **criteria))
    now = order_stats(
        active, ["group_key"], "ppm2", {"median_ppm2": 0.5},
        extra={
            "__price": ("price", "sum"),
            "min_price": ("price", "min"),
            "max_price": ("price", "max"),
            **CENTROID_SUMS,
        },
    ).select(
        "group_key",
        F.col("n_samples").alias("n"),
        (F.col("__price") / F.col("n_samples")).alias("avg_price"),
        "min_price",
        "max_price",
        F.col("mean").alias("avg_ppm2"),
        "median_ppm2",
        *_centroid(),
    )
    cut = as_of - F.expr(f"INTERVAL {int(days_ago)} DAYS")
    then = price_as_of(
        active.where(F.col("first_seen_at") <= cut).select(
            "group_key", "listing_id", "price", "size_m2"
        ),
        versions,
        cut,
    ).select("group_key", (F.col("price_then") / F.col("size_m2")).alias("ppm2_then"))
    past = order_stats(
        materialize(then), ["group_key"], "ppm2_then", {"median_ppm2_then": 0.5},
    ).select("group_key", "median_ppm2_then")
    m, t = F.col("median_ppm2"), F.col("median_ppm2_then")
    return (
        now.join(past, "group_key", "left")
        .withColumn("change_pct", F.when(t > 0, (m - t) / F.when(t > 0, t) * 100))
        .orderBy(F.desc("n"), F.asc("group_key"))
    )


def yield_by_district(
    listings: DataFrame, properties: DataFrame, min_sale: int = 5, min_rent: int = 5
) -> DataFrame:
    """Gross yearly rent over sale price per district; NULL where either side is thin."""
    active = materialize(
        with_property(
            listings.where(
                (F.col("status") == "active")
                & F.col("price").isNotNull()
                & (F.col("size_m2") > 0)
                & F.col("listing_kind").isin("prodej", "pronajem")
            ),
            properties,
        ).select(
            F.coalesce(F.col("city_district"), F.lit(UNSTATED)).alias("city_district"),
            "listing_kind", "lat", "lon",
            (F.col("price") / F.col("size_m2")).alias("ppm2"),
            F.col("lat").isNotNull().cast("long").alias("located"),
        )
    )
    sides = order_stats(
        active, ["city_district", "listing_kind"], "ppm2", {"med": 0.5},
        extra=CENTROID_SUMS,
    )
    sale, rent = F.col("listing_kind") == "prodej", F.col("listing_kind") == "pronajem"
    plain = sides.groupBy("city_district").agg(
        F.coalesce(F.sum(F.when(sale, F.col("n_samples"))), F.lit(0)).alias("sale_count"),
        F.coalesce(F.sum(F.when(rent, F.col("n_samples"))), F.lit(0)).alias("rent_count"),
        F.max(F.when(sale, F.col("med"))).alias("sale_median_ppm2"),
        F.max(F.when(rent, F.col("med"))).alias("rent_median_ppm2"),
        *[F.sum(c).alias(c) for c in CENTROID_SUMS],
    )
    s, r = F.col("sale_median_ppm2"), F.col("rent_median_ppm2")
    enough = (F.col("sale_count") >= min_sale) & (F.col("rent_count") >= min_rent) & (s > 0)
    return (
        plain.withColumn("yield_pct", F.when(enough, r * 12 / F.when(s > 0, s) * 100))
        .select(
            "city_district", "sale_count", "rent_count", "sale_median_ppm2", "rent_median_ppm2",
            "yield_pct", *_centroid(),
        )
        .orderBy(F.desc(F.col("sale_count") + F.col("rent_count")), F.asc("city_district"))
    )


def top_groups(groups: DataFrame, n: int) -> DataFrame:
    """The largest groups that can be placed on a map."""
    return (
        groups.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .orderBy(F.desc("n"), F.asc("group_key"))
        .limit(n)
    )

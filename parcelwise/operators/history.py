"""Histories: latest rows, as-of prices, changed payloads, change records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.scoring import PUBLIC_CONFIDENCE
from parcelwise.operators.ordered import with_previous
from parcelwise.operators.skew import latest_per_key


def price_as_of(listings: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """Add ``price_then``: the last known price observed at or before ``at``, else today's."""
    known = (
        versions.where((F.col("observed_at") <= at) & F.col("price").isNotNull())
        .groupBy("listing_id")
        .agg(F.max_by("price", "observed_at").alias("__then"))
    )
    return (
        listings.join(known, "listing_id", "left")
        .withColumn("price_then", F.coalesce(F.col("__then"), F.col("price")))
        .drop("__then")
    )


def latest_scores(scores: DataFrame, per_model: bool = False) -> DataFrame:
    """Newest score per listing (and model version when asked)."""
    keys = ["listing_id", "model_version"] if per_model else ["listing_id"]
    return latest_per_key(scores, keys, ["computed_at", "model_version"])


def publicly_visible(scores: DataFrame, include_low_confidence: bool = False) -> DataFrame:
    """Hide scores of low or unknown confidence."""
    if include_low_confidence:
        return scores
    return scores.where(F.coalesce(F.col("confidence_score"), F.lit(0.0)) >= PUBLIC_CONFIDENCE)


def score_history(scores: DataFrame, listing_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """All scores of a listing, newest first, whatever their confidence."""
    return (
        scores.where(F.col("listing_id") == listing_id)
        .orderBy(F.desc("computed_at"), F.desc("model_version"))
        .offset(offset)
        .limit(limit)
    )


def score_history_page(scores: DataFrame, listing_id, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a listing's history, every row with ``total``, how many scores the listing has."""
    mine = scores.where(F.col("listing_id") == listing_id)
    counted = mine.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("listing_id")))
    return score_history(counted, listing_id, limit, offset)


def shown_score(scores: DataFrame, include_low_confidence: bool = False, listing_id=None) -> DataFrame:
    """What a reader sees of each listing (or of one): its newest score, unless its confidence hides it.

    Hidden means no row; an older, surer score does not take the newest one's place.
    """
    mine = scores if listing_id is None else scores.where(F.col("listing_id") == listing_id)
    return score_view(publicly_visible(latest_scores(mine), include_low_confidence))


def score_view(scores: DataFrame) -> DataFrame:
    """Reading form of scores: missing flags are an empty list, missing components an empty map."""
    return scores.withColumn(
        "risk_flags", F.coalesce(F.col("risk_flags"), F.array().cast("array<string>"))
    ).withColumn(
        "components", F.coalesce(F.col("components"), F.create_map().cast("map<string,double>"))
    )


def latest_stats(stats: DataFrame) -> DataFrame:
    """Newest statistics row per segment."""
    return latest_per_key(stats, ["segment_id"], ["as_of_date"])


def changed_payloads(
    fetches: DataFrame, keys: Sequence[str] = ("source_slug", "source_listing_id"),
    at: str = "fetched_at", digest: str = "content_hash",
) -> DataFrame:
    """Add ``changed``: the payload differs from the previous fetch of the same listing."""
    prev = with_previous(fetches, list(keys), [at, digest], [digest])
    return prev.withColumn(
        "changed", F.coalesce(F.col(f"prev_{digest}") != F.col(digest), F.lit(True))
    ).drop(f"prev_{digest}")


def needs_fetch(refs: DataFrame, fetches: DataFrame, as_of: Column, max_age_s: int = 86400,
                keys: Sequence[str] = ("source_slug", "source_listing_id")) -> DataFrame:
    """References never fetched, or fetched more than ``max_age_s`` seconds before ``as_of``."""
    last = fetches.groupBy(*keys).agg(F.max("fetched_at").alias("__last"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp"))
    return (
        refs.join(last, list(keys), "left")
        .where(F.col("__last").isNull() | (age > max_age_s * 1_000_000))
        .drop("__last")
    )


TRACKED = ["price", "status", "description_hash", "photos_hash", "features"]


def change_records(
    snapshots: DataFrame, tracked: Sequence[str] = TRACKED, key: str = "listing_id",
    at: str = "observed_at", first_counts: bool = True,
) -> DataFrame:
    """Spec-only: one row per snapshot in which a tracked field differs from the one before,
    with ``fields_changed`` = array<struct<name, old, new>>."""
    prev = with_previous(snapshots.withColumn("__seen", F.lit(True)), [key], [at],
                           ["__seen", *tracked])
    diffs = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f).eqNullSafe(F.col(f"prev_{f}")),
                    F.struct(
                        F.lit(f).alias("name"),
                        F.col(f"prev_{f}").cast("string").alias("old"),
                        F.col(f).cast("string").alias("new"),
                    ),
                )
                for f in tracked
            ]
        )
    )
    is_first = F.col("prev___seen").isNull()
    keep = (is_first if first_counts else F.lit(False)) | (
        ~is_first & (F.size("fields_changed") > 0)
    )
    out = prev.withColumn("fields_changed", diffs).where(keep)
    return out.select(*snapshots.columns, "fields_changed")


def reactivations(snapshots: DataFrame, key: str = "listing_id", at: str = "observed_at",
                  gone: str = "withdrawn", back: str = "active") -> DataFrame:
    """Spec-only: snapshots in which a withdrawn listing is seen active again."""
    prev = with_previous(snapshots, [key], [at], ["status"])
    return prev.where((F.col("prev_status") == gone) & (F.col("status") == back)).drop(
        "prev_status"
    )


def fast_price_drops(versions: DataFrame, within_days: int = 14, cut: float = 0.05) -> DataFrame:
    """Spec-only: listings whose price fell by more than ``cut`` within the first days.

    Two plain aggregates: first price per listing, then the lowest price in the window."""
    priced = versions.where(F.col("price").isNotNull())
    first = priced.groupBy("listing_id").agg(
        F.min("observed_at").alias("first_at"),
        F.min_by("price", F.struct("observed_at", "price")).alias("first_price"),
    )
    inside = F.col("observed_at") <= F.col("first_at") + F.expr(f"INTERVAL {within_days} DAYS")
    return (
        priced.join(first, "listing_id")
        .where(inside)
        .groupBy("listing_id", "first_price")
        .agg(F.min("price").alias("lowest_price"))
        .where(F.col("lowest_price") < F.col("first_price") * (1 - cut))
    )


def history_of(versions: DataFrame, listing_id, newest_first: bool = True) -> DataFrame:
    """Spec-only: change history of one listing."""
    order = F.desc("observed_at") if newest_first else F.asc("observed_at")
    return versions.where(F.col("listing_id") == listing_id).orderBy(order)

"""Address registry: CSV scan, row parsing, projection, sanity gate and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions import geo
from parcelwise.functions import text as t
from parcelwise.sources.upserts import upsert_latest

# Column headers of the published address file.
COLUMNS = {
    "kod_adm": "Kód ADM",
    "kod_obce": "Kód obce",
    "nazev_obce": "Název obce",
    "nazev_momc": "Název MOMC",
    "nazev_casti_obce": "Název části obce",
    "nazev_ulice": "Název ulice",
    "cislo_domovni": "Číslo domovní",
    "cislo_orientacni": "Číslo orientační",
    "znak": "Znak čísla orientačního",
    "psc": "PSČ",
    "x": "Souřadnice X",
    "y": "Souřadnice Y",
}
# Generous bounding box of the country, (south, north, west, east).
COUNTRY_BOX = (48.5, 51.1, 12.0, 18.9)


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the ``;``-separated Windows-1250 file; fails when the key column is absent."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, sep=";", encoding="windows-1250", header=True, inferSchema=False)
    if COLUMNS["kod_adm"] not in df.columns:
        raise ValueError(f"address file lacks column {COLUMNS['kod_adm']!r}: {df.columns}")
    return df


def parse_registry(rows: DataFrame) -> DataFrame:
    """Usable addresses with WGS84 coordinates; rows without key or coordinates are dropped."""
    have = set(rows.columns)
    col = lambda k: (
        F.col(f"`{COLUMNS[k]}`") if COLUMNS[k] in have else F.lit(None).cast("string")
    )
    clean = lambda k: t.non_blank(col(k))
    flat = rows.select(
        clean("kod_adm").alias("kod_adm"),
        F.coalesce(clean("kod_obce"), F.lit("")).alias("kod_obce"),
        F.coalesce(clean("nazev_obce"), F.lit("")).alias("nazev_obce"),
        *[clean(k).alias(k) for k in ("nazev_momc", "nazev_casti_obce", "nazev_ulice", "cislo_domovni")],
        t.join_number_suffix(col("cislo_orientacni"), col("znak")).alias("cislo_orientacni"),
        clean("psc").alias("psc"),
        t.to_float_comma(col("x")).alias("x"),
        t.to_float_comma(col("y")).alias("y"),
    )
    usable = flat.where(
        F.col("kod_adm").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    return geo.with_wgs84(usable, "x", "y").drop("x", "y")


def count_skipped(rows: DataFrame) -> DataFrame:
    """One row: read, usable and skipped."""
    col = lambda k: F.col(f"`{COLUMNS[k]}`")
    ok = (
        t.non_blank(col("kod_adm")).isNotNull()
        & t.to_float_comma(col("x")).isNotNull()
        & t.to_float_comma(col("y")).isNotNull()
    )
    return rows.agg(
        F.count(F.lit(1)).alias("read"), F.count_if(ok).alias("usable"),
        F.count_if(~ok).alias("skipped"),
    )


def outside_share(
    addresses: DataFrame, box: tuple[float, float, float, float] = COUNTRY_BOX
) -> DataFrame:
    """Share of addresses that do not fall into the country."""
    inside = geo.in_box(F.col("lat"), F.col("lon"), box)
    return addresses.agg(F.avg(F.when(inside, 0.0).otherwise(1.0)).alias("outside_share"))


def check_projection(addresses: DataFrame, max_share: float = 0.10) -> DataFrame:
    """The addresses, or an error when too many lie abroad (swapped axes, wrong projection)."""
    share = outside_share(addresses).head()[0]
    if share is not None and share > max_share:
        raise ValueError(f"{share:.1%} of the projected addresses fall outside the country")
    return addresses


def upsert_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after the batch: incoming rows replace rows of the same key."""
    return upsert_latest(existing, incoming, ["kod_adm"])

"""Views of the benchmark tables in the shape of listings, properties and histories.

The tables come from an order-processing schema, so each view derives the columns an operator
needs by fixed formulas; nothing is sampled and no row is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def district_of(nation: Column) -> Column:
    d = nation % 10
    return (
        F.when(d == 0, "Praha 1").when(d <= 2, "Praha 2").when(d <= 5, "Praha 5").otherwise("Brno")
    )


def point_of(key: Column) -> tuple[Column, Column]:
    return 49.94 + (key * 37 % 240) / 1000, 14.22 + (key * 91 % 490) / 1000


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per order line; the supplier stands for the property."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    size = F.col("p_size")
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.col("l_quantity").cast("int"),
            ).alias("listing_id"),
            F.col("l_suppkey").alias("property_id"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("source_id"),
            F.col("o_orderdate").alias("first_seen_at"),
            F.col("l_shipdate").alias("last_seen_at"),
            F.when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("active").alias("status"),
            F.when(F.col("l_partkey") % 4 == 0, "pronajem").otherwise("prodej").alias("listing_kind"),
            F.lit("byt").alias("property_type"),
            F.col("p_type").alias("disposition"),
            F.col("l_returnflag").alias("ownership_type"),
            F.when(size <= 30, "panel").when(size <= 42, "cihla").when(size <= 48, "smisena")
            .otherwise("kamen").alias("building_type"),
            F.when(F.col("l_linenumber") == 1, "novostavba")
            .when(F.col("l_linenumber") == 2, "velmi_dobry")
            .when(F.col("l_linenumber") == 3, "po_rekonstrukci")
            .when(F.col("l_linenumber") == 4, "dobry")
            .when(F.col("l_linenumber") == 5, "pred_rekonstrukci")
            .when(F.col("l_linenumber") == 6, "spatny").alias("condition"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_quantity") * 4).alias("size_m2"),
            F.when(size < 49, 1900 + size * 2).alias("year_built"),
            F.col("l_linenumber").alias("floor_current"),
            (F.col("l_linenumber") + size % 3).alias("floor_total"),
            F.when(size % 4 == 0, F.lit(True)).when(size % 4 < 3, F.lit(False)).alias("has_lift"),
            F.substring(F.lit("ABCDEFG"), (size % 7 + 1), F.lit(1)).alias("energy_class"),
            F.when(size % 5 == 0, F.lit(True)).otherwise(F.lit(False)).alias("has_balcony"),
            F.when(size % 5 == 1, F.lit(True)).otherwise(F.lit(False)).alias("has_cellar"),
            F.when(size % 6 > 0, size % 6).alias("photo_count"),
            F.concat(
                F.col("p_name"),
                F.when(size % 6 == 0, ", EXEKUCE na majitele")
                .when(size % 6 == 1, ", po Revitalizaci")
                .when(size % 6 == 2, ", HAVARIJNÍ stav")
                .otherwise(", bez vad"),
            ).alias("description"),
        )
    )


# The same listing rows in DuckDB's dialect.
LISTINGS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS listing_id,
       l_suppkey AS property_id,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS source_id,
       o_orderdate AS first_seen_at, l_shipdate AS last_seen_at,
       CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' ELSE 'active' END AS status,
       CASE WHEN l_partkey % 4 = 0 THEN 'pronajem' ELSE 'prodej' END AS listing_kind,
       'byt' AS property_type, p_type AS disposition, l_returnflag AS ownership_type,
       CASE WHEN p_size <= 30 THEN 'panel' WHEN p_size <= 42 THEN 'cihla'
            WHEN p_size <= 48 THEN 'smisena' ELSE 'kamen' END AS building_type,
       CASE l_linenumber WHEN 1 THEN 'novostavba' WHEN 2 THEN 'velmi_dobry' WHEN 3 THEN 'po_rekonstrukci'
            WHEN 4 THEN 'dobry' WHEN 5 THEN 'pred_rekonstrukci' WHEN 6 THEN 'spatny' END AS condition,
       l_extendedprice AS price, l_quantity * 4 AS size_m2,
       CASE WHEN p_size < 49 THEN 1900 + p_size * 2 END AS year_built,
       l_linenumber AS floor_current, l_linenumber + p_size % 3 AS floor_total,
       CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 < 3 THEN false END AS has_lift,
       substring('ABCDEFG', p_size % 7 + 1, 1) AS energy_class,
       p_size % 5 = 0 AS has_balcony, p_size % 5 = 1 AS has_cellar,
       CASE WHEN p_size % 6 > 0 THEN p_size % 6 END AS photo_count,
       p_name || CASE p_size % 6 WHEN 0 THEN ', EXEKUCE na majitele' WHEN 1 THEN ', po Revitalizaci'
            WHEN 2 THEN ', HAVARIJNÍ stav' ELSE ', bez vad' END AS description
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""


def _property_columns(key: str, nation: str, name: str) -> list[Column]:
    lat, lon = point_of(F.col(key))
    return [
        F.col(key).alias("property_id"),
        lat.alias("lat"),
        lon.alias("lon"),
        district_of(F.col(nation)).alias("city_district"),
        F.when(F.col(nation) > 0, F.concat(F.lit("obec "), F.col(nation).cast("string"))).alias(
            "locality"
        ),
        F.col(name).alias("address_normalized"),
        F.when(F.col(nation) % 3 == 0, "rooftop")
        .when(F.col(nation) % 3 == 1, "source_gps")
        .alias("address_precision"),
        F.when(F.col(key) % 2 == 0, F.col(key).cast("string")).alias("ruian_address_code"),
    ]


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property per supplier."""
    return table(spark, sf_dir, "supplier").select(
        *_property_columns("s_suppkey", "s_nationkey", "s_name")
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One property per customer: a larger set of points for the spatial operators."""
    return table(spark, sf_dir, "customer").select(
        *_property_columns("c_custkey", "c_nationkey", "c_name")
    )


def _property_sql(key: str, nation: str, name: str, source: str) -> str:
    return f"""
SELECT {key} AS property_id, 49.94 + ({key} * 37 % 240) / 1000 AS lat,
       14.22 + ({key} * 91 % 490) / 1000 AS lon,
       CASE WHEN {nation} % 10 = 0 THEN 'Praha 1' WHEN {nation} % 10 <= 2 THEN 'Praha 2'
            WHEN {nation} % 10 <= 5 THEN 'Praha 5' ELSE 'Brno' END AS city_district,
       CASE WHEN {nation} > 0 THEN 'obec ' || {nation} END AS locality,
       {name} AS address_normalized,
       CASE {nation} % 3 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'source_gps' END AS address_precision,
       CASE WHEN {key} % 2 = 0 THEN CAST({key} AS VARCHAR) END AS ruian_address_code
FROM {source}
"""


PROPERTIES_SQL = _property_sql("s_suppkey", "s_nationkey", "s_name", "supplier")
PLACES_SQL = _property_sql("c_custkey", "c_nationkey", "c_name", "customer")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One located listing per order: the customer's point moved by up to some 45 m, with an
    address that differs from the customer's in its last digits for part of the orders."""
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    lat, lon = point_of(key)
    name = F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    return table(spark, sf_dir, "orders").select(
        order.alias("listing_id"),
        (lat + (order * 17 % 61 - 30) / 100000).alias("lat"),
        (lon + (order * 29 % 61 - 30) / 100000).alias("lon"),
        F.when(order % 5 > 0, F.concat(name, F.when(order % 5 == 1, " b").when(
            order % 5 == 2, " xyzuvw").otherwise(""))).alias("address_normalized"),
        F.when(order % 7 == 0, key.cast("string")).alias("ruian_address_code"),
        F.col("o_orderdate").alias("first_seen_at"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("kind"),
        key.alias("owner_id"),
    )


PROBES_SQL = """
SELECT o_orderkey AS listing_id,
       49.94 + (o_custkey * 37 % 240) / 1000 + (o_orderkey * 17 % 61 - 30) / 100000 AS lat,
       14.22 + (o_custkey * 91 % 490) / 1000 + (o_orderkey * 29 % 61 - 30) / 100000 AS lon,
       CASE WHEN o_orderkey % 5 > 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
            || CASE o_orderkey % 5 WHEN 1 THEN ' b' WHEN 2 THEN ' xyzuvw' ELSE '' END END AS address_normalized,
       CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey AS VARCHAR) END AS ruian_address_code,
       o_orderdate AS first_seen_at, o_totalprice AS price, o_orderpriority AS kind,
       o_custkey AS owner_id
FROM orders
"""

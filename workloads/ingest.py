"""Landing, parsing, validation, upserts and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.operators import history as h
from parcelwise.plans import chain
from parcelwise.plans import ingest as plan
from parcelwise.session import shared_dir
from parcelwise.sources import parsers, raw, registry, runs, upserts
from workloads.registry import FETCHES, VERSIONS, L, fetches, moment, query, r, rounded, versions


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# --- landing and scans --------------------------------------------------------------------


@query(
    "S1_land_payloads_with_key_and_digest",
    """SELECT page_id, sha256(html) AS content_hash,
 'raw/web/2024-03/' || page_id || '/20240305T060708Z.html' AS storage_key FROM pages""",
)
def _land(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "pages").select(
        "page_id", F.lit("web").alias("source_slug"), F.col("page_id").cast("string").alias("source_listing_id"),
        moment("2024-03-05T06:07:08").alias("fetched_at"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("html").alias("payload"),
    )
    return raw.with_landing_columns(docs).select("page_id", "content_hash", "storage_key")


@query(
    "S2_read_stored_payloads_of_a_month",
    "SELECT event_id, sha256(props) AS content_hash FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'",
)
def _stored(spark, sf_dir):
    path = scratch(spark)
    docs = ad.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("source_slug"), F.col("user_id").cast("string").alias("source_listing_id"),
        F.col("ts").alias("fetched_at"), F.lit("application/json").alias("content_type"), F.col("props").alias("payload"),
    )
    raw.land(docs, path)
    return raw.stored(spark, path, "click", ["2024-01"]).select("event_id", "content_hash")


@query(
    "S3_detail_json_scan",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _json(spark, sf_dir):
    return ad.table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "struct<k: bigint>", {"mode": "PERMISSIVE"})["k"].alias("k")
    )


@query(
    "S4_discovered_references",
    """WITH r AS (SELECT p_partkey AS id, p_partkey AS page, 0 AS pos, p_name AS name FROM part
  UNION ALL SELECT p_partkey // 2, p_partkey, 1, p_brand FROM part)
SELECT CAST(id AS VARCHAR) AS source_listing_id, arg_min(name, (page, pos)) AS name FROM r WHERE id <> 0 GROUP BY id""",
)
def _discovered(spark, sf_dir):
    k = F.col("p_partkey")
    estate = lambda field, i, name: F.to_json(F.struct(
        i.alias(field), name.alias("name"), F.struct((i + 1).alias("value_raw")).alias("price_czk")))
    pages = ad.table(spark, sf_dir, "part").select(
        F.lit("portal").alias("source_slug"), k.alias("page"),
        F.concat(F.lit('{"_embedded":{"estates":['), estate("hash_id", k, F.col("p_name")), F.lit(","),
                 estate("id", F.floor(k / 2), F.col("p_brand")), F.lit(',{"hash_id":"","id":0}]},"result_size":9}')).alias("payload"),
    )
    return raw.discovered(pages).select("source_listing_id", F.col("hint.name").alias("name"))


# --- parser -------------------------------------------------------------------------------

_OWN = {"A": "Osobní", "N": "Družstevní", "R": "Státní / obecní"}
_BLD = {"panel": "Panelová", "cihla": "Cihlová", "smisena": "Smíšená", "kamen": "Kamenná"}
_CND = {"novostavba": "Novostavba", "velmi_dobry": "Velmi dobrý", "po_rekonstrukci": "Po rekonstrukci", "dobry": "Dobrý",
        "pred_rekonstrukci": "Před rekonstrukcí", "spatny": "Špatný"}


def detail_payloads(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, point: Column | None = None,
                    place: Column | None = None, images: Column | None = None) -> DataFrame:
    """A detail document per listing, in the shapes a feed really sends; ``rows`` are listings, all by default."""
    c = F.col
    pick = lambda m, k: parsers.fixed_map(m)[c(k)]
    item = lambda name, value, unit=None: F.struct(
        F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"))
    items = F.array(
        item("Užitná plocha", c("size_m2"), "m²"), item("Plocha podlahová", F.lit("1")), item("celkova plocha", c("size_m2")),
        item("Stavba", pick(_BLD, "building_type")), item("Stav objektu", pick(_CND, "condition")),
        item("Vlastnictví", pick(_OWN, "ownership_type")), item("Rok kolaudace", c("year_built")),
        item("Poschodí", F.concat(c("floor_current").cast("string"), F.lit(". patro z "), c("floor_total").cast("string"))),
        item("Energetická náročnost budovy", F.concat(F.lit("Třída "), c("energy_class"))),
        item("Výtah", F.when(c("has_lift"), "ano").when(~c("has_lift"), "ne")), item("Balkón", c("has_balcony")),
        item("Anuita", c("photo_count"), "Kč"), item("Novinka", c("disposition")), item("PSČ", F.lit("150 00")),
    )
    k = c("floor_current")
    price = F.when(k == 1, F.concat(F.lit('"price_czk":{"value_raw":'), F.floor("price").cast("string"), F.lit("}"))).when(
        k == 2, F.concat(F.lit('"price_czk":'), F.floor("price").cast("string"))
    ).when(k == 3, F.concat(F.lit('"price_czk":{},"price":'), F.floor("price").cast("string"))).when(
        k == 4, '"price_czk":{}'
    ).when(k == 5, '"price_czk":{"value_raw":1}').otherwise('"price":null,"price_czk":null')
    seo = F.when(c("photo_count") == 5, '"seo":{"category_main_cb":1}').when(
        c("listing_kind") == "prodej", '"seo":{"category_main_cb":1,"category_type_cb":1}'
    ).otherwise('"seo":{"category_main_cb":"2","category_type_cb":2}')
    point = point if point is not None else F.when(k % 2 == 0, '"gps":{"lat":50.05,"lon":14.4},"map":{"lat":1,"lon":2}').otherwise(
        '"gps":null,"map":{"lat":"49.2","lon":16.6}'
    )
    place = place if place is not None else F.when(k == 1, "Běhounkova, Praha 5 - Stodůlky").when(k == 2, "Praha 5 - Smíchov").when(
        k == 3, "Dlouhá, Brno"
    ).otherwise("Toyen, Praha 2 - ")
    name = F.concat(F.lit("Prodej bytu "), (k % 5 + 1).cast("string"), F.when(c("has_balcony"), "+1").otherwise("+kk"))
    body = F.concat(
        F.lit("{"), F.substr(F.to_json(F.struct(F.struct(F.when(k < 6, name).alias("value")).alias("name"),
                                       F.concat(F.lit("Byt 3+1, "), name).alias("meta_description"),
                                       F.struct(place.alias("value")).alias("locality"),
                                       F.struct(c("description").alias("value")).alias("text"), items.alias("items"))), F.lit(2)),
    )
    shown = F.lit("") if images is None else F.concat(F.lit('"_embedded":{"images":'), images, F.lit("},"))
    json = F.concat(F.expr("'{'"), price, F.lit(","), seo, F.lit(","), point, F.lit(","), shown, F.substr(body, F.lit(2)))
    landed = ad.listings(spark, sf_dir) if rows is None else rows
    # landed payloads come in many files; a small order-line table is read in few parts
    cores = spark.sparkContext.defaultParallelism
    if ad.table(spark, sf_dir, "lineitem").rdd.getNumPartitions() < cores:
        landed = landed.repartition(cores, "listing_id")
    return landed.select(
        F.lit("portal").alias("source_slug"), c("listing_id").alias("source_listing_id"),
        c("last_seen_at").cast("timestamp").alias("fetched_at"),
        F.concat(F.lit("https://portal.example/"), c("listing_id")).alias("canonical_url"),
        F.when((c("photo_count") == 4) & (k == 7), "not json").otherwise(json).alias("payload"),
    )


PARSED = f"""
WITH l AS (SELECT *, floor_current AS k FROM ({L})),
x AS (SELECT *, photo_count IS NOT DISTINCT FROM 4 AND k = 7 AS broken, photo_count IS NOT DISTINCT FROM 5 AS no_code FROM l)
SELECT listing_id AS source_listing_id, CASE WHEN broken OR no_code THEN 'quarantine' ELSE 'ok' END AS parse_status,
 CASE WHEN broken THEN 'payload is not a JSON object' WHEN no_code THEN 'category codes are missing' END AS parse_error,
 CASE WHEN NOT broken AND k <= 3 THEN floor(price) END AS price, broken OR k > 3 AS price_hidden,
 CASE WHEN NOT broken THEN size_m2 END AS size_m2, CASE WHEN NOT broken THEN k END AS floor_current, CASE WHEN NOT broken THEN floor_total END AS floor_total,
 CASE WHEN NOT broken THEN year_built END AS year_built,
 CASE WHEN broken THEN NULL WHEN k < 6 THEN (k % 5 + 1) || CASE WHEN has_balcony THEN '+1' ELSE '+kk' END
      WHEN (k % 5 + 1) || CASE WHEN has_balcony THEN '+1' ELSE '+kk' END IN ('1+kk', '1+1', '2+kk', '2+1', '3+kk') THEN (k % 5 + 1) || CASE WHEN has_balcony THEN '+1' ELSE '+kk' END
      ELSE '3+1' END AS disposition,
 CASE WHEN NOT broken THEN CASE ownership_type WHEN 'A' THEN 'osobni' WHEN 'N' THEN 'druzstevni' ELSE 'statni' END END AS ownership_type,
 CASE WHEN NOT broken THEN building_type END AS building_type, CASE WHEN NOT broken THEN condition END AS condition,
 CASE WHEN NOT broken THEN energy_class END AS energy_class, CASE WHEN NOT broken THEN has_lift END AS has_lift, CASE WHEN NOT broken THEN has_balcony END AS has_balcony,
 CASE WHEN NOT broken THEN CAST(CASE WHEN k % 2 = 0 THEN 50.05 ELSE 49.2 END AS DOUBLE) END AS lat,
 CASE WHEN broken THEN NULL WHEN k = 1 THEN 'Praha 5' WHEN k = 3 THEN 'Brno' WHEN k > 3 THEN 'Praha 2 -' END AS city_district,
 CASE WHEN broken THEN NULL WHEN k = 1 THEN 'Stodůlky' WHEN k = 2 THEN 'Praha 5 - Smíchov' WHEN k = 3 THEN 'Dlouhá, Brno' ELSE 'Toyen, Praha 2 -' END AS locality,
 CASE WHEN broken THEN '' ELSE 'Novinka' END AS unknown_keys,
 CASE WHEN NOT broken AND photo_count IS NOT NULL THEN '{{"value":"' || photo_count || '","unit":"Kč"}}' WHEN NOT broken THEN '{{"unit":"Kč"}}' END AS annuity,
 CASE WHEN listing_kind = 'prodej' OR no_code OR broken THEN 'prodej' ELSE 'pronajem' END AS listing_kind,
 CASE WHEN broken THEN 'ostatni' WHEN listing_kind = 'prodej' OR no_code THEN 'byt' ELSE 'dum' END AS property_type
FROM x"""


@query("X1_to_X7_detail_documents_to_listings", PARSED)
def _parse(spark, sf_dir):
    out = parsers.parse_all(detail_payloads(spark, sf_dir))
    return out.select(
        "source_listing_id", "parse_status", "parse_error", F.col("price").cast("double").alias("price"), "price_hidden",
        F.col("size_m2").cast("double").alias("size_m2"), "floor_current", "floor_total", "year_built", "disposition",
        "ownership_type", "building_type", "condition", "energy_class", "has_lift", "has_balcony", "lat", "city_district",
        "locality", F.array_join("unknown_keys", ",").alias("unknown_keys"), F.col("extra_features")["anuita_czk"].alias("annuity"),
        "listing_kind", "property_type",
    )


@query(
    "F11_X2_quarantine",
    f"""WITH x AS (SELECT listing_id, photo_count, price - 2000 AS price, size_m2 - 8 AS size_m2, CASE WHEN has_lift THEN year_built - 230 ELSE year_built END AS year_built,
   CASE WHEN energy_class = 'A' THEN 'EUR' ELSE 'CZK' END AS currency FROM ({L})),
e AS (SELECT listing_id, concat_ws('; ', CASE WHEN currency <> 'CZK' THEN 'currency is not CZK' END, CASE WHEN year_built < 1700 THEN 'implausible year_built' END,
   CASE WHEN price < 0 THEN 'negative price' END, CASE WHEN size_m2 <= 0 THEN 'size is not positive' END, CASE WHEN photo_count = 2 THEN 'unknown disposition' END) AS err FROM x)
SELECT listing_id, CASE WHEN err = '' THEN 'ok' ELSE 'quarantine' END AS parse_status, nullif(err, '') AS parse_error FROM e""",
)
def _quarantine(spark, sf_dir):
    c = F.col
    none = lambda n: F.lit(None).cast("string").alias(n)
    rows = ad.listings(spark, sf_dir).select(
        "listing_id", F.lit("portal").alias("source_slug"), c("listing_id").alias("source_listing_id"),
        (c("price") - 2000).alias("price"), (c("size_m2") - 8).alias("size_m2"),
        F.when(c("has_lift"), c("year_built") - 230).otherwise(c("year_built")).alias("year_built"),
        F.when(c("energy_class") == "A", "EUR").otherwise("CZK").alias("currency"), F.lit(50.0).alias("lat"), F.lit(14.0).alias("lon"),
        F.when(c("photo_count") == 2, "2+x").otherwise("2+kk").alias("disposition"), "property_type", "listing_kind",
        none("ownership_type"), "building_type", "condition", "energy_class",
    )
    out = parsers.validated(rows, parsers.listing_rules(F.lit(2026)))
    return out.select("listing_id", "parse_status", "parse_error")


@query(
    "X8_U4_location_resolution",
    """WITH p AS (SELECT o_orderkey AS id, o_custkey, 49.93 + (o_custkey * 37 % 240) / 1000 AS lat, 14.22 + (o_custkey * 91 % 490) / 1000 AS lon FROM orders),
g AS (SELECT c_custkey, 49.93 + (c_custkey * 37 % 240) / 1000 AS lat, 14.22 + (c_custkey * 91 % 490) / 1000 AS lon, c_custkey % 3 AS m FROM customer),
h AS (SELECT lat, lon, min(CAST(c_custkey AS VARCHAR)) AS code FROM g WHERE m = 0 GROUP BY ALL),
x AS (SELECT p.*, lat BETWEEN 49.94 AND 50.18 AND lon BETWEEN 14.22 AND 14.71 AS inside, h.code FROM p LEFT JOIN h USING (lat, lon))
SELECT id AS listing_id, CASE WHEN inside AND code IS NOT NULL THEN 'rooftop' WHEN inside AND id % 2 = 0 THEN 'street' WHEN inside THEN 'source_gps'
   WHEN id % 3 = 0 THEN 'rooftop' ELSE 'locality' END AS precision,
 CASE WHEN inside AND code IS NOT NULL THEN 'source_gps+ruian' WHEN inside AND id % 2 = 0 THEN 'source_gps+nominatim' WHEN inside THEN 'source_gps'
   WHEN id % 3 = 0 THEN 'nominatim_forward' ELSE 'unresolved' END AS note,
 CASE WHEN inside THEN code END AS ruian_address_code, CASE WHEN inside AND code IS NOT NULL THEN 'Praha 7' ELSE 'Praha 2' END AS city_district,
 inside OR id % 3 = 0 AS linkable FROM x""",
)
def _resolve(spark, sf_dir):
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    spot = lambda x: (49.93 + (x * 37 % 240) / 1000, 14.22 + (x * 91 % 490) / 1000)
    lat, lon = spot(k)
    orders = ad.table(spark, sf_dir, "orders")
    rows = orders.select(
        o.alias("listing_id"), lat.alias("lat"), lon.alias("lon"), F.lit("ul. Dlouhá 1").alias("address_raw"),
        F.lit("Praha").alias("locality"), F.lit("").alias("city_district"), F.lit("120 00").alias("postcode"),
    )
    c = F.col("c_custkey")
    rlat, rlon = spot(c)
    reg = ad.table(spark, sf_dir, "customer").where(c % 3 == 0).select(
        c.cast("string").alias("kod_adm"), F.lit("Praha 7").alias("nazev_momc"), F.lit("Holešovice").alias("nazev_casti_obce"),
        F.lit("17000").alias("psc"), rlat.alias("lat"), rlon.alias("lon"),
    )
    strings = "map<string,string>"
    answer = lambda cat, addr: F.struct(
        F.lit("50.0").alias("lat"), F.lit("14.4").alias("lon"), F.lit(None).cast("string").alias("addresstype"), F.lit("x").alias("type"),
        F.lit(cat).cast("string").alias("category"), addr.cast(strings).alias("address"), F.create_map().cast(strings).alias("extratags"),
        F.lit("Dlouhá 1").alias("display_name"))
    rev = orders.where(o % 2 == 0).select(o.alias("listing_id"), answer(None, F.create_map(F.lit("road"), F.lit("Dlouhá"))).alias("result"))
    fwd = orders.where(o % 3 == 0).select(o.alias("listing_id"), answer("building", F.create_map()).alias("result"))
    from parcelwise.operators.linking import resolve_locations

    return resolve_locations(rows, reg, rev, fwd).select(
        "listing_id", "precision", "note", "ruian_address_code", "city_district", "linkable"
    )


@query(
    "X9_geocoder_answer_precision",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'rooftop' WHEN 2 THEN 'parcel' WHEN 3 THEN 'street' WHEN 4 THEN 'rooftop' ELSE 'locality' END AS precision FROM part""",
)
def _precision(spark, sf_dir):
    from parcelwise.operators.linking import geocoder_precision

    n = F.col("p_size") % 6
    kind = F.when(n == 0, "house").when(n == 2, "parcel").otherwise("city")
    addr = F.when(n == 1, F.create_map(F.lit("house_number"), F.lit("5"))).when(n == 3, F.create_map(F.lit("road"), F.lit("x")))
    res = F.struct(kind.alias("addresstype"), F.lit("y").alias("type"), F.when(n == 4, "building").alias("category"), addr.alias("address"))
    return ad.table(spark, sf_dir, "part").select("p_partkey", F.struct(res.alias("r")).alias("s")).select(
        "p_partkey", geocoder_precision(F.col("s.r")).alias("precision")
    )


# --- registry -----------------------------------------------------------------------------


def _registry_rows(spark, sf_dir):
    k = F.col("c_custkey")
    return ad.table(spark, sf_dir, "customer").select(
        *[v.alias(registry.COLUMNS[c]) for c, v in {
            "kod_adm": F.when(k % 11 > 0, k.cast("string")).otherwise(" "), "kod_obce": F.lit("554782"), "nazev_obce": F.lit("Praha"),
            "nazev_momc": F.lit(" Praha 2 "), "nazev_casti_obce": F.lit("Vršovice"), "nazev_ulice": F.lit("Žitná"), "cislo_domovni": k.cast("string"),
            "cislo_orientacni": F.when(k % 2 == 0, "12").otherwise(""), "znak": F.when(k % 4 == 0, "a").otherwise(""), "psc": F.lit("12000"),
            "x": F.when(k % 7 > 0, (-1043000.5 - k).cast("string")).otherwise(""), "y": F.concat(F.lit("-741000,"), k.cast("string")),
        }.items()]
    )


@query(
    "S5_X11_address_file_scan",
    """SELECT CAST(c_custkey AS VARCHAR) AS kod_adm, 'Praha 2' AS nazev_momc, 'Žitná' AS nazev_ulice,
 CASE WHEN c_custkey % 4 = 0 THEN '12a' WHEN c_custkey % 2 = 0 THEN '12' END AS cislo_orientacni FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 7 > 0""",
)
def _scan(spark, sf_dir):
    path = scratch(spark)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    _registry_rows(spark, sf_dir).write.csv(path, sep=";", header=True, encoding="windows-1250")
    return registry.parse_registry(registry.scan_registry(spark, path)).select(
        "kod_adm", "nazev_momc", "nazev_ulice", "cislo_orientacni"
    )


@query(
    "S6_address_register_upsert",
    """SELECT CAST(c_custkey AS VARCHAR) AS kod_adm, c_name AS nazev_ulice FROM customer
UNION ALL SELECT CAST(s_suppkey + 1000000000 AS VARCHAR), s_name FROM supplier
UNION ALL SELECT CAST(c_custkey + 2000000000 AS VARCHAR), 'old' FROM customer""",
)
def _upsert_registry(spark, sf_dir):
    cust, sup = ad.table(spark, sf_dir, "customer"), ad.table(spark, sf_dir, "supplier")
    key = F.col("c_custkey")
    existing = cust.select(key.cast("string").alias("kod_adm"), F.lit("old").alias("nazev_ulice")).unionByName(
        cust.select((key + 2000000000).cast("string").alias("kod_adm"), F.lit("old").alias("nazev_ulice")))
    incoming = cust.select(key.cast("string").alias("kod_adm"), F.col("c_name").alias("nazev_ulice")).unionByName(
        sup.select((F.col("s_suppkey") + 1000000000).cast("string").alias("kod_adm"), F.col("s_name").alias("nazev_ulice")))
    return registry.upsert_registry(existing, incoming.unionByName(incoming))


@query(
    "S7_projection_sanity_share",
    "SELECT round(avg(CASE WHEN lat BETWEEN 48.5 AND 51.1 AND lon BETWEEN 12 AND 18.9 THEN 0.0 ELSE 1.0 END), 6) AS outside_share "
    "FROM (SELECT 49 + c_acctbal / 3000 AS lat, 14 + c_acctbal / 4000 AS lon FROM customer)",
)
def _sanity(spark, sf_dir):
    pts = ad.table(spark, sf_dir, "customer").select((49 + F.col("c_acctbal") / 3000).alias("lat"), (14 + F.col("c_acctbal") / 4000).alias("lon"))
    return registry.outside_share(pts).select(F.round("outside_share", 6).alias("outside_share"))


# --- upserts ------------------------------------------------------------------------------


@query(
    "S8_listing_upsert",
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_orderdate) AS f, max(o_orderdate) AS l, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_totalprice, o_orderkey) AS p
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
n AS (SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_orderdate) AS f, max(o_orderdate) AS l, arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, (o_orderdate, o_orderkey)) AS st0,
   max_by(struct_pack(s := CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, p := o_totalprice), (o_orderdate, o_orderkey)) AS x
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL)
SELECT coalesce(o.id, n.id) AS source_listing_id, strftime(coalesce(o.f, n.f), '%Y-%m-%d') AS first_seen, strftime(coalesce(n.l, o.l), '%Y-%m-%d') AS last_seen,
 CASE WHEN n.id IS NOT NULL THEN n.x.s ELSE o.st END AS status, CASE WHEN n.id IS NOT NULL THEN n.x.p ELSE o.p END AS price
FROM o FULL JOIN n ON o.id = n.id""",
)
def _upsert(spark, sf_dir):
    orders = ad.table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string").alias("source_listing_id")
    old = orders.where(F.col("o_orderdate") < moment("1998-01-01T00:00:00")).groupBy(key).agg(
        F.min("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_seen_at"),
        F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_totalprice", "o_orderkey").alias("price"),
    ).withColumn("source_slug", F.lit("portal"))
    # one state per listing and moment, so that the newest state is unique
    new = orders.where(F.col("o_orderdate") >= moment("1998-01-01T00:00:00")).groupBy(key, "o_orderdate").agg(
        F.max_by(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"), F.col("o_totalprice").alias("p")), "o_orderkey").alias("x")
    ).select(F.lit("portal").alias("source_slug"), "source_listing_id", F.col("x.s").alias("status"), F.col("x.p").alias("price"),
             F.col("o_orderdate").alias("seen_at"))
    out = upserts.upsert_listings(old, new)
    return out.select(
        "source_listing_id", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"), "status", "price",
    )


@query(
    "S9_photo_replacement",
    """SELECT c_custkey AS listing_id, CAST(0 AS INT) AS ord, 'old' AS url_source FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT c_custkey, CAST(i AS INT), c_name || i FROM customer, range(3) g(i) WHERE c_custkey % 3 = 0 AND i < c_custkey % 4""",
)
def _photos(spark, sf_dir):
    cust = ad.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    nothing = F.lit(None).cast("int")
    old = cust.select(k.alias("listing_id"), F.lit(0).alias("ord"), F.lit("old").alias("url_source"), nothing.alias("width"), nothing.alias("height"))
    urls = F.filter(F.array(*[F.struct(F.concat("c_name", F.lit(str(i))).alias("url"), nothing.alias("width"), nothing.alias("height"), F.lit(i).alias("i")) for i in range(3)]),
                    lambda p: p["i"] < k % 4)
    batch = cust.where(k % 3 == 0).select(k.alias("listing_id"), urls.alias("photos"))
    return upserts.replace_photos(old, batch).select("listing_id", "ord", "url_source")


@query(
    "S14_scoring_config",
    """SELECT n_name AS model_version, CAST(1.5 AS DOUBLE) AS undervaluation_weight, CAST(-0.8 AS DOUBLE) AS risk_weight FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)""",
)
def _config(spark, sf_dir):
    from parcelwise.functions.scoring import WEIGHTS_V1

    weights = F.to_json(F.struct(F.struct(*[F.lit(v).alias(k) for k, v in WEIGHTS_V1.items()]).alias("components")))
    table = ad.table(spark, sf_dir, "nation").select(F.col("n_name").alias("model_version"), weights.alias("weights_json"))
    first = table.agg(F.min("model_version")).head()[0]
    cfg = upserts.load_config(table, first)
    return table.where(F.col("model_version") == first).select(
        "model_version", F.lit(cfg.weights["undervaluation_pct"]).alias("undervaluation_weight"),
        F.lit(cfg.weights["risk_score"]).alias("risk_weight"),
    )


@query(
    "S15_run_metrics",
    "SELECT 'portal' AS source_slug, 'parse' AS stage, 'ok' AS status, count(*) AS seen, count(*) FILTER (WHERE value > 100) AS large FROM events",
)
def _run(spark, sf_dir):
    path = scratch(spark)
    run = runs.Run("portal", "parse")
    watched = run.watch(ad.table(spark, sf_dir, "events"), {"seen": F.count(F.lit(1)), "large": F.count_if(F.col("value") > 100)})
    watched.write.format("noop").mode("overwrite").save()
    run.finish(spark, path)
    return spark.read.parquet(path).select(
        "source_slug", "stage", "status", F.col("stats")["seen"].alias("seen"), F.col("stats")["large"].alias("large")
    )


def _landed(spark, sf_dir):
    docs = detail_payloads(spark, sf_dir)
    return docs.withColumn("content_hash", F.sha2("payload", 256))


@query(
    "S17_U1_ingest_chain_outcome",
    f"""WITH x AS ({PARSED}) SELECT parse_status, listing_kind, count(*) AS n, count(price) AS priced FROM x GROUP BY ALL""",
)
def _chain(spark, sf_dir):
    from parcelwise.schemas import LISTING

    props = ad.properties(spark, sf_dir)
    out = plan.ingest(_landed(spark, sf_dir), spark.createDataFrame([], LISTING), props)
    return out.parsed.groupBy("parse_status", "listing_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced")
    )


# Two days of one feed: o is the order, k the line. Day one shows orders with o % 3 of 1 or 2, day two those of 0 or 2; on day
# two every odd line has a new text, a price 1000 higher and one photo more.
_ORDER = "CAST(split_part(listing_id, '-', 1) AS BIGINT)"
_DAY_2, _DAY_3 = "2024-03-03T00:00:00", "2024-03-03T00:10:00"


def _feed(spark: SparkSession, sf_dir: str, day: int) -> tuple[DataFrame, DataFrame]:
    """(search pages, documents) of a day; documents of o % 3 = 0 and k = 6 cannot be had."""
    c = F.col
    o, k, odd = F.expr(_ORDER), c("floor_current"), (c("floor_current") % 2 == 1) & F.lit(day > 1)
    rows = ad.listings(spark, sf_dir).where(o % 3 != (0 if day == 1 else 1)).withColumns({
        "price": c("price") + F.when(odd, 1000).otherwise(0),
        "description": F.concat("description", F.when(odd, F.lit(" 2")).otherwise("")),
        "__photos": F.coalesce("photo_count", F.lit(0)) + F.when(odd, 1).otherwise(0),
    })
    spot = c("property_id") % 1680
    lat, lon = 49940 + spot * 37 % 240, 14220 + spot * 91 % 490
    at = lambda x: F.concat(F.floor(x / 1000).cast("string"), F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0"))
    point = F.when(k == 7, '"gps":null').otherwise(F.concat(F.lit('"gps":{"lat":'), at(lat), F.lit(',"lon":'), at(lon), F.lit("}")))
    images = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(
        F.when(i <= c("__photos"), F.concat(F.lit("https://portal.example/p/"), i.cast("string"))).alias("url"), F.lit(640).alias("width"))))
    docs = detail_payloads(spark, sf_dir, rows, point, F.concat(F.lit("Ulice "), spot.cast("string"), F.lit(", Praha 5")), images)
    lost = (F.expr(_ORDER.replace("listing_id", "source_listing_id")) % 3 == 0) & (F.expr("split_part(source_listing_id, '-', 2)") == "6")
    second = F.expr("split_part(source_listing_id, '-', 2)") == "2"
    when = F.when(second, F.lit("2024-03-02T23:00:00")).otherwise("2024-03-01T00:00:00") if day == 1 else F.lit(_DAY_2 if day == 2 else _DAY_3)
    docs = docs.where(~lost).withColumns({"fetched_at": when.cast("timestamp"), "content_type": F.lit("application/json")})
    shown = rows.groupBy(F.floor(o / 8).alias("page")).agg(F.sort_array(F.collect_list("listing_id")).alias("ids"))
    pages = shown.select(F.lit("portal").alias("source_slug"), "page", F.to_json(F.struct(F.struct(
        F.transform("ids", lambda i: F.struct(i.alias("hash_id"))).alias("estates")).alias("_embedded"))).alias("payload"))
    return pages, docs


_TWO_DAYS = f"""
WITH x AS (
  SELECT p.*, l.property_id % 1680 AS spot, {_ORDER.replace("listing_id", "l.listing_id")} % 3 AS o, l.floor_current AS k, l.price AS asked,
         coalesce(l.photo_count, 0) AS photos, p.parse_status = 'ok' AS fine
  FROM ({PARSED}) p JOIN ({L}) l ON p.source_listing_id = l.listing_id),
d AS (SELECT *, o <> 0 AS day1, o = 0 AND k <> 6 OR o = 2 AND k <> 2 AS day2, o = 2 AND (k IN (4, 6) OR parse_error = 'payload is not a JSON object') IS TRUE AS same,
             k % 2 = 1 AND o <> 1 AS revised FROM x),
s AS (SELECT *, CASE WHEN k <> 7 THEN spot END AS place FROM d WHERE fine AND (day1 OR day2)),
g AS (SELECT *, count(*) OVER c AS members, min(source_listing_id) OVER c AS low, min(source_listing_id) OVER (PARTITION BY place) AS home FROM s
      WINDOW c AS (PARTITION BY place, size_m2, disposition, ownership_type))
SELECT 'listing' AS kind, source_listing_id AS name, concat_ws('|',
  coalesce(CAST(CAST(CASE WHEN k <= 3 THEN floor(asked + CASE WHEN revised THEN 1000 ELSE 0 END) END AS BIGINT) AS VARCHAR), '-'),
  CASE WHEN NOT day1 THEN '03-03 00' WHEN k = 2 THEN '03-02 23' ELSE '03-01 00' END,
  CASE WHEN day2 AND NOT same THEN '03-03 00' WHEN k = 2 THEN '03-02 23' ELSE '03-01 00' END,
  CASE WHEN k <> 7 THEN home ELSE '-' END, CASE WHEN k <> 7 AND members > 1 THEN low ELSE '-' END,
  CAST(photos + CASE WHEN revised THEN 1 ELSE 0 END AS VARCHAR)) AS value FROM g
UNION ALL SELECT 'counter', 'day-1 ' || n, CAST(v AS VARCHAR) FROM (
  SELECT count(*) AS discovered, count(*) AS wanted, count(*) AS fetched, 0 AS missing, 0 AS unchanged, count(*) FILTER (fine) AS parsed,
    count(*) FILTER (NOT fine) AS quarantined, count(*) FILTER (fine) AS created, count(*) FILTER (fine AND k <> 7) AS linked
  FROM d WHERE day1) UNPIVOT (v FOR n IN (discovered, wanted, fetched, missing, unchanged, parsed, quarantined, created, linked))
UNION ALL SELECT 'counter', 'day-2 ' || n, CAST(v AS VARCHAR) FROM (
  SELECT count(*) AS discovered, count(*) FILTER (day2 OR o = 0) AS wanted, count(*) FILTER (day2) AS fetched, count(*) FILTER (o = 0 AND k = 6) AS missing,
    count(*) FILTER (day2 AND same) AS unchanged, count(*) FILTER (day2 AND NOT same AND fine) AS parsed, count(*) FILTER (day2 AND NOT same AND NOT fine) AS quarantined,
    count(*) FILTER (day2 AND o = 0 AND fine) AS created, count(*) FILTER (day2 AND NOT same AND fine AND k <> 7) AS linked
  FROM d WHERE o <> 1) UNPIVOT (v FOR n IN (discovered, wanted, fetched, missing, unchanged, parsed, quarantined, created, linked))
UNION ALL SELECT 'counter', 'day-3 ' || n, CAST(v AS VARCHAR) FROM (
  SELECT count(*) AS discovered, count(*) FILTER (o = 0 AND k = 6) AS wanted, 0 AS fetched, count(*) FILTER (o = 0 AND k = 6) AS missing,
    0 AS unchanged, 0 AS parsed, 0 AS quarantined, 0 AS created, 0 AS linked
  FROM d WHERE o <> 1) UNPIVOT (v FOR n IN (discovered, wanted, fetched, missing, unchanged, parsed, quarantined, created, linked))
UNION ALL SELECT 'versions', 'day-1,day-2,day-3', '3'
"""


@query("S17_two_days_and_repeats", _TWO_DAYS)
def _two_days(spark, sf_dir):
    """Two runs, the second one again under its id, and once more under another: links, clusters, photos and counters."""
    snaps = chain.Snapshots(spark, scratch(spark))
    for day in (1, 2, 2, 3):
        as_of = moment({1: "2024-03-01T00:00:00", 2: _DAY_2, 3: _DAY_3}[day])
        chain.run(snaps, f"day-{day}", *_feed(spark, sf_dir, day), as_of)
    last, versions = snaps.current(), snaps.versions()
    photos = snaps.table("photos", last).groupBy("listing_id").agg(F.count("*").alias("photos"))
    rows = snaps.table("listings", last).join(photos, "listing_id", "left")
    home = rows.groupBy("property_id").agg(F.min("source_listing_id").alias("home"))
    low = rows.groupBy("dedup_cluster_id").agg(F.min("source_listing_id").alias("low"))
    hour = lambda c: F.date_format(c, "MM-dd HH")
    told = rows.join(home, "property_id", "left").join(low, "dedup_cluster_id", "left").select(
        F.lit("listing").alias("kind"), F.col("source_listing_id").alias("name"), F.concat_ws(
            "|", F.coalesce(F.col("price").cast("bigint").cast("string"), F.lit("-")), hour("first_seen_at"), hour("last_seen_at"),
            F.coalesce("home", F.lit("-")), F.coalesce("low", F.lit("-")), F.coalesce("photos", F.lit(0)).cast("string")).alias("value"),
    )
    facts = [("counter", f"{m.run_id} {k}", str(v)) for m in versions for k, v in m.counters.items()]
    facts.append(("versions", ",".join(sorted(m.run_id for m in versions)), str(len(versions))))
    return told.union(spark.createDataFrame(facts, told.schema))


@query(
    "S16_replay_of_stored_payloads",
    f"""WITH x AS ({PARSED}) SELECT source_listing_id, price, 'active' AS status FROM x WHERE parse_status = 'ok'""",
)
def _replay(spark, sf_dir):
    from parcelwise.schemas import LISTING

    path = scratch(spark)
    raw.land(detail_payloads(spark, sf_dir).withColumn("content_type", F.lit("application/json")), path)
    return plan.replay(spark, path, spark.createDataFrame([], LISTING), "portal").select(
        "source_listing_id", F.col("price").cast("double").alias("price"), "status"
    )


# --- histories ----------------------------------------------------------------------------


@query(
    "W2_changed_payloads",
    f"""SELECT event_id, coalesce(lag(content_hash) OVER (PARTITION BY source_slug, source_listing_id ORDER BY fetched_at, content_hash) <> content_hash, true) AS changed FROM ({FETCHES})""",
)
def _changed(spark, sf_dir):
    return h.changed_payloads(fetches(spark, sf_dir)).select("event_id", "changed")


@query(
    "F6_references_that_need_a_fetch",
    f"""WITH f AS (SELECT source_slug, source_listing_id, max(fetched_at) AS last FROM ({FETCHES}) GROUP BY ALL),
refs AS (SELECT DISTINCT event_type AS source_slug, CAST(c_custkey AS VARCHAR) AS source_listing_id FROM customer, (SELECT DISTINCT event_type FROM events))
SELECT source_slug, source_listing_id FROM refs LEFT JOIN f USING (source_slug, source_listing_id)
WHERE last IS NULL OR epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last) > 86400000000""",
)
def _needs(spark, sf_dir):
    f = fetches(spark, sf_dir)
    slugs = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    refs = ad.table(spark, sf_dir, "customer").select(
        F.explode(slugs).alias("source_slug"), F.col("c_custkey").cast("string").alias("source_listing_id")
    )
    return h.needs_fetch(refs, f, moment("2024-01-31T00:00:00"))


SNAP = "SELECT user_id AS listing_id, ts AS observed_at, round(value / 25) AS price, CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'active' END AS status FROM events"


def _snapshots(spark, sf_dir):
    return ad.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), F.round(F.col("value") / 25).alias("price"),
        F.when(F.col("event_type") == "error", "withdrawn").otherwise("active").alias("status"),
    )


_STATES = """SELECT user_id AS listing_id, ts AS observed_at, round(value / 25) AS price, CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'active' END AS status,
  CASE WHEN event_type <> 'view' THEN md5(event_type) END AS description_hash, event_id % 3 AS photos_hash,
  CASE WHEN day(ts) % 2 = 0 THEN 'has_lift' ELSE 'has_lift,has_cellar' END AS features FROM events"""
_FIELDS = ["price", "status", "description_hash", "photos_hash", "features"]


@query(
    "W7_change_records",
    f"""WITH s AS (SELECT *, {", ".join(f"lag({f}) OVER w AS old_{f}" for f in _FIELDS)}, row_number() OVER w AS rn FROM ({_STATES})
  WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at))
SELECT listing_id, epoch_us(observed_at) AS at,
  concat_ws(',', {", ".join(f"CASE WHEN old_{f} IS DISTINCT FROM {f} THEN '{f}' END" for f in _FIELDS)}) AS changed, coalesce(old_description_hash, '-') AS old_description
FROM s WHERE rn = 1 OR {" OR ".join(f"old_{f} IS DISTINCT FROM {f}" for f in _FIELDS)}""".replace(
        "coalesce(old_description_hash, '-')", "CASE WHEN old_description_hash IS DISTINCT FROM description_hash THEN coalesce(old_description_hash, '-') ELSE '' END"),
)
def _changes(spark, sf_dir):
    c = F.col
    states = ad.table(spark, sf_dir, "events").select(
        c("user_id").alias("listing_id"), c("ts").alias("observed_at"), F.round(c("value") / 25).alias("price"),
        F.when(c("event_type") == "error", "withdrawn").otherwise("active").alias("status"),
        F.when(c("event_type") != "view", F.md5("event_type")).alias("description_hash"), (c("event_id") % 3).alias("photos_hash"),
        F.when(F.dayofmonth("ts") % 2 == 0, "has_lift").otherwise("has_lift,has_cellar").alias("features"),
    )
    out = h.change_records(states)
    names = F.array_join(F.transform("fields_changed", lambda x: x["name"]), ",")
    text = F.filter("fields_changed", lambda x: x["name"] == "description_hash")
    was = F.when(F.size(text) > 0, F.coalesce(F.get(text, F.lit(0))["old"], F.lit("-"))).otherwise("")
    return out.select("listing_id", F.unix_micros(c("observed_at").cast("timestamp")).alias("at"), names.alias("changed"), was.alias("old_description"))


@query(
    "W10_reactivations",
    f"""WITH s AS (SELECT *, lag(status) OVER (PARTITION BY listing_id ORDER BY observed_at) AS ps FROM ({SNAP}))
SELECT listing_id, epoch_us(observed_at) AS at FROM s WHERE ps = 'withdrawn' AND status = 'active'""",
)
def _react(spark, sf_dir):
    return h.reactivations(_snapshots(spark, sf_dir)).select(
        "listing_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at")
    )


@query(
    "W8_fast_price_drops",
    """WITH v AS (SELECT o_custkey AS id, o_orderdate AS seen, o_totalprice AS price FROM orders),
f AS (SELECT id, min(seen) AS first_at, arg_min(price, (seen, price)) AS first_price FROM v GROUP BY id)
SELECT id AS listing_id, first_price, min(price) AS lowest_price FROM v JOIN f USING (id) WHERE seen <= first_at + INTERVAL 90 DAY
GROUP BY ALL HAVING min(price) < first_price * 0.95""",
)
def _drops(spark, sf_dir):
    v = ad.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("listing_id"), F.col("o_orderdate").alias("observed_at"), F.col("o_totalprice").alias("price")
    )
    return h.fast_price_drops(v, within_days=90)


@query(
    "J7_price_as_of",
    f"""WITH v AS ({VERSIONS}), k AS (SELECT listing_id, arg_max(price, observed_at) AS p FROM v WHERE observed_at <= TIMESTAMP '1998-10-03' AND price IS NOT NULL GROUP BY ALL)
SELECT listing_id, {r("coalesce(k.p, l.price)")} AS price_then FROM ({L}) l LEFT JOIN k USING (listing_id)""",
)
def _price_then(spark, sf_dir):
    l = ad.listings(spark, sf_dir).select("listing_id", "price")
    return rounded(h.price_as_of(l, versions(spark, sf_dir), moment("1998-10-03T00:00:00")).select("listing_id", "price_then"))



"""Text normalisation and scoring formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise import adapters as ad
from parcelwise.functions import geo
from parcelwise.functions import scoring as s
from parcelwise.functions import text as t
from parcelwise.sources import parsers
from workloads.registry import L, P, query, r, rounded

# --- text ---------------------------------------------------------------------------------


@query("N1_strip_diacritics", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _strip(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(t.strip_diacritics(F.col("text"))).alias("folded")
    )


@query("N1_strip_diacritics_full_folding", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def _strip_full(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(t.strip_diacritics_full(F.col("text"))).alias("folded")
    )


@query(
    "N2_normalize_for_match",
    r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS key FROM documents",
)
def _norm(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(t.normalize_for_match(F.col("text"))).alias("key")
    )


def _worded(name: str, fn, cases: list[tuple[str | None, object]], cast: str = "VARCHAR") -> None:
    """A normaliser over every part, whose size picks a phrase; the oracle knows the answers."""
    n = len(cases)
    lit = lambda v: "NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'")
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, (_, v) in enumerate(cases))
    sql = f"SELECT p_partkey, CAST(CASE p_size % {n} {arms} END AS {cast}) AS parsed FROM part"

    def run(spark, sf_dir):
        words = F.array(*[F.lit(w).cast("string") for w, _ in cases])
        text = F.concat(F.get(words, F.col("p_size") % n))
        return ad.table(spark, sf_dir, "part").select("p_partkey", fn(text).alias("parsed"))

    query(name, sql)(run)


_worded("N3_parse_disposition", t.parse_disposition, [
    ("Prodej bytu 2+kk, 56 m²", "2+kk"), ("Byt 3 + 1 Praha", "3+1"), ("Garsoniéra 25 m²", "garsoniera"),
    ("rodinný dům 7+1", "6+"), ("atypický byt", "atypicky"), ("pozemek", None), ("", None), (None, None),
    ("1+KK s balkonem", "1+kk"), ("5+1 a 2+kk", "2+kk"), ("12+1", None), ("loft 4+kk/T", "4+kk"),
])
_worded("N4_parse_ownership", t.parse_ownership, [
    ("Osobní", "osobni"), ("Družstevní vlastnictví", "druzstevni"), ("Státní / obecní", "statni"), ("OV", "osobni"),
    ("DV", "druzstevni"), ("družstevní s převodem do OV", "osobni"), ("neznámé", None), ("", None), (None, None),
    ("Obecní", "statni"),
])
_worded("N4_parse_ownership_strict", lambda c: t.parse_ownership(c, strict=True), [
    ("Osobní", "osobni"), ("družstevní s převodem do OV", None), ("Obecní", "statni"), ("", None),
])
_worded("N5_parse_building_type", t.parse_building_type, [
    ("Panelová", "panel"), ("Cihlová", "cihla"), ("Smíšená", "smisena"), ("Dřevěná", "drevo"), ("Kamenná", "kamen"),
    ("ostatní", "ostatni"), ("Skeletová", None), ("", None),
])
_worded("N6_parse_condition", t.parse_condition, [
    ("Novostavba", "novostavba"), ("Velmi dobrý", "velmi_dobry"), ("Dobrý", "dobry"), ("Po rekonstrukci", "po_rekonstrukci"),
    ("Před rekonstrukcí", "pred_rekonstrukci"), ("V rekonstrukci", "v_rekonstrukci"), ("Špatný stav", "spatny"),
    ("Projekt", "projekt"), ("ve výstavbě", None), (None, None), ("  velmi   dobrý stav ", "velmi_dobry"),
])
_worded("N7_parse_energy_class", t.parse_energy_class, [
    ("Třída C - Úsporná", "C"), ("g – nezadáno", "G"), ("Č", None), ("AB", None), ("", None), ("b", "B"),
    ("ÉA G", "G"), ("H", None),
])
_worded("N8_parse_floor_current", lambda c: t.parse_floor(c)["current"], [
    ("2. patro z 5", 2), ("přízemí", 0), ("4/5", 4), ("zvýšené přízemí z 3", 0), ("3. podlaží z celkem 6", 3), ("-1/4", -1),
    ("7", 7), ("", None), ("podkroví", None), ("1. NP of 3", 1),
], "INTEGER")
_worded("N8_parse_floor_total", lambda c: t.parse_floor(c)["total"], [
    ("2. patro z 5", 5), ("přízemí", None), ("4/5", 5), ("zvýšené přízemí z 3", None), ("7", None), (None, None), ("1. NP of 3", 3),
], "INTEGER")
_worded("N9_normalize_address", t.normalize_address, [
    ("ul. Plzeňská  12", "ulice Plzeňská 12"), ("nám. Míru 5", "naměsti Míru 5"), ("tř. Svobody 1", "třida Svobody 1"),
    ("Vinohradská č.p. 2128", "Vinohradská 2128"), ("UL. Dlouhá č. 3", "ulice Dlouhá 3"), ("tr. Kpt. Jaroše", "třida Kpt. Jaroše"),
])
_worded("N10_parse_house_number", lambda c: F.concat_ws("-", t.parse_house_number(c)["popisne"], t.parse_house_number(c)["orientacni"]), [
    ("Vinohradská 2128/175", "2128-175"), ("Plzeňská 12 / 3a, Praha", "12-3a"), ("Dlouhá 5", ""), ("123456/1", ""),
])
_worded("N11_praha_district_from_postcode", t.praha_district_from_postcode, [
    ("11000", "Praha 1"), ("120 00", "Praha 2"), ("19000", "Praha 9"), ("10000", None), ("60200", None), ("1100", None), (None, None),
])
_worded("N13_item_label_target", parsers.item_target, [
    ("Užitná plocha", "top:usable_area_m2"), ("uzitna plocha", "top:usable_area_m2"), ("VÝTAH", "feat:has_lift"),
    ("Neznámé", None), ("Poplatek RK z prodeje", "extra:rk_fee"), ("psč", "top:postcode"),
])
_worded("N14_cast_bool", lambda c: t.to_bool(c).cast("string"), [
    ("ano", "true"), (" Ne ", "false"), ("TRUE", "true"), ("0", "false"), ("možná", None), ("", None), (None, None),
])
_worded("N14_cast_int", t.to_int, [("12", 12), (" 7 ", 7), ("12.5", None), ("", None), ("x", None)], "INTEGER")
_worded("N15_blank_and_comma_decimal", lambda c: (t.to_float_comma(c) * 10).cast("int"), [
    (" 3,5 ", 35), ("3.5", 35), ("   ", None), ("abc", None), (None, None)], "INTEGER")
_worded("N16_number_with_suffix", lambda c: t.join_number_suffix(F.substring_index(c, ";", 1), F.substring_index(c, ";", -1)), [
    ("12;a", "12a"), ("12; ", "12"), (" ;b", None)])


@query(
    "N12_levenshtein_names",
    """SELECT c_custkey, levenshtein(c_name, 'Customer#000000100') AS edits,
 CASE WHEN levenshtein(c_name, 'Customer#000000100') <= 2 THEN levenshtein(c_name, 'Customer#000000100') ELSE -1 END AS capped
FROM customer""",
)
def _lev(spark, sf_dir):
    other = F.lit("Customer#000000100")
    return ad.table(spark, sf_dir, "customer").select(
        "c_custkey", F.levenshtein("c_name", other).alias("edits"),
        F.levenshtein("c_name", other, 2).alias("capped"),
    )


@query(
    "N17_category_codes",
    """SELECT p_partkey, CASE p_size % 7 WHEN 1 THEN 'byt' WHEN 2 THEN 'dum' WHEN 3 THEN 'pozemek' WHEN 4 THEN 'komercni'
 ELSE 'ostatni' END AS property_type, CASE p_size % 7 WHEN 2 THEN 'pronajem' WHEN 3 THEN 'drazba' ELSE 'prodej' END AS kind FROM part""",
)
def _codes(spark, sf_dir):
    code = F.col("p_size") % 7
    return ad.table(spark, sf_dir, "part").select(
        "p_partkey", parsers.property_type_of(code).alias("property_type"), parsers.kind_of(code).alias("kind")
    )


# --- segmentation and hedonic helpers -----------------------------------------------------


@query(
    "G1_price_per_area",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
    f"{r('CASE WHEN l_extendedprice > 5000 AND l_quantity > 3 THEN (l_extendedprice - 5000) / (l_quantity - 3) END')} AS ppm2 FROM lineitem",
)
def _ppm2(spark, sf_dir):
    return rounded(ad.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        s.ppm2(F.col("l_extendedprice") - 5000, F.col("l_quantity") - 3).alias("ppm2"),
    ))


@query(
    "G2_size_and_condition_buckets",
    f"""SELECT listing_id, CASE WHEN size_m2 - 4 <= 0 THEN 'unknown' WHEN size_m2 - 4 < 35 THEN '<35' WHEN size_m2 - 4 < 50 THEN '35-50'
 WHEN size_m2 - 4 < 70 THEN '50-70' WHEN size_m2 - 4 < 90 THEN '70-90' WHEN size_m2 - 4 < 120 THEN '90-120'
 WHEN size_m2 - 4 < 160 THEN '120-160' ELSE '>160' END AS size_bucket,
 CASE condition WHEN 'novostavba' THEN 'new' WHEN 'velmi_dobry' THEN 'very_good' WHEN 'po_rekonstrukci' THEN 'very_good'
 WHEN 'dobry' THEN 'good' WHEN 'pred_rekonstrukci' THEN 'needs_work' WHEN 'spatny' THEN 'ruin' ELSE 'unknown' END AS condition_bucket
FROM ({L})""",
)
def _buckets(spark, sf_dir):
    return ad.listings(spark, sf_dir).select(
        "listing_id", s.size_bucket(F.col("size_m2") - 4).alias("size_bucket"),
        s.condition_bucket(F.col("condition")).alias("condition_bucket"),
    )


@query(
    "G3_relaxed_keys_level_0_to_5",
    f"""WITH b AS (SELECT listing_id, city_district AS d, disposition AS disp, building_type AS bld,
   CASE WHEN size_m2 < 50 THEN '<50' WHEN size_m2 < 90 THEN '50-90' WHEN size_m2 < 160 THEN '90-160' ELSE '>160' END AS w,
   CASE WHEN condition IS NULL THEN 'unknown' WHEN condition = 'spatny' THEN 'ruin' ELSE 'any_habitable' END AS c
 FROM ({L}) JOIN ({P}) USING (property_id))
SELECT listing_id, level, CASE WHEN level >= 4 AND d LIKE 'Praha%' THEN 'Praha' ELSE d END AS district,
 w AS size_bucket, CASE WHEN level >= 2 THEN c END AS condition_bucket,
 CASE WHEN level < 3 THEN bld END AS building_type, CASE WHEN level < 5 THEN disp END AS disposition
FROM b, range(1, 6) g(level)""",
)
def _relax(spark, sf_dir):
    df = ad.listings(spark, sf_dir).join(
        ad.properties(spark, sf_dir).select("property_id", "city_district"), "property_id"
    )
    c = F.col
    key = s.segment_key(c("city_district"), c("property_type"), c("disposition"), c("ownership_type"),
                        c("building_type"), c("size_m2"), c("condition"))
    forms = F.array(*[
        F.struct(F.lit(i).alias("level"), s.relax(F.col("key"), i).alias("k")) for i in range(1, 6)
    ])
    return df.select("listing_id", key.alias("key")).select("listing_id", F.explode(forms).alias("f")).select(
        "listing_id", "f.level", F.col("f.k.city_district").alias("district"), "f.k.size_bucket",
        F.when(F.col("f.level") >= 2, F.col("f.k.condition_bucket")).alias("condition_bucket"),
        "f.k.building_type", "f.k.disposition",
    )


@query(
    "G4_parent_city",
    f"SELECT property_id, CASE WHEN city_district LIKE 'Praha%' THEN 'Praha' ELSE city_district END AS city FROM ({P})",
)
def _city(spark, sf_dir):
    return ad.properties(spark, sf_dir).select("property_id", s.parent_city(F.col("city_district")).alias("city"))


@query(
    "H1_H2_year_bucket_and_walkup",
    f"""SELECT listing_id, CASE WHEN year_built IS NULL THEN 'unknown' WHEN year_built < 1948 THEN '<1948' WHEN year_built < 1990 THEN '1948-1989'
 WHEN year_built < 2010 THEN '1990-2009' ELSE '2010+' END AS era,
 coalesce(has_lift = false AND floor_current = floor_total AND floor_total > 3, false) AS walkup FROM ({L})""",
)
def _era(spark, sf_dir):
    return ad.listings(spark, sf_dir).select(
        "listing_id", s.year_bucket(F.col("year_built")).alias("era"),
        s.top_floor_walkup(F.col("floor_current"), F.col("floor_total"), F.col("has_lift")).alias("walkup"),
    )


@query(
    "H5_undervaluation",
    f"""SELECT listing_id, {r("greatest(-50, least(50, (exp(ln(600) - ln(price / size_m2)) - 1) * 100))")} AS pct,
 {r("exp(ln(600)) * size_m2 - price")} AS amount FROM ({L})""",
)
def _under(spark, sf_dir):
    pred = F.log(F.lit(600.0))
    act = F.log(F.col("price") / F.col("size_m2"))
    return rounded(ad.listings(spark, sf_dir).select(
        "listing_id", s.undervaluation_pct(pred, act).alias("pct"),
        s.undervaluation_abs(pred, F.col("size_m2"), F.col("price")).alias("amount"),
    ))


# --- risk ---------------------------------------------------------------------------------

MEDIAN, P25 = 700.0, 500.0
OWN = "CASE WHEN ownership_type <> 'N' THEN ownership_type END"
FLAGS = {
    "price_too_low": f"price / size_m2 < 0.6 * {P25}",
    "legal_encumbrance": "description LIKE '%EXEKUCE%'",
    "druzstevni_mismarked": f"({OWN}) IS NULL AND price < {MEDIAN} * size_m2 * 0.85",
    "panel_capex_due": "coalesce(building_type = 'panel' AND year_built BETWEEN 1960 AND 1990, false) AND NOT description LIKE '%Revitaliz%'",
    "top_floor_no_lift": "coalesce(has_lift = false AND floor_current = floor_total AND floor_total > 3, false)",
    "class_g_energy": "energy_class IN ('F', 'G')",
    "photo_count_low": "coalesce(photo_count < 4, false)",
    "description_keywords": "description LIKE '%HAVARIJNÍ stav%'",
}
FLAG_LIST = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in FLAGS.items()) + ")"
RISK = "least(100, (" + " + ".join(f"CASE WHEN {c} THEN {s.SEVERITIES[n]} ELSE 0 END" for n, c in FLAGS.items()) + ") / 8 * 100)"


def _flags() -> Column:
    c = F.col
    return s.risk_flags(
        c("price"), c("size_m2"), F.when(c("ownership_type") != "N", c("ownership_type")), c("building_type"),
        c("year_built"), c("floor_current"), c("floor_total"), c("has_lift"), c("energy_class"), c("photo_count"),
        c("description"), F.lit(MEDIAN), F.lit(P25),
    )


@query(
    "R1_to_R9_risk_flags_and_score",
    f"SELECT listing_id, {FLAG_LIST} AS flags, {r(RISK)} AS risk FROM ({L})",
)
def _risk(spark, sf_dir):
    df = ad.listings(spark, sf_dir).select("listing_id", _flags().alias("f"))
    return rounded(df.select("listing_id", F.array_join("f", ",").alias("flags"), s.risk_score(F.col("f")).alias("risk")))


@query(
    "R2_R8_text_flags_on_documents",
    f"""SELECT doc_id, regexp_matches(text, '(?i){s.LEGAL_PATTERN}') AS legal, regexp_matches(text, '(?i){s.RUIN_PATTERN}') AS ruin FROM documents""",
)
def _text_flags(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select(
        "doc_id", s.legal_encumbrance(F.col("text")).alias("legal"), s.ruin_keywords(F.col("text")).alias("ruin")
    )


@query(
    "R10_wide_lexicons_on_folded_text",
    f"""SELECT listing_id, regexp_matches(lower(strip_accents(description)), '{s.WIDE_RISK_PATTERN}') AS risky,
 regexp_matches(lower(strip_accents(description)), '{s.POSITIVE_PATTERN}') AS positive FROM ({L})""",
)
def _lexicon(spark, sf_dir):
    folded = t.normalize_for_match(F.col("description"))
    return ad.listings(spark, sf_dir).select(
        "listing_id", folded.rlike(s.WIDE_RISK_PATTERN).alias("risky"), folded.rlike(s.POSITIVE_PATTERN).alias("positive")
    )


# --- confidence, liquidity, location, yield, composite ------------------------------------

FACTORS = {
    "sample": "1 / (1 + exp(-0.1 * (greatest(p_size - 2, 0) - 30)))",
    "relaxation": "1 - 0.4 * least(greatest(p_size % 8 - 1, 0), 5) / 5.0",
    "geo": "CASE p_size % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.6 ELSE 0.5 END",
    "fresh": "CASE WHEN p_size % 9 = 0 THEN 0.5 ELSE 1 - 0.5 * (least(greatest(p_size * 5 - 10, 30), 180) - 30) / 150.0 END",
}


def _precision(n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in ("rooftop", "parcel", "street", "source_gps", "locality")],
                         F.lit(None)), n)


@query(
    "C1_to_C5_confidence",
    f"""SELECT p_partkey, {", ".join(r(e) + " AS " + n for n, e in FACTORS.items())},
 round({" * ".join("(" + e + ")" for e in FACTORS.values())} * (p_size % 10) / 9.0 + 1.3e-7, 3) AS confidence FROM part""",
)
def _conf(spark, sf_dir):
    size = F.col("p_size")
    n, level, prec = size - 2, size % 8 - 1, _precision(size % 6)
    days = F.when(size % 9 != 0, size * 5 - 10)
    return rounded(ad.table(spark, sf_dir, "part").select(
        "p_partkey", s.sample_size_factor(n).alias("sample"), s.relaxation_factor(level).alias("relaxation"),
        s.precision_factor(prec).alias("geo"), s.freshness_factor(days).alias("fresh"),
        s.confidence(n, level, (size % 10) / 9.0, prec, days).alias("confidence"),
    ))


@query(
    "C4_age_in_whole_days",
    """SELECT event_id, CAST(greatest(floor(epoch_us(TIMESTAMP '2024-01-20 06:30:00') - epoch_us(ts)) / 86400000000.0, 0) AS BIGINT)
 AS days FROM events""".replace("floor(epoch_us(TIMESTAMP '2024-01-20 06:30:00') - epoch_us(ts)) / 86400000000.0", "floor((epoch_us(TIMESTAMP '2024-01-20 06:30:00') - epoch_us(ts)) / 86400000000.0)"),
)
def _age(spark, sf_dir):
    from workloads.registry import moment

    return ad.table(spark, sf_dir, "events").select(
        "event_id", s.age_days(F.col("ts"), moment("2024-01-20T06:30:00")).alias("days")
    )


@query(
    "A11_field_completeness",
    f"""SELECT listing_id, {r("(CAST(price IS NOT NULL AS INT) + CAST(size_m2 IS NOT NULL AS INT) + CAST(trim(disposition) <> '' AS INT) + CAST(ownership_type IS NOT NULL AS INT) + CAST(condition IS NOT NULL AS INT) + CAST(building_type IS NOT NULL AS INT) + 1 + CAST(year_built IS NOT NULL AS INT) + CAST(locality IS NOT NULL AS INT)) / 9.0")} AS completeness
FROM ({L}) LEFT JOIN ({P}) USING (property_id)""",
)
def _complete(spark, sf_dir):
    df = ad.listings(spark, sf_dir).join(ad.properties(spark, sf_dir), "property_id", "left")
    fields = {f: F.col(f) for f in s.CRITICAL_FIELDS} | {"city_district": F.col("locality")}
    return rounded(df.select("listing_id", s.completeness(fields).alias("completeness")))


@query(
    "Q1_Q2_liquidity",
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size * 4 - 20 END AS dom, CASE WHEN p_size % 4 > 0 THEN (p_size % 7 - 1) / 10.0 END AS turn FROM part),
y AS (SELECT p_partkey, turn, dom IS NULL AND turn IS NULL AS none, CASE WHEN coalesce(turn, 0.1) > 0 THEN -0.6 * greatest(coalesce(dom, 60), 0) - 0.4 / nullif(coalesce(turn, 0.1), 0) END AS raw FROM x)
SELECT p_partkey, CASE WHEN NOT none AND raw IS NOT NULL THEN {r("raw")} END AS raw,
 CASE WHEN none THEN NULL WHEN raw IS NULL THEN {r("0.0")} ELSE {r("least(100, greatest(0, (raw + 100) / 90 * 100))")} END AS score FROM y""",
)
def _liq(spark, sf_dir):
    size = F.col("p_size")
    dom = F.when(size % 5 > 0, size * 4 - 20)
    turn = F.when(size % 4 > 0, (size % 7 - 1) / 10.0)
    raw = s.raw_liquidity(dom, turn)
    return rounded(ad.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(raw > float("-inf"), raw).alias("raw"), s.liquidity_score(dom, turn).alias("score")
    ))


@query(
    "L1_to_L5_location",
    f"""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS metro, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 2 END AS tram,
  CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 12 END AS grocery, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal / 3 END AS park, CASE WHEN c_custkey % 2 > 0 THEN c_acctbal / 20 END AS road FROM customer),
y AS (SELECT c_custkey, least(100, greatest(0, 100 * (1 - (least(metro, tram) - 300) / 1700))) AS transit, CASE WHEN grocery IS NOT NULL THEN least(100, (grocery * 2) / 20.0 * 100) END AS amenities,
  CASE WHEN park IS NOT NULL THEN least(100, greatest(0, 100 * (1 - (park - 300) / 1200))) END AS green, CASE WHEN road IS NOT NULL THEN least(100, greatest(0, 100 * (road - 20) / 180)) END AS quiet,
  metro IS NULL AND tram IS NULL AS no_transit FROM x),
z AS (SELECT c_custkey, CASE WHEN NOT no_transit THEN transit END AS transit, amenities, green, quiet FROM y)
SELECT c_custkey, {r("transit")} AS transit, {r("amenities")} AS amenities, {r("green")} AS green, {r("quiet")} AS quiet,
 {r("list_avg([transit, amenities, green, quiet])")} AS composite FROM z""",
)
def _loc(spark, sf_dir):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    n = (k % 12).cast("int")
    counts = F.when(k % 5 > 0, F.create_map(F.lit("grocery"), n, F.lit("school"), n, F.lit("zoo"), n))
    loc = s.location_breakdown(
        F.when(k % 3 > 0, b), F.when(k % 4 > 0, b / 2), F.lit(None).cast("double"), counts, F.when(k % 7 > 0, b / 3),
        F.when(k % 2 > 0, b / 20),
    )
    return rounded(ad.table(spark, sf_dir, "customer").select("c_custkey", loc.alias("l")).select("c_custkey", "l.*"))


@query(
    "Y1_Y2_Y3_rental_yield",
    f"""WITH x AS (SELECT listing_id, price * 50 AS price, size_m2, floor_current * 6 AS n, floor_total - 1 AS lv, CASE WHEN has_lift THEN 900.0 END AS hoa,
   CASE WHEN year_built IS NOT NULL THEN 300.0 + floor_current END AS rent FROM ({L})),
u AS (SELECT *, rent IS NOT NULL AND n >= 10 AND price > 0 AND size_m2 > 0 AS ok, rent * size_m2 AS monthly, coalesce(hoa, 50 * size_m2) * 12 AS annual FROM x)
SELECT listing_id, CASE WHEN ok THEN {r("least(25, greatest(-5, (monthly * 12 - annual) / price * 100))")} END AS gross_pct,
 {r("CASE WHEN ok THEN round(CASE WHEN n >= 30 THEN 1 ELSE 0.5 END * (1 - 0.4 * least(greatest(lv, 0), 5) / 5.0) * CASE WHEN hoa IS NULL THEN 0.5 ELSE 1 END + 1.3e-7, 3) ELSE 0 END")} AS confidence,
 CASE WHEN ok THEN {r("monthly")} END AS monthly_rent, CASE WHEN ok THEN {r("annual")} END AS annual_hoa, ok AND hoa IS NULL AS default_hoa,
 CASE WHEN ok THEN {r("(monthly * 12 * (1 - 0.05 - 0.1) - annual - 5 * size_m2) / price * 100")} END AS net_pct FROM u""",
)
def _yield(spark, sf_dir):
    price = F.col("price") * 50
    rent = F.when(F.col("year_built").isNotNull(), 300.0 + F.col("floor_current"))
    y = s.rental_yield(price, F.col("size_m2"), F.when(F.col("has_lift"), 900.0), rent, F.col("floor_current") * 6,
                       F.col("floor_total") - 1)
    df = ad.listings(spark, sf_dir).select("listing_id", price.alias("price"), "size_m2", y.alias("y"))
    net = s.net_yield_pct(F.col("price"), F.col("size_m2"), F.col("y.monthly_rent"), F.col("y.annual_hoa"))
    return rounded(df.select("listing_id", "y.*", net.alias("net_pct")))


@query(
    "K1_K2_composite",
    f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value / 10 - 20 END AS u, CASE WHEN event_id % 4 > 0 THEN value / 50 END AS y,
  CASE WHEN event_id % 5 > 0 THEN 0.4 END AS yc, CASE WHEN event_id % 6 > 0 THEN least(value, 100) END AS liq, CASE WHEN event_id % 7 > 0 THEN value / 5 END AS risk FROM events),
t AS (SELECT event_id, coalesce(1.5 * u / 15, 0) + coalesce(0.6 * (y - 4.5) / 1.5 * coalesce(yc, 0), 0) + coalesce(0.3 * (liq - 50) / 20, 0) + coalesce(-0.8 * (risk - 10) / 15, 0) AS z FROM x)
SELECT event_id, {r("100 / (1 + exp(-z))")} AS composite FROM t""",
)
def _composite(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    parts = {
        "undervaluation_pct": F.when(e % 3 > 0, v / 10 - 20), "yield_gross_pct": F.when(e % 4 > 0, v / 50),
        "liquidity_score": F.when(e % 6 > 0, F.least(v, F.lit(100.0))), "location_score": F.lit(None),
        "risk_score": F.when(e % 7 > 0, v / 5),
    }
    out = s.composite_score(parts, F.when(e % 5 > 0, F.lit(0.4)), s.ScoringConfig(s.WEIGHTS_V1, s.DEFAULT_REFS))
    return rounded(ad.table(spark, sf_dir, "events").select("event_id", out.alias("composite")))


@query(
    "K4_decimal_formatting",
    """SELECT event_id, CAST(CASE WHEN value > 100 THEN CAST(value AS DECIMAL(14, 2)) END AS DOUBLE) AS stored FROM events""",
)
def _decimal(spark, sf_dir):
    v = F.col("value")
    odd = F.when(v > 100, v).when(v > 50, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return ad.table(spark, sf_dir, "events").select("event_id", s.to_decimal(odd, 2).cast("double").alias("stored"))


@query(
    "K5_explanations",
    f"""SELECT listing_id, concat_ws(' ', 'Predicted 600 per m2; listed at ' || printf('%.0f', price / size_m2 + 1e-9) || ': ' || printf('%.1f', floor_current * 1.5 + 0.01) || '% under model.',
 CASE WHEN floor_total > 2 THEN 'Segment has ' || floor_total || ' comparable listings in ' || coalesce(locality, 'null') || '.' END,
 CASE WHEN energy_class IN ('F', 'G') THEN 'Risk flags: class_g_energy.' END) AS explanation FROM ({L}) LEFT JOIN ({P}) USING (property_id)""",
)
def _explain(spark, sf_dir):
    df = ad.listings(spark, sf_dir).join(ad.properties(spark, sf_dir), "property_id", "left")
    flags = F.array_compact(F.array(F.when(s.poor_energy(F.col("energy_class")), F.lit("class_g_energy"))))
    out = s.explanation(
        F.log(F.lit(600.0)), F.log(F.col("price") / F.col("size_m2") + 1e-9), F.col("floor_current") * 1.5 + 0.01,
        F.when(F.col("floor_total") > 2, F.col("floor_total")), F.col("locality"), flags,
    )
    return df.select("listing_id", F.array_join(out, " ").alias("explanation"))


@query("X10_grid_to_wgs84")
def _grid(spark, sf_dir):
    pts = ad.table(spark, sf_dir, "customer").select(
        "c_custkey", (-1040000.0 - F.col("c_custkey") % 9973).alias("x"), (-740000.0 - F.col("c_acctbal")).alias("y")
    )
    return geo.with_wgs84(pts, "x", "y").select("c_custkey", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))

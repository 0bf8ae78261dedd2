"""Text normalisers, item routing and parser fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import text as t
from parcelwise.sources import parsers


def table(spark, fn, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", fn(F.col("s")).alias("v")).collect()}
    return [(cases[i][0], got[i]) for i in range(len(cases))]


@pytest.mark.parametrize("fn,cases", [
    (t.strip_diacritics, [("Náměstí Míru", "Namesti Miru"), ("Příliš žluťoučký kůň", "Prilis zlutoucky kun"), (None, None), ("é", "e"), ("m²", "m2")]),
    (t.strip_diacritics_full, [("Náměstí ﬁ ½", "Namesti fi 1⁄2"), (None, None)]),
    (t.normalize_for_match, [("  Náměstí  Míru\n", "namesti miru")]),
    (t.parse_disposition, [("2+kk", "2+kk"), ("2 + KK", "2+kk"), ("byt 3+1, 70 m²", "3+1"), ("Garsoniéra", "garsoniera"), ("8+1", "6+"), ("atypický", "atypicky"), ("x", None)]),
    (t.parse_ownership, [("Osobní", "osobni"), ("DV", "druzstevni"), ("Státní / obecní", "statni"), ("družstevní", "druzstevni"), ("družstevní s převodem do OV", "osobni")]),
    (t.parse_condition, [("Před rekonstrukcí", "pred_rekonstrukci"), ("velmi dobrý", "velmi_dobry"), ("ve velmi dobrém", None)]),
    (t.parse_energy_class, [("C - úsporná", "C"), ("ČB", None), ("g", "G")]),
    (lambda c: t.parse_floor(c)["current"], [("2. patro z 5", 2), ("přízemí", 0), ("4/5", 4), ("7", 7), ("?", None), ("99999999999", None)]),
    (t.normalize_address, [("ul. Dlouhá  5", "ulice Dlouhá 5"), ("nám. Míru", "naměsti Míru"), ("č.p. 12", "12")]),
    (lambda c: t.parse_house_number(c)["orientacni"], [("Vinohradská 2128/175", "175"), ("Dlouhá 5/7B", "7B"), ("Dlouhá 5", None)]),
    (t.praha_district_from_postcode, [("110 00", "Praha 1"), ("19000", "Praha 9"), ("10200", None), ("60200", None)]),
    (t.to_bool, [("ANO", True), ("ne", False), ("2", None)]),
])
def test_normalisers(spark, fn, cases):
    assert table(spark, fn, cases) == cases


def detail(**over):
    base = {
        "name": {"value": "Prodej bytu 2+kk, 56 m²"}, "meta_description": "3+1 osobní", "price": 6_950_000, "price_czk": {"value_raw": 6_950_000},
        "locality": {"value": "Praha 5 - Smíchov"}, "gps": {"lat": 50.0721, "lon": 14.4044}, "seo": {"category_main_cb": 1, "category_type_cb": 1},
        "text": {"value": " Krásný byt "},
        "items": [{"name": n, "value": v, "unit": u} for n, v, u in [
            ("Užitná plocha", 56, "m²"), ("Stavba", "Cihlová", None), ("Stav objektu", "Po rekonstrukci", None), ("Vlastnictví", "Osobní", None),
            ("Poschodí", "3. patro z 5", None), ("Rok kolaudace", 1932, None), ("Energetická náročnost budovy", "C", None), ("Výtah", "ano", None),
            ("Lodžie", "ne", None), ("PSČ", "150 00", None), ("Zastavěná plocha", 80, "m²")]],
    }
    base.update(over)
    return {k: v for k, v in base.items() if v is not ...}


def parse(spark, *docs):
    rows = [("portal", str(i), "https://portal.example/1", json.dumps(d, ensure_ascii=False) if not isinstance(d, str) else d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "source_slug string, source_listing_id string, canonical_url string, payload string").withColumn("fetched_at", F.current_timestamp())
    return sorted(parsers.parse_all(df).collect(), key=lambda r: int(r.source_listing_id))


def test_detail_document(spark):
    (r,) = parse(spark, detail())
    assert (r.parse_status, r.property_type, r.listing_kind, int(r.price), r.price_hidden) == ("ok", "byt", "prodej", 6_950_000, False)
    assert (float(r.usable_area_m2), r.size_m2, r.disposition, r.ownership_type, r.building_type) == (56.0, None, "2+kk", "osobni", "cihla")
    assert (r.condition, r.energy_class, r.floor_current, r.floor_total, r.year_built) == ("po_rekonstrukci", "C", 3, 5, 1932)
    assert (r.has_lift, r.has_loggia, r.has_balcony, r.postcode, r.description) == (True, False, None, "150 00", "Krásný byt")
    assert (r.lat, r.city_district, r.locality) == (50.0721, None, "Praha 5 - Smíchov")
    assert json.loads(r.extra_features["zastavena_plocha_m2"]) == {"value": "80", "unit": "m²"} and r.unknown_keys == []


def test_variants(spark):
    docs = [
        detail(price_czk={}, price=...), detail(price_czk=8_690_000, price=...), detail(price_czk={"value_raw": 1}), detail(price_hidden=True),
        detail(price_czk={}, price=5), detail(gps=None, map={"lat": "50.0528", "lon": 14.3374}), detail(gps={"lat": 95, "lon": 14}, map={"lat": 1, "lon": 2}),
        detail(locality={"value": "Toyen, Praha 5 - Smíchov"}), detail(locality={"value": "Dlouhá, Brno"}), detail(locality="plain"),
        detail(items=[{"name": "Vymyšlený atribut", "value": 5}, {"name": "vytah", "value": "ne"}, {"value": 1}, {"name": "Výtah", "value": "ano"}]),
        detail(seo={"category_main_cb": 1}), "{broken", detail(name="Dům 5+1", seo={"category_main_cb": "2", "category_type_cb": 9}),
        detail(items=[{"name": "Rok kolaudace", "value": 1500}]), detail(currency="EUR"), detail(name=None, meta_description=None),
        detail(items=None), "[]", detail(items=[{"name": "anuita_czk", "value": 1}, {"name": "Anuita", "value": 2}]),
    ]
    r = parse(spark, *docs)
    assert [(x.price_hidden, x.price and int(x.price)) for x in r[:5]] == [(True, None), (False, 8_690_000), (True, None), (True, None), (False, 5)]
    assert (r[5].lat, r[5].lon) == (50.0528, 14.3374) and (r[6].lat, r[6].lon) == (1.0, 2.0)
    assert (r[7].city_district, r[7].locality) == ("Praha 5", "Smíchov") and (r[8].city_district, r[8].locality) == ("Brno", "Dlouhá, Brno")
    assert r[9].locality is None
    assert r[10].unknown_keys == ["Vymyšlený atribut"] and r[10].extra_features == {"Vymyšlený atribut": "5"} and r[10].has_lift is True
    assert (r[11].parse_status, r[11].parse_error) == ("quarantine", "category codes are missing")
    assert (r[12].parse_status, r[12].parse_error) == ("quarantine", "payload is not a JSON object")
    assert (r[13].property_type, r[13].listing_kind, r[13].disposition) == ("dum", "prodej", "5+1")
    assert r[14].parse_error == "implausible year_built" and r[15].parse_error == "currency is not CZK"
    assert r[16].disposition is None and r[17].parse_status == "ok" and r[18].parse_status == "quarantine"
    assert r[19].extra_features == {"anuita_czk": "2"}


def test_only_one_plain_text_is_cut_out_of_a_value_object(spark):
    shapes = ['{"value":"a"}', '{"value":""}', '{"value":"a\\"b"}', '{"value":"a","x":"b"}', '{"x":"b","value":"a"}', '{"value":null}',
              '{"value":7}', '{"value":"\\u00e9"}', '{"value":"', '{"value":"}', "text", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string").select(
        "i", parsers.value_of(F.col("s")).alias("v")).collect()
    assert [r.v for r in sorted(got)] == ["a", "", 'a"b', "a", "a", None, "7", "é", None, None, None, None]


def test_items_are_routed_once_and_the_last_of_a_label_wins(spark):
    item = "array<struct<name:string,value:string,unit:string,type:string>>"
    rows = spark.createDataFrame([(1, [("Stavba", "a", None, None), (None, "x", None, None), ("Anuita", "1", "Kč", None), ("neco", "2", None, None),
                                       ("stavba", "b", None, None), ("neco", "3", None, None)]), (2, None), (3, [])], f"i int, items {item}")
    got = rows.select("i", parsers.routed_items(F.col("items")).alias("r")).select(
        "i", parsers.newest_value(F.col("r.key"), F.col("r.value"), "top:building_type_raw").alias("b"),
        parsers.extra_features(parsers.loose_facts(F.col("r"))).alias("x"), parsers.unknown_labels(parsers.loose_facts(F.col("r"))).alias("u"))
    assert [(r.b, r.x, r.u) for r in sorted(got.collect())] == [
        ("b", {"anuita_czk": '{"value":"1","unit":"Kč"}', "neco": "3"}, ["neco"]), (None, {}, []), (None, {}, [])]

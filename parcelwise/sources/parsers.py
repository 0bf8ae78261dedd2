"""Parsers per feed: raw payload rows to canonical listing columns.

A parser is a function DataFrame -> DataFrame made of Column expressions; registering one under a
feed's slug is all a new feed needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import text as t
from parcelwise.functions.keys import fixed_map, let
from parcelwise.schemas import DETAIL, FEATURES, VOCABULARIES

Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {}
PARSER_VERSION = "portal-1"


def parser(slug: str) -> Callable[[Parser], Parser]:
    def keep(fn: Parser) -> Parser:
        PARSERS[slug] = fn
        return fn

    return keep


# Label of an item on the detail page to its target. "top" fills a column,
# "feat" a toggle, "extra" the free-form map.
ITEM_TARGETS = {
    "Užitná plocha": "top:usable_area_m2",
    "Plocha podlahová": "top:size_m2",
    "Celková plocha": "top:size_m2",
    "Plocha pozemku": "top:land_area_m2",
    "Zastavěná plocha": "extra:zastavena_plocha_m2",
    "Plocha zahrady": "extra:plocha_zahrady_m2",
    "Stavba": "top:building_type_raw",
    "Stav objektu": "top:condition_raw",
    "Vlastnictví": "top:ownership_raw",
    "Druh objektu": "extra:druh_objektu",
    "Typ domu": "extra:typ_domu",
    "Rok kolaudace": "top:year_built",
    "Rok rekonstrukce": "extra:year_renovated",
    "Poschodí": "top:floor_text",
    "Energetická náročnost budovy": "top:energy_class_raw",
    "Třída energetické náročnosti": "top:energy_class_raw",
    "Výtah": "feat:has_lift",
    "Balkón": "feat:has_balcony",
    "Lodžie": "feat:has_loggia",
    "Terasa": "feat:has_terrace",
    "Sklep": "feat:has_cellar",
    "Garáž": "feat:has_garage",
    "Parkování": "feat:has_parking",
    "Bezbariérový": "feat:bezbarierovy",
    "Vybavení": "feat:vybaveni",
    "Anuita": "extra:anuita_czk",
    "Náklady na bydlení": "extra:naklady_bydleni_czk",
    "Poplatek RK z prodeje": "extra:rk_fee",
    "PSČ": "top:postcode",
    "Půdní vestavba": "extra:pudni_vestavba",
    "Bezbariérový přístup": "feat:bezbariery",
}
# Category codes.
PROPERTY_TYPE_OF_CODE = {1: "byt", 2: "dum", 3: "pozemek", 4: "komercni", 5: "ostatni"}
KIND_OF_CODE = {1: "prodej", 2: "pronajem", 3: "drazba"}


def item_target(name: Column) -> Column:
    """Target of an item label: exact label first, then its folded lower-case form."""
    folded = {t._fold_python(k).lower(): v for k, v in ITEM_TARGETS.items()}
    return F.coalesce(
        fixed_map(ITEM_TARGETS)[name], fixed_map(folded)[F.lower(t.strip_diacritics(name))]
    )


def property_type_of(code: Column) -> Column:
    return F.coalesce(fixed_map(PROPERTY_TYPE_OF_CODE)[code], F.lit("ostatni"))


def kind_of(code: Column) -> Column:
    return F.coalesce(fixed_map(KIND_OF_CODE)[code], F.lit("prodej"))


def json_int(col: Column) -> Column:
    """Whole part of a JSON number, or an integer written as text."""
    whole = F.trim(col).try_cast("bigint")
    decimal = F.when(col.rlike(r"^-?\d+\.\d+([eE]\+?\d+)?$"), col.try_cast("double"))
    return F.coalesce(whole, decimal.try_cast("bigint"))


def value_of(col: Column) -> Column:
    """``value`` of an object read as text; NULL for any other shape.

    An object of one plain text, as feeds send it, is cut out; any other is read as JSON.
    """
    inner = F.substring(col, 11, F.length(col) - 12)
    plain = (
        F.startswith(col, F.lit('{"value":"')) & F.endswith(col, F.lit('"}')) & (F.length(col) >= 12)
        & ~F.contains(inner, F.lit('"')) & ~F.contains(inner, F.lit("\\"))
    )
    return F.when(plain, inner).when(
        F.startswith(col, F.lit("{")), F.get_json_object(col, "$.value")
    )


def listed_price(price_czk: Column, price: Column, hidden: Column) -> Column:
    """struct<price, hidden> from the shapes a price comes in."""
    shown = F.when(
        F.startswith(price_czk, F.lit("{")), F.get_json_object(price_czk, "$.value_raw")
    ).otherwise(price_czk)
    # read once per row, however often the amount is looked at
    return let(F.coalesce(let(shown, json_int), json_int(price)), lambda amount: _priced(amount, hidden))


def _priced(amount: Column, hidden: Column) -> Column:
    is_hidden = (
        F.coalesce(~F.lower(hidden).isin("", "false", "0", "[]", "{}"), F.lit(False))
        | amount.isNull()
        | amount.isin(0, 1)
    )
    return F.struct(F.when(~is_hidden, amount).alias("price"), is_hidden.alias("hidden"))


def coordinates(gps: Column, fallback: Column) -> Column:
    """struct<lat, lon>: the first of the two that holds a valid point, else NULL."""

    def valid(src: Column) -> Column:
        lat, lon = src["lat"].try_cast("double"), src["lon"].try_cast("double")
        ok = lat.between(-90, 90) & lon.between(-180, 180)
        return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))

    return F.coalesce(valid(gps), valid(fallback))


def split_locality(whole: Column) -> Column:
    """struct<city_district, locality> from 'Street, District - Quarter'."""
    comma = F.instr(whole, ",")
    tail = F.trim(F.substring(whole, comma + 1, F.length(whole)))
    dash = F.instr(tail, " - ")
    has_comma, has_dash = comma > 0, dash > 0
    district = F.when(
        has_comma,
        F.when(has_dash, t.non_blank(F.substring_index(tail, " - ", 1)))
        .otherwise(t.non_blank(tail)),
    )
    rest = t.non_blank(F.substring(tail, dash + 3, F.length(tail)))
    locality = F.when(has_comma & has_dash, F.coalesce(rest, whole)).otherwise(whole)
    return F.struct(district.alias("city_district"), locality.alias("locality"))


_ITEMS = "array<struct<name:string,value:string,unit:string,type:string>>"
_RAW = "raw:"


def routed_items(items: Column) -> Column:
    """array<struct<key, value, unit>> of the items, the last one first: ``key`` is the target of the
    label, 'raw:<label>' for an unknown one, NULL for a nameless item."""
    return F.reverse(
        F.transform(
            F.coalesce(items, F.array().cast(_ITEMS)),
            lambda i: F.struct(
                F.coalesce(item_target(i["name"]), F.concat(F.lit(_RAW), i["name"])).alias("key"),
                i["value"].alias("value"), i["unit"].alias("unit"),
            ),
        )
    )


def newest_value(keys: Column, values: Column, key: str) -> Column:
    """Value of the last item with this target, from the columns of :func:`routed_items`."""
    return F.get(values, F.array_position(keys, key).cast("int") - 1)


def loose_facts(routed: Column) -> Column:
    """map<target, struct<value, unit>> of the free-form items; the last item of a target wins."""
    loose = F.filter(
        routed,
        lambda e: F.startswith(e["key"], F.lit("extra:")) | F.startswith(e["key"], F.lit(_RAW)),
    )

    def newest(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: F.array_position(entries["key"], e["key"]) == i + 1)

    return F.map_from_entries(
        F.transform(
            F.reverse(let(loose, newest)),
            lambda e: F.struct(
                e["key"].alias("key"), F.struct(e["value"].alias("value"), e["unit"].alias("unit")).alias("value")
            ),
        )
    )


def extra_features(facts: Column) -> Column:
    """map of free-form facts: unknown labels as they are, 'extra' targets with their unit. A label
    spelled like an 'extra' target gives way to it."""
    label = lambda k: F.substring(k, F.instr(k, ":") + 1, F.length(k))
    loose = F.map_filter(
        facts,
        lambda k, _: F.startswith(k, F.lit("extra:"))
        | (
            F.startswith(k, F.lit(_RAW))
            & ~F.map_contains_key(facts, F.concat(F.lit("extra:"), label(k)))
        ),
    )
    shown = F.transform_values(
        loose,
        lambda k, v: F.when(
            F.startswith(k, F.lit("extra:")) & (v["unit"] != ""), F.to_json(v)
        ).otherwise(v["value"]),
    )
    return F.transform_keys(shown, lambda k, _: label(k))


def unknown_labels(facts: Column) -> Column:
    raw = F.filter(F.map_keys(facts), lambda k: F.startswith(k, F.lit(_RAW)))
    return F.transform(raw, lambda k: F.substring(k, len(_RAW) + 1, F.length(k)))


@parser("portal")
def parse_detail(raw: DataFrame) -> DataFrame:
    """Detail documents (source_slug, source_listing_id, fetched_at, canonical_url, payload) to
    canonical columns plus parse_status and parse_error.

    Each stage is a projection of its own, so shared pieces (folded texts, routed items) are
    computed once per row.
    """
    doc = raw.withColumn("d", F.from_json("payload", DETAIL))
    cut = doc.select(
        *raw.columns,
        # a document that fails to parse yields all-NULL fields; only then look at it again
        F.when(
            F.coalesce("d.name", "d.price", "d.price_czk", "d.locality", "d.text",
                       F.col("d.seo").cast("string"), F.col("d.items").cast("string")).isNull(),
            F.json_object_keys("payload").isNull(),
        ).otherwise(F.col("payload").isNull()).alias("__bad_json"),
        json_int(F.col("d.seo.category_main_cb")).cast("int").alias("__main"),
        json_int(F.col("d.seo.category_type_cb")).cast("int").alias("__type"),
        listed_price(F.col("d.price_czk"), F.col("d.price"), F.col("d.price_hidden")).alias("__price"),
        coordinates(F.col("d.gps"), F.col("d.map")).alias("__geo"),
        F.trim(value_of(F.col("d.locality"))).alias("__loc"),
        F.trim(value_of(F.col("d.text"))).alias("description"),
        F.coalesce(
            value_of(F.col("d.name")),
            F.when(~F.startswith(F.col("d.name"), F.lit("{")), F.col("d.name")),
        ).alias("__name"),
        F.col("d.meta_description").alias("__meta"),
        F.coalesce(t.non_blank(F.col("d.currency")), F.lit("CZK")).alias("currency"),
        routed_items(F.col("d.items")).alias("__items"),
        F.filter(
            F.coalesce("d._embedded.images", F.array().cast("array<struct<url:string,width:int,height:int>>")),
            lambda p: t.non_blank(p["url"]).isNotNull(),
        ).alias("photos"),
    )
    split = cut.select(
        "*", F.col("__items.key").alias("__keys"), F.col("__items.value").alias("__values"),
        loose_facts(F.col("__items")).alias("__facts"),
    )
    top = lambda k: newest_value(F.col("__keys"), F.col("__values"), f"top:{k}")
    fields = split.select(
        "*",
        *[
            top(k).alias(f"__{k}")
            for k in ["usable_area_m2", "size_m2", "land_area_m2", "year_built", "energy_class_raw", "postcode"]
        ],
        *[
            t.normalize_for_match(top(k)).alias(f"__{k}")
            for k in ["building_type_raw", "condition_raw", "ownership_raw", "floor_text"]
        ],
        split_locality(F.col("__loc")).alias("__place"),
    ).withColumn("__floor", t.floor_of(F.col("__floor_text")))
    listing = fields.select(
        *raw.columns,
        kind_of(F.col("__type")).alias("listing_kind"),
        property_type_of(F.col("__main")).alias("property_type"),
        F.col("__price.price").cast("decimal(14,2)").alias("price"),
        F.col("__price.hidden").alias("price_hidden"),
        "currency",
        t.to_decimal(F.col("__size_m2"), 10).alias("size_m2"),
        t.to_decimal(F.col("__usable_area_m2"), 10).alias("usable_area_m2"),
        t.to_decimal(F.col("__land_area_m2"), 12).alias("land_area_m2"),
        F.col("__floor.current").alias("floor_current"),
        F.col("__floor.total").alias("floor_total"),
        t.to_int(F.col("__year_built")).alias("year_built"),
        F.coalesce(
            t.parse_disposition(F.col("__name")), t.parse_disposition(F.col("__meta")),
            t.parse_disposition(F.col("__loc")),
        ).alias("disposition"),
        t.ownership_of(F.col("__ownership_raw")).alias("ownership_type"),
        t.building_type_of(F.col("__building_type_raw")).alias("building_type"),
        t.condition_of(F.col("__condition_raw")).alias("condition"),
        t.parse_energy_class(F.col("__energy_class_raw")).alias("energy_class"),
        F.col("__loc").alias("address_raw"),
        F.col("__place.locality").alias("locality"),
        F.col("__place.city_district").alias("city_district"),
        F.trim("__postcode").alias("postcode"),
        F.col("__geo.lat").alias("lat"),
        F.col("__geo.lon").alias("lon"),
        *[
            t.to_bool(newest_value(F.col("__keys"), F.col("__values"), f"feat:{f}")).alias(f)
            for f in FEATURES[:7]
        ],
        "description",
        F.lit("active").alias("status"),
        extra_features(F.col("__facts")).alias("extra_features"),
        unknown_labels(F.col("__facts")).alias("unknown_keys"),
        "photos",
        F.lit(PARSER_VERSION).alias("parser_version"),
        F.array(
            F.when(F.col("__bad_json"), "payload is not a JSON object"),
            F.when(
                ~F.col("__bad_json") & (F.col("__main").isNull() | F.col("__type").isNull()),
                "category codes are missing",
            ),
        ).alias("__errors"),
    )
    return validated(listing, listing_rules(), prior="__errors")


Rule = tuple[Column, str]


def listing_rules(this_year: Column | None = None) -> list[Rule]:
    """(violated, message) pairs; a violated rule sends the row to quarantine."""
    year = this_year if this_year is not None else F.year(F.current_date())
    c = F.col
    rules: list[Rule] = [
        (c("source_slug").isNull() | c("source_listing_id").isNull(), "identity is missing"),
        (~c("lat").between(-90, 90), "latitude out of range"),
        (~c("lon").between(-180, 180), "longitude out of range"),
        (c("currency") != "CZK", "currency is not CZK"),
        ((c("year_built") < 1700) | (c("year_built") > year + 5), "implausible year_built"),
        (c("price") < 0, "negative price"),
        (c("size_m2") <= 0, "size is not positive"),
    ]
    for name in ("property_type", "listing_kind", "disposition", "ownership_type",
                 "building_type", "condition", "energy_class"):
        rules.append((~c(name).isin(VOCABULARIES[name]), f"unknown {name}"))
    return rules


def validated(df: DataFrame, rules: Sequence[Rule], prior: str | None = None) -> DataFrame:
    """Add parse_status ('ok' or 'quarantine') and parse_error (at most 1000 characters)."""
    found = [F.when(bad, F.lit(msg)) for bad, msg in rules]
    out = df.withColumn("__found", F.concat_ws("; ", *([F.col(prior)] if prior else []), *found))
    return out.select(
        *[c for c in df.columns if c != prior],
        F.when(F.col("__found") == "", "ok").otherwise("quarantine").alias("parse_status"),
        F.when(F.col("__found") != "", F.substring("__found", 1, 1000)).alias("parse_error"),
    )


def parse_all(raw: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Run every registered parser over its own feed's rows."""
    used = parsers or PARSERS
    parts = [fn(raw.where(F.col("source_slug") == slug)) for slug, fn in used.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

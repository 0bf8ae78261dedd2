"""Segmentation and scoring formulas as Column expressions.

Every function takes and returns Columns; nothing here needs Python at run time, so a whole
score row stays inside one code-generated projection.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.keys import fixed_map

# Size brackets in m2 as (exclusive upper bound, label).
SIZE_BRACKETS = [
    (35.0, "<35"),
    (50.0, "35-50"),
    (70.0, "50-70"),
    (90.0, "70-90"),
    (120.0, "90-120"),
    (160.0, "120-160"),
]
TOP_SIZE_BRACKET = ">160"
UNKNOWN = "unknown"

# Size bracket to the wider bracket used from relaxation level 1 on.
WIDER_SIZE = {
    "<35": "<50",
    "35-50": "<50",
    "50-70": "50-90",
    "70-90": "50-90",
    "90-120": "90-160",
    "120-160": "90-160",
    ">160": ">160",
}

# Condition to condition bracket.
CONDITION_BRACKETS = {
    "novostavba": "new",
    "velmi_dobry": "very_good",
    "po_rekonstrukci": "very_good",
    "dobry": "good",
    "pred_rekonstrukci": "needs_work",
    "v_rekonstrukci": "needs_work",
    "spatny": "ruin",
    "projekt": "new",
}

# Fields whose presence makes a listing complete.
CRITICAL_FIELDS = [
    "price",
    "size_m2",
    "disposition",
    "ownership_type",
    "condition",
    "building_type",
    "floor_current",
    "year_built",
    "city_district",
]

# Address precision to confidence factor.
PRECISION_FACTORS = {
    "rooftop": 1.0,
    "parcel": 0.95,
    "street": 0.85,
    "source_gps": 0.6,
    "locality": 0.5,
}

# Risk flag to severity, in reporting order.
SEVERITIES = {
    "price_too_low": 3.0,
    "legal_encumbrance": 3.0,
    "druzstevni_mismarked": 3.0,
    "panel_capex_due": 2.0,
    "top_floor_no_lift": 1.0,
    "class_g_energy": 1.0,
    "photo_count_low": 1.0,
    "description_keywords": 2.0,
}
SEVERITY_FOR_100 = 8.0

# Description patterns.
LEGAL_PATTERN = "exekuc|dražb|břemen|předkupní|zástavní|dluh"
REVITALISED_PATTERN = "revitaliz"
RUIN_PATTERN = "havarijní stav|na demolici|k demolici|neobyvatel"
# Fixed values, described in the scoring notes only: wider lexicons for folded text.
WIDE_RISK_PATTERN = (
    "exekuc|drazb|bremen|predkupni|zastavni|dluh|insolvenc|insolventn|zatizen|"
    "spoluvlastnic|na demolic|havarijni stav|sporn[ae]"
)
POSITIVE_PATTERN = (
    "revitaliz|zatepl|po rekonstrukci|po kompletni rekonstrukci|bezbarier|kolaudac|protokol"
)

# Amenity kinds counted within 800 m.
AMENITY_KINDS = ["grocery", "cafe", "restaurant", "pharmacy", "school"]

COMPONENTS = [
    "undervaluation_pct",
    "yield_gross_pct",
    "liquidity_score",
    "location_score",
    "risk_score",
]
# Weights of the first model version and the default component distributions.
WEIGHTS_V1 = {
    "undervaluation_pct": 1.5,
    "yield_gross_pct": 0.6,
    "liquidity_score": 0.3,
    "location_score": 0.3,
    "risk_score": -0.8,
}
DEFAULT_REFS = {
    "undervaluation_pct": (0.0, 15.0),
    "yield_gross_pct": (4.5, 1.5),
    "liquidity_score": (50.0, 20.0),
    "location_score": (50.0, 20.0),
    "risk_score": (10.0, 15.0),
}

MAX_LEVEL = 5
MIN_SAMPLES = 30
MIN_RENTAL_COMPS = 10
PUBLIC_CONFIDENCE = 0.3



def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _finite_positive(x: Column) -> Column:
    d = x.cast("double")
    return F.coalesce((d > 0) & (d < float("inf")), F.lit(False))


# --- segmentation -------------------------------------------------------------------------


def ppm2(price: Column, size: Column) -> Column:
    p, s = price.cast("double"), size.cast("double")
    return F.when((p > 0) & (s > 0), p / s)


def size_bucket(size: Column) -> Column:
    s = size.cast("double")
    out = F.when(s.isNull() | (s <= 0), F.lit(UNKNOWN))
    for upper, label in SIZE_BRACKETS:
        out = out.when(s < upper, F.lit(label))
    return out.otherwise(F.lit(TOP_SIZE_BRACKET))


def condition_bucket(condition: Column) -> Column:
    return F.coalesce(fixed_map(CONDITION_BRACKETS)[condition], F.lit(UNKNOWN))


def parent_city(district: Column) -> Column:
    return F.when(F.lower(district).startswith("praha"), F.lit("Praha")).otherwise(district)


SEGMENT_PARTS = [
    "city_district",
    "locality",
    "property_type",
    "disposition",
    "ownership_type",
    "building_type",
    "size_bucket",
    "condition_bucket",
]


def segment_key(
    city_district: Column,
    property_type: Column,
    disposition: Column,
    ownership_type: Column,
    building_type: Column,
    size_m2: Column,
    condition: Column,
) -> Column:
    """struct of the eight segment parts; locality is kept in the key but never filled."""
    return F.struct(
        city_district.alias("city_district"),
        _null("string").alias("locality"),
        property_type.alias("property_type"),
        disposition.alias("disposition"),
        ownership_type.alias("ownership_type"),
        building_type.alias("building_type"),
        size_bucket(size_m2).alias("size_bucket"),
        condition_bucket(condition).alias("condition_bucket"),
    )


def relax(key: Column, level: int) -> Column:
    """The key after ``level`` relaxation steps; NULL beyond the last level.

    Property type and ownership are never relaxed.
    """
    part = {name: key.getField(name) for name in SEGMENT_PARTS}
    if level > MAX_LEVEL:
        return F.when(F.lit(False), key)
    if level >= 1:
        part["size_bucket"] = F.coalesce(fixed_map(WIDER_SIZE)[part["size_bucket"]], F.lit(UNKNOWN))
    if level >= 2:
        c = part["condition_bucket"]
        part["condition_bucket"] = F.when(
            c.isNull() | c.isin(UNKNOWN, "ruin"), c
        ).otherwise(F.lit("any_habitable"))
    if level >= 3:
        part["building_type"] = _null("string")
    if level >= 4:
        part["city_district"] = parent_city(part["city_district"])
    if level >= 5:
        part["disposition"] = _null("string")
    return F.struct(*[part[name].alias(name) for name in SEGMENT_PARTS])


# --- hedonic helpers ----------------------------------------------------------------------


def year_bucket(year: Column) -> Column:
    return (
        F.when(year.isNull(), F.lit(UNKNOWN))
        .when(year < 1948, F.lit("<1948"))
        .when(year < 1990, F.lit("1948-1989"))
        .when(year < 2010, F.lit("1990-2009"))
        .otherwise(F.lit("2010+"))
    )


def top_floor_walkup(floor: Column, floors: Column, lift: Column) -> Column:
    """True on the top floor of a house of more than three floors known to have no lift."""
    return F.coalesce((lift == F.lit(False)) & (floor == floors) & (floors > 3), F.lit(False))


def undervaluation_pct(predicted_log: Column, actual_log: Column) -> Column:
    return F.when(
        predicted_log.isNotNull() & actual_log.isNotNull(),
        _clamp((F.exp(predicted_log - actual_log) - 1.0) * 100.0, -50.0, 50.0),
    )


def undervaluation_abs(predicted_log: Column, size: Column, price: Column) -> Column:
    s, p = size.cast("double"), price.cast("double")
    return F.when((s != 0) & (p != 0), F.exp(predicted_log) * s - p)


# --- risk flags ---------------------------------------------------------------------------


def price_too_low(price: Column, size: Column, p25: Column) -> Column:
    ok = _finite_positive(price) & _finite_positive(size) & _finite_positive(p25)
    return F.coalesce(
        F.when(ok, price.cast("double") / size.cast("double") < 0.6 * p25), F.lit(False)
    )


def _mentions(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def legal_encumbrance(description: Column) -> Column:
    return _mentions(description, LEGAL_PATTERN)


def mismarked_cooperative(
    ownership: Column, price: Column, size: Column, median: Column
) -> Column:
    ok = _finite_positive(price) & _finite_positive(size) & _finite_positive(median)
    cheap = price.cast("double") < median * size.cast("double") * 0.85
    return F.coalesce(F.when(ownership.isNull() & ok, cheap), F.lit(False))


def panel_capex_due(building: Column, year: Column, description: Column) -> Column:
    return F.coalesce(
        (building == "panel") & year.between(1960, 1990), F.lit(False)
    ) & ~_mentions(description, REVITALISED_PATTERN)


def poor_energy(energy: Column) -> Column:
    return F.coalesce(F.upper(energy).isin("F", "G"), F.lit(False))


def few_photos(photo_count: Column) -> Column:
    return F.coalesce(photo_count < 4, F.lit(False))


def ruin_keywords(description: Column) -> Column:
    return _mentions(description, RUIN_PATTERN)


def raised_flags(
    price: Column,
    size: Column,
    ownership: Column,
    building: Column,
    year: Column,
    floor: Column,
    floors: Column,
    lift: Column,
    energy: Column,
    photo_count: Column,
    description: Column,
    median: Column,
    p25: Column,
) -> dict[str, Column]:
    """Boolean per flag, in the order of ``SEVERITIES``."""
    raised = {
        "price_too_low": price_too_low(price, size, p25),
        "legal_encumbrance": legal_encumbrance(description),
        "druzstevni_mismarked": mismarked_cooperative(ownership, price, size, median),
        "panel_capex_due": panel_capex_due(building, year, description),
        "top_floor_no_lift": top_floor_walkup(floor, floors, lift),
        "class_g_energy": poor_energy(energy),
        "photo_count_low": few_photos(photo_count),
        "description_keywords": ruin_keywords(description),
    }
    return {name: raised[name] for name in SEVERITIES}


def flag_names(raised: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in raised.items()]))


def risk_flags(*inputs: Column) -> Column:
    """Names of the raised flags (inputs as in :func:`raised_flags`)."""
    return flag_names(raised_flags(*inputs))


def risk_score_of(raised: Mapping[str, Column]) -> Column:
    """The score of :func:`risk_score`, straight from the booleans."""
    total = F.lit(0.0)
    for name, c in raised.items():
        total = total + F.when(c, SEVERITIES[name]).otherwise(0.0)
    return F.least(total / SEVERITY_FOR_100 * 100.0, F.lit(100.0))


def risk_score(flags: Column) -> Column:
    table = fixed_map(SEVERITIES)
    total = F.aggregate(
        flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(table[f], F.lit(0.0))
    )
    return F.coalesce(F.least(total / SEVERITY_FOR_100 * 100.0, F.lit(100.0)), F.lit(0.0))


# --- confidence ---------------------------------------------------------------------------


def sample_size_factor(n: Column) -> Column:
    whole = F.greatest(n.cast("long"), F.lit(0)).cast("double")
    return 1.0 / (1.0 + F.exp(-0.1 * (whole - 30.0)))


def relaxation_factor(level: Column) -> Column:
    return 1.0 - 0.4 * (_clamp(level.cast("double"), 0.0, float(MAX_LEVEL)) / float(MAX_LEVEL))


def completeness(fields: Mapping[str, Column] | None = None) -> Column:
    """Share of the critical fields that are present and not blank."""
    cols = fields or {name: F.col(name) for name in CRITICAL_FIELDS}
    present = [
        F.when(F.trim(cols[name].cast("string")) != "", 1).otherwise(0) for name in CRITICAL_FIELDS
    ]
    total = present[0]
    for p in present[1:]:
        total = total + p
    return total / float(len(CRITICAL_FIELDS))


def precision_factor(precision: Column) -> Column:
    return F.coalesce(fixed_map(PRECISION_FACTORS)[precision], F.lit(0.5))


def age_days(first_seen: Column, as_of: Column) -> Column:
    """Whole 24-hour periods between the two, never negative."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(first_seen.cast("timestamp"))
    whole = F.greatest(F.floor(micros / 86_400_000_000), F.lit(0)).cast("long")
    return F.when(micros.isNotNull(), whole)


def freshness_factor(days: Column) -> Column:
    d = _clamp(days.cast("double"), 30.0, 180.0)
    return F.when(days.isNull(), F.lit(0.5)).otherwise(1.0 - 0.5 * ((d - 30.0) / 150.0))


def confidence(
    n: Column, level: Column, complete: Column, precision: Column, days: Column
) -> Column:
    product = (
        sample_size_factor(n)
        * relaxation_factor(level)
        * _clamp(complete, 0.0, 1.0)
        * precision_factor(precision)
        * freshness_factor(days)
    )
    return F.round(_clamp(product, 0.0, 1.0), 3)


# --- liquidity ----------------------------------------------------------------------------


def raw_liquidity(dom: Column, turnover: Column) -> Column:
    # greatest() skips NULLs, so a missing value is replaced before the clamp
    d = F.greatest(F.coalesce(dom.cast("double"), F.lit(60.0)), F.lit(0.0))
    t = F.coalesce(turnover.cast("double"), F.lit(0.1))
    return (
        F.when(dom.isNull() & turnover.isNull(), _null("double"))
        .when(t <= 0, F.lit(float("-inf")))
        .otherwise(-0.6 * d - 0.4 / F.when(t > 0, t))
    )


def liquidity_score(
    dom: Column, turnover: Column, raw_min: float = -100.0, raw_max: float = -10.0
) -> Column:
    raw = raw_liquidity(dom, turnover)
    if raw_max <= raw_min:
        return F.when(raw.isNotNull(), F.lit(50.0))
    return F.when(raw.isNotNull(), _clamp((raw - raw_min) / (raw_max - raw_min) * 100.0, 0.0, 100.0))


# --- location -----------------------------------------------------------------------------


def ramp_down(x: Column, best: float, worst: float) -> Column:
    """100 up to ``best``, 0 from ``worst`` on."""
    d = x.cast("double")
    return F.when(d.isNotNull(), _clamp(100.0 * (1.0 - (d - best) / (worst - best)), 0.0, 100.0))


def ramp_up(x: Column, worst: float, best: float) -> Column:
    """0 up to ``worst``, 100 from ``best`` on."""
    d = x.cast("double")
    return F.when(d.isNotNull(), _clamp(100.0 * (d - worst) / (best - worst), 0.0, 100.0))


def transit_subscore(metro: Column, tram: Column, train: Column) -> Column:
    return ramp_down(F.least(metro, tram, train), 300.0, 2000.0)


def amenities_subscore(counts: Column) -> Column:
    total = F.lit(0)
    for kind in AMENITY_KINDS:
        total = total + F.coalesce(counts[kind], F.lit(0))
    return F.when(counts.isNotNull(), F.least(total / 20.0 * 100.0, F.lit(100.0)))


def green_subscore(park_m: Column) -> Column:
    return ramp_down(park_m, 300.0, 1500.0)


def quiet_subscore(road_m: Column) -> Column:
    return ramp_up(road_m, 20.0, 200.0)


def location_breakdown(
    metro: Column, tram: Column, train: Column, counts: Column, park: Column, road: Column
) -> Column:
    """struct<transit, amenities, green, quiet, composite>; composite averages what is known."""
    parts = {
        "transit": transit_subscore(metro, tram, train),
        "amenities": amenities_subscore(counts),
        "green": green_subscore(park),
        "quiet": quiet_subscore(road),
    }
    known = F.array_compact(F.array(*parts.values()))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return F.struct(*[c.alias(n) for n, c in parts.items()], mean.alias("composite"))


# --- yield --------------------------------------------------------------------------------


def rental_yield(
    price: Column, size: Column, hoa: Column, rent_ppm2: Column, n_comps: Column, level: Column
) -> Column:
    """struct<gross_pct, confidence, monthly_rent, annual_hoa, default_hoa>."""
    p, s = price.cast("double"), size.cast("double")
    usable = F.coalesce(
        rent_ppm2.isNotNull() & (n_comps >= MIN_RENTAL_COMPS) & (p > 0) & (s > 0), F.lit(False)
    )
    rent = rent_ppm2 * s
    annual_hoa = F.coalesce(hoa.cast("double"), 50.0 * s) * 12.0
    gross = _clamp((rent * 12.0 - annual_hoa) / F.when(p > 0, p) * 100.0, -5.0, 25.0)
    sample = F.when(n_comps >= 30, 1.0).when(n_comps >= MIN_RENTAL_COMPS, 0.5).otherwise(0.0)
    conf = sample * relaxation_factor(level) * F.when(hoa.isNull(), 0.5).otherwise(1.0)
    return F.struct(
        F.when(usable, gross).alias("gross_pct"),
        F.when(usable, F.round(_clamp(conf, 0.0, 1.0), 3)).otherwise(0.0).alias("confidence"),
        F.when(usable, rent).alias("monthly_rent"),
        F.when(usable, annual_hoa).alias("annual_hoa"),
        (usable & hoa.isNull()).alias("default_hoa"),
    )


def net_yield_pct(
    price: Column,
    size: Column,
    monthly_rent: Column,
    annual_hoa: Column,
    tax_per_m2: float = 5.0,
    insurance: float = 0.0,
    vacancy: float = 0.05,
    management: float = 0.10,
) -> Column:
    """Spec-only: gross rent less vacancy, management, fees, property tax and insurance."""
    p, s = price.cast("double"), size.cast("double")
    income = monthly_rent * 12.0 * (1.0 - vacancy - management)
    return F.when(p > 0, (income - annual_hoa - tax_per_m2 * s - insurance) / p * 100.0)


# --- composite ----------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoringConfig:
    """Weights and component distributions of one model version."""

    weights: Mapping[str, float]
    refs: Mapping[str, tuple[float, float]]

    def __post_init__(self) -> None:
        missing = [c for c in COMPONENTS if c not in self.weights]
        if missing:
            raise KeyError(f"weights missing for {missing}")


def z_score(x: Column, ref: tuple[float, float]) -> Column:
    mean, sd = ref
    return (x - mean) / sd if sd > 0 else F.when(x.isNotNull(), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def composite_score(
    components: Mapping[str, Column], yield_confidence: Column, config: ScoringConfig
) -> Column:
    """0..100 blend; a missing component adds nothing."""
    total = F.lit(0.0)
    for name in COMPONENTS:
        term = float(config.weights[name]) * z_score(
            components[name].cast("double"), config.refs[name]
        )
        if name == "yield_gross_pct":
            term = term * F.coalesce(yield_confidence, F.lit(0.0))
        total = total + F.coalesce(term, F.lit(0.0))
    return sigmoid(total) * 100.0


def to_decimal(x: Column, places: int, precision: int = 14) -> Column:
    """Fixed-point value for storage; NULL for NaN and infinities."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, x).cast(f"decimal({precision},{places})")


def explanation(
    predicted_log: Column,
    actual_log: Column,
    undervaluation: Column,
    n: Column,
    district: Column,
    flags: Column,
) -> Column:
    """Spec-only: sentences that say why the score is what it is."""
    return F.array_compact(
        F.array(
            F.when(
                undervaluation.isNotNull(),
                F.format_string(
                    "Predicted %.0f per m2; listed at %.0f: %.1f%% under model.",
                    F.exp(predicted_log),
                    F.exp(actual_log),
                    undervaluation,
                ),
            ),
            F.when(
                n > 0, F.format_string("Segment has %d comparable listings in %s.", n, district)
            ),
            F.when(
                F.size(flags) > 0,
                F.concat(F.lit("Risk flags: "), F.array_join(flags, ", "), F.lit(".")),
            ),
        )
    )

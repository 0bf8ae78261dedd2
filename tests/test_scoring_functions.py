"""Literal cases of the scoring formulas."""

import math

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import scoring as s

L = F.lit
def null():
    return F.lit(None)


def num(v):
    return F.lit(v).cast("double")


def test_price_per_area(one):
    assert one(s.ppm2(L(100.0), L(4.0)), s.ppm2(L(0.0), L(4.0)), s.ppm2(null(), L(4.0)), s.ppm2(L(1.0), L(-1.0))) == (
        25.0, None, None, None)


@pytest.mark.parametrize(
    "size,label",
    [(20, "<35"), (35, "35-50"), (49.9, "35-50"), (56, "50-70"), (70, "70-90"), (119.99, "90-120"), (160, ">160"),
     (900, ">160"), (0, "unknown"), (-5, "unknown"), (None, "unknown")],
)
def test_size_bucket(one, size, label):
    assert one(s.size_bucket(num(size))) == label


def key(one, level):
    k = s.segment_key(L("Praha 5"), L("byt"), L("2+kk"), L("osobni"), L("cihla"), L(56.0), L("velmi_dobry"))
    return one(s.relax(k, level))


def test_relaxation_ladder(one):
    k0 = key(one, 0)
    assert (k0.size_bucket, k0.condition_bucket, k0.building_type) == ("50-70", "very_good", "cihla")
    assert key(one, 1).size_bucket == "50-90"
    assert key(one, 2).condition_bucket == "any_habitable"
    assert key(one, 3).building_type is None
    assert key(one, 4).city_district == "Praha"
    k5 = key(one, 5)
    assert k5.disposition is None and k5.ownership_type == "osobni" and k5.property_type == "byt"
    assert key(one, 6) is None


def test_ruin_and_unknown_condition_are_kept(one):
    for condition, bucket in [("spatny", "ruin"), (None, "unknown")]:
        k = s.segment_key(L("Brno"), L("byt"), null(), null(), null(), L(56.0), L(condition).cast("string"))
        assert one(s.relax(k, 2)).condition_bucket == bucket


BASE = dict(price=6_000_000.0, size=60.0, ownership="osobni", building="cihla", year=2005, floor=2, floors=5, lift=True,
            energy="B", photo_count=12, description="Hezky byt", median=100_000.0, p25=90_000.0)
TYPES = dict(price="double", size="double", ownership="string", building="string", year="int", floor="int", floors="int",
             lift="boolean", energy="string", photo_count="int", description="string", median="double", p25="double")


@pytest.mark.parametrize(
    "change,flags",
    [
        ({}, []),
        ({"price": 3_000_000.0}, ["price_too_low"]),
        ({"price": 3_000_000.0, "p25": None}, []),
        ({"price": float("nan")}, []),
        ({"description": "Na byt je EXEKUCE"}, ["legal_encumbrance"]),
        ({"description": "BŘEMENO věcné"}, ["legal_encumbrance"]),
        ({"description": "brezen"}, []),
        ({"ownership": None, "price": 5_000_000.0}, ["druzstevni_mismarked"]),
        ({"ownership": None, "price": 5_200_000.0}, []),
        ({"building": "panel", "year": 1975}, ["panel_capex_due"]),
        ({"building": "panel", "year": 1991}, []),
        ({"building": "panel", "year": 1960, "description": "po Revitalizaci"}, []),
        ({"lift": False, "floor": 5}, ["top_floor_no_lift"]),
        ({"lift": None, "floor": 5}, []),
        ({"lift": False, "floor": 3, "floors": 3}, []),
        ({"energy": "g"}, ["class_g_energy"]),
        ({"photo_count": 3}, ["photo_count_low"]),
        ({"photo_count": None}, []),
        ({"description": "havarijní stav, k demolici"}, ["description_keywords"]),
        ({"energy": "F", "photo_count": 0, "description": "dražba"}, ["legal_encumbrance", "class_g_energy", "photo_count_low"]),
    ],
)
def test_risk_flags(one, change, flags):
    values = {**BASE, **change}
    cols = [F.lit(values[k]).cast(TYPES[k]) for k in BASE]
    assert one(s.risk_flags(*cols)) == flags


@pytest.mark.parametrize("flags,score", [([], 0.0), (["class_g_energy"], 12.5), (["price_too_low", "legal_encumbrance", "druzstevni_mismarked"], 100.0),
                                         (["nonsense"], 0.0), (["panel_capex_due", "nonsense"], 25.0)])
def test_risk_score(one, flags, score):
    arr = F.array(*[F.lit(f) for f in flags]).cast("array<string>")
    assert one(s.risk_score(arr)) == pytest.approx(score)


def test_confidence_factors(one):
    assert one(s.sample_size_factor(L(30))) == pytest.approx(0.5)
    assert one(s.sample_size_factor(L(-5))) == pytest.approx(1 / (1 + math.exp(3)))
    assert one(s.relaxation_factor(L(0)), s.relaxation_factor(L(5)), s.relaxation_factor(L(9))) == pytest.approx((1.0, 0.6, 0.6))
    assert one(s.relaxation_factor(L(2))) == pytest.approx(0.84)
    assert one(*[s.precision_factor(L(p).cast("string")) for p in ("rooftop", "locality", "weird", None)]) == (1.0, 0.5, 0.5, 0.5)
    assert one(*[s.freshness_factor(L(d).cast("int")) for d in (-3, 30, 105, 180, 999, None)]) == pytest.approx((1, 1, 0.75, 0.5, 0.5, 0.5))
    assert one(s.confidence(L(30), L(0), L(1.0), L("rooftop"), L(1))) == 0.5
    assert one(s.confidence(L(0), L(5), L(0.5), null().cast("string"), L(400))) == round(1 / (1 + math.exp(3)) * 0.6 * 0.5 * 0.5 * 0.5, 3)


@pytest.mark.parametrize("dom,turn,score", [(60, 0.1, 66.6667), (20, 0.3, 96.2963), (150, 0.02, 0.0), (60, 0.0, 0.0), (None, None, None),
                                            (None, 0.1, 66.6667), (60, None, 66.6667), (-5, 0.1, 100.0)])
def test_liquidity(one, dom, turn, score):
    got = one(s.liquidity_score(num(dom), num(turn)))
    assert got == (None if score is None else pytest.approx(score, abs=1e-3))
    if score is not None:
        assert one(s.liquidity_score(num(dom), num(turn), 5.0, 5.0)) == 50.0


def test_location(one):
    def counts(**kv):
        return F.create_map(*[x for k, v in kv.items() for x in (L(k), L(v))]) if kv else F.create_map().cast("map<string,int>")

    full = one(s.location_breakdown(num(300), num(None), num(5000), counts(grocery=10, school=10, zoo=99), num(1500), num(110)))
    assert (full.transit, full.amenities, full.green) == (100.0, 100.0, 0.0)
    assert full.quiet == pytest.approx(50.0) and full.composite == pytest.approx(62.5)
    empty = one(s.location_breakdown(num(None), num(None), num(None), counts(), num(None), num(None)))
    assert empty.transit is None and empty.amenities == 0.0 and empty.composite == 0.0
    none = one(s.location_breakdown(num(None), num(None), num(None), null().cast("map<string,int>"), num(None), num(None)))
    assert none.amenities is None and none.composite is None


def rent(one, price=8_000_000, size=70, hoa=3500, ppm2=400, n=40, level=0):
    return one(s.rental_yield(num(price), num(size), num(hoa), num(ppm2), L(n), L(level)))


def test_yield(one):
    y = rent(one)
    assert y.gross_pct == pytest.approx((400 * 70 * 12 - 3500 * 12) / 8_000_000 * 100)
    assert y.confidence == 1.0 and y.default_hoa is False
    d = rent(one, hoa=None, n=12, level=5)
    assert d.annual_hoa == 50 * 70 * 12 and d.default_hoa is True and d.confidence == 0.15
    for bad in (dict(n=9), dict(ppm2=None), dict(price=0), dict(size=None)):
        y = rent(one, **bad)
        assert (y.gross_pct, y.confidence, y.monthly_rent, y.default_hoa) == (None, 0.0, None, False)
    assert rent(one, price=100).gross_pct == 25.0 and rent(one, hoa=1e9).gross_pct == -5.0


def composite(one, weights=None, refs=None, yc=1.0, **parts):
    values = {c: num(parts.get(c)) for c in s.COMPONENTS}
    return one(s.composite_score(values, num(yc), s.ScoringConfig(weights or s.WEIGHTS_V1, refs or s.DEFAULT_REFS)))


def test_composite(one):
    assert composite(one) == 50.0
    z = 1.5 * 15 / 15 - 0.8 * (25 - 10) / 15
    assert composite(one, undervaluation_pct=15, risk_score=25) == pytest.approx(100 / (1 + math.exp(-z)))
    assert composite(one, yield_gross_pct=20, yc=None) == 50.0
    flat = {**s.DEFAULT_REFS, "undervaluation_pct": (0.0, 0.0)}
    assert composite(one, refs=flat, undervaluation_pct=40) == 50.0
    with pytest.raises(KeyError):
        s.ScoringConfig({"risk_score": 1.0}, s.DEFAULT_REFS)


def test_undervaluation_is_clamped_and_positive_when_cheap(one):
    assert one(s.undervaluation_pct(num(11.1), num(11.0))) == pytest.approx((math.exp(0.1) - 1) * 100)
    assert one(s.undervaluation_pct(num(12.0), num(11.0))) == 50.0
    assert one(s.undervaluation_pct(num(10.0), num(11.0))) == -50.0
    assert one(s.undervaluation_pct(num(None), num(11.0))) is None


def test_storage_decimals(one):
    assert str(one(s.to_decimal(num(1.2345), 2))) == "1.23"
    assert one(s.to_decimal(num(float("nan")), 2), s.to_decimal(num(float("inf")), 2), s.to_decimal(num(None), 2)) == (None,) * 3

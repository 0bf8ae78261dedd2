"""Distances, search cells and the national grid projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

# Bounding box accepted for source coordinates of the first supported city,
# (south, north, west, east).
PRAHA_BOX = (49.94, 50.18, 14.22, 14.71)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside the (south, north, west, east) box, edges included."""
    south, north, west, east = box
    if south > north or west > east:
        raise ValueError("inverted bounding box")
    return lat.between(south, north) & lon.between(west, east)


def cell_band(lat: Column, radius_m: float) -> Column:
    """Latitude band whose height is the search radius."""
    return F.floor(lat / (radius_m / METRES_PER_DEGREE)).cast("long")


def band_columns(band: Column, radius_m: float) -> Column:
    """How many equal cells go round the earth in ``band``, each at least as wide as the search radius at
    the band's worst latitude; one near the poles, where a radius may reach any longitude.

    A tiny allowance keeps points lying exactly one radius apart in neighbouring cells.
    """
    height = radius_m / METRES_PER_DEGREE
    edge = F.greatest(F.abs(band * height), F.abs((band + 1) * height)) + height
    step = F.lit(height * (1 + 1e-9)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.when((edge < 90) & (step < 60), F.floor(360 / step)).otherwise(1).cast("long")


def cell_column(lon: Column, band: Column, radius_m: float) -> Column:
    """Cell number in the band, counted eastwards from the date line."""
    return column_of(lon, band_columns(band, radius_m))


def column_of(lon: Column, n: Column) -> Column:
    """Which of ``n`` equal cells round the earth holds a longitude."""
    turned = F.pmod(lon + 180, F.lit(360.0))
    return F.least(F.floor(turned * n / 360), n - 1).cast("long")


def with_wgs84(
    df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add WGS84 ``lat``/``lon`` for national-grid columns ``x`` (northing) and ``y`` (easting),
    both negative as published.

    Closed inverse of the oblique conic projection on the Bessel ellipsoid, then a seven-parameter
    datum shift. Each step is its own projected column, because a step is read several times
    by the next one and nesting them would double the expression at every step.
    """
    # Bessel 1841 ellipsoid, projection constants and datum-shift parameters.
    a, e2 = 6377397.155, 0.006674372230614
    lat0, lon0 = math.radians(49.5), math.radians(24.0 + 50.0 / 60.0)
    cone_colat = math.radians(30.0 + 17.0 / 60.0 + 17.30311 / 3600.0)
    pseudo_lat, scale = math.radians(78.5), 0.9999
    shift = (572.213, 85.334, 461.94)
    rotation = (4.9732, 1.529, 5.2484)
    ppm = 3.5378
    wgs_a, wgs_e2 = 6378137.0, 0.0066943799901413165

    e = math.sqrt(e2)
    alpha = math.sqrt(1 + e2 * math.cos(lat0) ** 4 / (1 - e2))
    u0 = math.asin(math.sin(lat0) / alpha)
    g = ((1 + e * math.sin(lat0)) / (1 - e * math.sin(lat0))) ** (alpha * e / 2)
    k = math.tan(u0 / 2 + math.pi / 4) / math.tan(lat0 / 2 + math.pi / 4) ** alpha * g
    n0 = a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat0) ** 2)
    r0 = scale * n0 / math.tan(pseudo_lat)
    m = 1 + ppm * 1e-6
    wx, wy, wz = (math.radians(w / 3600.0) for w in rotation)

    c = F.col
    steps: list[tuple[str, Column]] = [
        ("__r", F.sqrt(c(x) * c(x) + c(y) * c(y))),
        ("__d", F.atan2(-c(y), -c(x)) / math.sin(pseudo_lat)),
        (
            "__t",
            2 * F.atan(F.pow(r0 / c("__r"), 1 / math.sin(pseudo_lat))
                       * math.tan(pseudo_lat / 2 + math.pi / 4)) - math.pi / 2,
        ),
        (
            "__u",
            F.asin(
                math.cos(cone_colat) * F.sin(c("__t"))
                - math.sin(cone_colat) * F.cos(c("__t")) * F.cos(c("__d"))
            ),
        ),
        ("__v", F.asin(F.cos(c("__t")) * F.sin(c("__d")) / F.cos(c("__u")))),
        ("__lb", lon0 - c("__v") / alpha),
        ("__q", F.pow(F.tan(c("__u") / 2 + math.pi / 4) / k, 1 / alpha)),
        ("__b", c("__u")),
    ]
    for _ in range(5):
        s = e * F.sin(c("__b"))
        steps.append(
            ("__b", 2 * F.atan(c("__q") * F.pow((1 + s) / (1 - s), e / 2)) - math.pi / 2)
        )
    steps += [
        ("__n", a / F.sqrt(1 - e2 * F.pow(F.sin(c("__b")), 2))),
        ("__xb", c("__n") * F.cos(c("__b")) * F.cos(c("__lb"))),
        ("__yb", c("__n") * F.cos(c("__b")) * F.sin(c("__lb"))),
        ("__zb", c("__n") * (1 - e2) * F.sin(c("__b"))),
        ("__xw", shift[0] + m * (c("__xb") - wz * c("__yb") + wy * c("__zb"))),
        ("__yw", shift[1] + m * (wz * c("__xb") + c("__yb") - wx * c("__zb"))),
        ("__zw", shift[2] + m * (-wy * c("__xb") + wx * c("__yb") + c("__zb"))),
        ("__p", F.sqrt(c("__xw") * c("__xw") + c("__yw") * c("__yw"))),
        ("__w", F.atan2(c("__zw"), c("__p") * (1 - wgs_e2))),
    ]
    for _ in range(3):
        n = wgs_a / F.sqrt(1 - wgs_e2 * F.pow(F.sin(c("__w")), 2))
        steps.append(("__w", F.atan2(c("__zw") + wgs_e2 * n * F.sin(c("__w")), c("__p"))))
    steps += [
        (lat, F.degrees(c("__w"))),
        (lon, F.degrees(F.atan2(c("__yw"), c("__xw")))),
    ]
    out = df
    for name, expr in steps:
        out = out.withColumn(name, expr)
    return out.drop(*{n for n, _ in steps if n.startswith("__")})

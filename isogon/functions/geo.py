"""Scalar functions of geodesy, time and weighting, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: reference ellipsoid axes in metres, seconds of arc in a radian, GPS epoch
AXIS_A, AXIS_B = 6378137.0, 6356752.31414
ARC_SECONDS = 206264.80624709636
GPS_EPOCH = 2444244.5


def _whole(c: Column) -> Column:
    """Truncation toward zero."""
    return c.cast("int")


def julian_date(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Julian date of a calendar date; the second is truncated, as the readers pass it."""
    y, m = F.when(month <= 2, year - 1).otherwise(year), F.when(month <= 2, month + 12).otherwise(month)
    century = _whole(F.floor(y / 100))
    leap = 2 - century + _whole(F.floor(century / 4))
    return F.floor(365.25 * (y + 4716.0)) + F.floor(30.6001 * (1.0 + m)) + day + leap - 1524.5 + (hour + (minute + _whole(second) / 60.0) / 60.0) / 24.0


def gps_week(jd: Column) -> Column:
    return _whole((jd - GPS_EPOCH) / 7.0)


def gps_seconds(jd: Column) -> Column:
    return ((jd - GPS_EPOCH) - gps_week(jd) * 7.0) * 86400.0


def _curvature(lat: Column) -> tuple[Column, float]:
    e2 = (AXIS_A**2 - AXIS_B**2) / AXIS_A**2
    s = F.sin(F.radians(lat))
    return AXIS_A / F.sqrt(1 - e2 * s * s), e2


def to_cartesian(lat: Column, lon: Column, height: Column | None = None) -> Column:
    """Struct x, y, z; without a height the plane form x, y."""
    n, e2 = _curvature(lat)
    b, el = F.radians(lat), F.radians(lon)
    h = height if height is not None else F.lit(0.0)
    parts = [((n + h) * F.cos(b) * F.cos(el)).alias("x"), ((n + h) * F.cos(b) * F.sin(el)).alias("y")]
    if height is not None:
        parts.append(((n * (1 - e2) + h) * F.sin(b)).alias("z"))
    return F.struct(*parts)


def to_geodetic(x: Column, y: Column, z: Column, rounds: int = 6) -> Column:
    """Struct lat, lon, height by fixed-point iteration."""
    e2 = (AXIS_A**2 - AXIS_B**2) / AXIS_A**2
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(rounds):
        s = F.sin(lat)
        n = AXIS_A / F.sqrt(1 - e2 * s * s)
        lat = F.atan2(z + e2 * n * s, p)
    s = F.sin(lat)
    n = AXIS_A / F.sqrt(1 - e2 * s * s)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), (p / F.cos(lat) - n).alias("height"))


def in_turn_of(lat: Column, lon: Column, near_lat: Column, near_lon: Column) -> Column:
    """Struct lat, lon: of all degrees that name this place, also by whole turns and beyond a
    pole, those nearest to the latitude and longitude given."""
    turned = lambda v, near: v + 360 * F.round((near - v) / 360)
    a, b = turned(lat, near_lat), turned(180 - lat, near_lat)
    over = F.abs(b - near_lat) < F.abs(a - near_lat)
    return F.struct(F.when(over, b).otherwise(a).alias("lat"), turned(F.when(over, lon + 180).otherwise(lon), near_lon).alias("lon"))


def gauss_kruger(lat: Column, lon: Column) -> Column:
    """Struct x (north), y (east + 500 km) in the 6-degree zone of lon: the usual
    series, meridian arc to the eighth power and offsets to the sixth."""
    e2 = (AXIS_A**2 - AXIS_B**2) / AXIS_A**2
    second = (AXIS_A**2 - AXIS_B**2) / AXIS_B**2
    zone = _whole(lon / 6.0) + 1
    dl = (lon - (6 * zone - 3)) * 3600 / ARC_SECONDS
    b = F.radians(lat)
    s, c, t = F.sin(b), F.cos(b), F.tan(b)
    eta = second * c * c
    n = (AXIS_A**2 / AXIS_B) / F.sqrt(1 + eta)
    # the arc's powers: each is the one before times (2k + 1) / 2k of e2
    powers = [AXIS_A * (1 - e2)]
    for k in range(1, 5):
        powers.append(powers[-1] * (2 * k + 1) / (2 * k) * e2)
    rows = [[1, 1 / 2, 3 / 8, 5 / 16, 35 / 128], [0, 1 / 2, 1 / 2, 15 / 32, 7 / 16], [0, 0, 1 / 8, 3 / 16, 7 / 32], [0, 0, 0, 1 / 32, 1 / 16], [0, 0, 0, 0, 1 / 128]]
    terms = [sum(w * p for w, p in zip(r, powers, strict=True)) for r in rows]
    arc = terms[0] * b
    for k in range(1, 5):
        arc = arc + (-1) ** k * terms[k] / (2 * k) * F.sin(2 * k * b)
    t2 = t * t
    north = arc + n * s * c / 2 * dl**2 + n * s * c**3 / 24 * (5 - t2 + 9 * eta) * dl**4 + n * s * c**5 / 720 * (61 - 58 * t2 + t2 * t2) * dl**6
    east = n * c * dl + n * c**3 / 6 * (1 - t2 + eta) * dl**3 + n * c**5 / 120 * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * eta * t2) * dl**5
    return F.struct(north.alias("x"), (east + 500000).alias("y"))


def decimal_year(date: Column) -> Column:
    return F.year(date) + F.dayofyear(date) / F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def from_decimal_year(value: Column) -> Column:
    year = _whole(F.floor(value))
    days = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), _whole(F.round((value - year) * days)) - 1)


def emag2_index(lon: Column, lat: Column) -> Column:
    """Cell of the global 2-minute grid: 10800 columns of 5400."""
    east = F.when(lon < 0, lon + 360).otherwise(lon)
    return F.round(east * 30).cast("bigint") * 5400 + F.round((90 - lat) * 30).cast("bigint")


def mamea_index(lon: Column, lat: Column) -> Column:
    """Cell of the regional grid, 93 to 160 E in 2011 columns, 12 S to 46 N in 1741."""
    return F.round((lon - 93) / ((160 - 93) / 2011)).cast("bigint") * 1741 + F.round((lat + 12) / ((46 + 12) / 1741)).cast("bigint")


def fusion_weight(dl: Column, db: Column, lat: Column, window_lon: float, window_lat: float) -> Column:
    """Weight by distance, in minutes of arc: steep within a third of the half
    window, a falling shell to its edge, nothing beyond."""
    hl, hb = window_lon * 60.0 / 2.0, window_lat * 60.0 / 2.0
    a, b, c = F.abs(dl) * 60.0, F.abs(db) * 60.0, F.cos(F.radians(lat))
    d = F.sqrt(b * b + a * a * c * c)
    far = F.sqrt(hb * hb + hl * hl * c * c)
    core = 1.0 / (d + 0.01) / (d + 0.01)
    shell = F.pow(27.0 / 4.0 / far * (d / far - 1.0), 2)
    return F.when((a <= hl / 3) & (b <= hb / 3), core).when((a > hl) | (b > hb), 0.0).otherwise(shell)


#: fixed values: (complexity above, line spacing), then the spacing of the rest
MARINE_SPACING = [(5.53, 0.5), (3.52, 2.0), (2.0, 2.5), (1.19, 3.0), (0.75, 3.5), (0.2, 4.0), (0.0, 5.0), (-0.2, 7.0), (-0.34, 8.0), (-0.72, 8.5), (-1.0, 9.0)], 10.0
AIR_SPACING = [(6.0, 1.0), (5.6, 2.0), (2.82, 2.5), (0.6, 3.0), (-0.11, 3.5), (-0.51, 4.0), (-1.8, 4.5)], 5.0


def line_spacing(complexity: Column, air: bool = False) -> Column:
    steps, rest = AIR_SPACING if air else MARINE_SPACING
    out = F.when(complexity > steps[0][0], steps[0][1])
    for above, spacing in steps[1:]:
        out = out.when(complexity > above, spacing)
    return out.otherwise(rest)


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    a = F.radians(degrees)
    dx, dy = x - cx, y - cy
    return F.struct((cx + dx * F.cos(a) - dy * F.sin(a)).alias("x"), (cy + dx * F.sin(a) + dy * F.cos(a)).alias("y"))


def azimuth(dx: Column, dy: Column) -> Column:
    """Angle from the x axis in [0, 2 pi); 0 on an axis."""
    a = F.atan2(dy, dx)
    return F.when((dx == 0) | (dy == 0), F.lit(0.0)).when(a < 0, a + 2 * math.pi).otherwise(a)


def nearest_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct((x1 + t * dx).alias("x"), (y1 + t * dy).alias("y"))


def horizontal_uncertainty(h: Column) -> Column:
    """Declination uncertainty in degrees from the horizontal field in nT."""
    return F.least(F.sqrt(F.lit(0.26**2) + F.pow(5417.0 / h, 2)), F.lit(180.0))


def legendre(x: Column, n: int) -> list[Column]:
    """P0 to Pn at x by the three-term recurrence."""
    out = [F.lit(1.0), x]
    for k in range(1, n):
        out.append(((2 * k + 1) * x * out[k] - k * out[k - 1]) / (k + 1))
    return out[: n + 1]


def utm_zone(lat: Column, lon: Column) -> Column:
    """Struct zone (1 to 60, with the exceptions at the North Sea and Svalbard), central
    meridian in degrees, and hemisphere."""
    east = F.pmod(lon + 180, F.lit(360.0)) - 180
    zone = F.least(F.floor((east + 180) / 6) + 1, F.lit(60))
    zone = F.when(lat.between(56, 63.999999) & (east >= 3) & (east < 12), 32).otherwise(zone)
    for lo, hi, z in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone = F.when((lat >= 72) & (east >= lo) & (east < hi), z).otherwise(zone)
    zone = zone.cast("int")
    return F.struct(zone.alias("zone"), (zone * 6.0 - 183.0).alias("central"), F.when(lat < 0, "S").otherwise("N").alias("hemisphere"))


def convergence(lat: Column, lon: Column) -> Column:
    """Angle in degrees from true to grid north of the transverse Mercator projection of
    the place's zone, by the series in the longitude's offset."""
    dl = F.radians(F.pmod(lon + 180, F.lit(360.0)) - 180 - utm_zone(lat, lon)["central"])
    b = F.radians(lat)
    s, c = F.sin(b), F.cos(b)
    eta = (AXIS_A**2 - AXIS_B**2) / AXIS_B**2 * c * c
    t2 = F.pow(F.tan(b), 2)
    return F.degrees(dl * s + F.pow(dl, 3) / 3 * s * c * c * (1 + 3 * eta + 2 * eta * eta) + F.pow(dl, 5) / 15 * s * F.pow(c, 4) * (2 - t2))


def to_spherical(lat: Column, lon: Column, height_km: Column) -> Column:
    """Struct lat (geocentric), lon, r in km, of a geodetic place."""
    n, e2 = _curvature(lat)
    b = F.radians(lat)
    rho, z = (n / 1000 + height_km) * F.cos(b), (n / 1000 * (1 - e2) + height_km) * F.sin(b)
    r = F.sqrt(rho * rho + z * z)
    return F.struct(F.degrees(F.asin(z / r)).alias("lat"), lon.alias("lon"), r.alias("r"))


def from_dms(text: Column) -> Column:
    """Degrees of "d,m,s", the sign of the first part for all; null where it is none."""
    f = F.split(text, r"\s*,\s*")
    d, m, s = (F.get(f, F.lit(i)).try_cast("double") for i in range(3))
    ok = (F.size(f) == 3) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
    return F.when(ok, F.when(F.startswith(F.trim(text), F.lit("-")), -1.0).otherwise(1.0) * (F.abs(d) + m / 60 + s / 3600))


def to_dms(degrees: Column) -> Column:
    """Whole degrees, minutes and seconds, "d,m,s", seconds rounded, carried over at 60."""
    total = F.round(F.abs(degrees) * 3600).cast("bigint")
    sign = F.when((degrees < 0) & (total > 0), "-").otherwise("")
    return F.concat(sign, F.concat_ws(",", F.floor(total / 3600).cast("string"), F.floor(total % 3600 / 60).cast("string"), (total % 60).cast("string")))


def colour_index(v: Column, lo: Column, hi: Column, colours: int) -> Column:
    """Place in a map of colours by linear scaling; the middle where all values are equal."""
    return F.when(hi - lo < 0.0001, F.lit(colours // 2)).otherwise(_whole((v - lo) / (hi - lo) * (colours - 1)))


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The cubic through p1 (t = 0) and p2 (t = 1) whose slopes are half the differences of
    the points around."""
    m1, m2 = (p2 - p0) / 2, (p3 - p1) / 2
    return p1 + t * (m1 + t * (3 * (p2 - p1) - 2 * m1 - m2 + t * (2 * (p1 - p2) + m1 + m2)))


def z_score(v: Column, mean: Column, deviation: Column) -> Column:
    return F.coalesce(F.try_divide(v - mean, deviation), F.lit(0.0))


def in_subarea(x: Column, y: Column, cx: Column, cy: Column, size: float) -> Column:
    """Whether a place lies in the square of a size about a centre, edges included."""
    return (F.abs(x - cx) <= size / 2) & (F.abs(y - cy) <= size / 2)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    first = F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))
    return F.coalesce(month.between(1, 12) & day.between(1, F.day(F.last_day(first))), F.lit(False))


def valid_step(begin: Column, end: Column, step: Column) -> Column:
    return F.coalesce((step > 0) & (begin <= end) & (step <= end - begin), F.lit(False))

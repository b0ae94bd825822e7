"""Main geomagnetic field from spherical-harmonic coefficients, as a pandas UDF over
NumPy. Coefficient files are the user's: their path is a parameter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isogon.cluster import ship
from isogon.functions import geo

#: Ellipsoid axes and the reference sphere, in km.
MAJOR, MINOR, SPHERE = 6378.137, 6356.7523142, 6371.2
FIELDS = ["x", "y", "z", "h", "f", "incl", "decl"]
SCHEMA = ", ".join(f"{c} double, {c}dot double" for c in FIELDS)


class Model:
    """Coefficients of one epoch: arrays [n, m] of g, h and their yearly change."""

    def __init__(self, epoch: float, rows):
        top = max(int(r[0]) for r in rows)
        self.epoch, self.top = epoch, top
        self.g, self.h, self.gdot, self.hdot = (np.zeros((top + 1, top + 1)) for _ in range(4))
        for n, m, g, h, gd, hd in rows:
            n, m = int(n), int(m)
            self.g[n, m], self.h[n, m], self.gdot[n, m], self.hdot[n, m] = g, h, gd, hd

    def at(self, year: float) -> Model:
        """Moved linearly to another year."""
        out = Model.__new__(Model)
        out.epoch, out.top, out.gdot, out.hdot = year, self.top, self.gdot, self.hdot
        out.g, out.h = self.g + (year - self.epoch) * self.gdot, self.h + (year - self.epoch) * self.hdot
        return out


def read_cof(lines: list[str]) -> Model:
    """n m g h gdot hdot a line below a header with the epoch; a line of nines ends it."""
    epoch, rows = float(lines[0].split()[0]), []
    for line in lines[1:]:
        f = line.split()
        if not f or set(f[0]) == {"9"} and len(f[0]) > 3:
            break
        rows.append([float(v) for v in f[:6]])
    return Model(epoch, rows)


def read_pair(field: list[str], change: list[str]) -> Model:
    """A field file with a header (epoch first) and n m g h a line, and a file of the yearly
    changes to a lower degree, as a rule."""
    def numbers(lines: list[str]) -> dict[tuple[int, int], list[float]]:
        rows = [line.split() for line in lines if line.strip()]
        return {(int(f[0]), int(f[1])): [float(v) for v in f[2:4]] for f in rows if len(f) >= 4 and not (set(f[0]) == {"9"} and len(f[0]) > 3)}

    moved = numbers(change)
    return Model(float(field[0].split()[0]), [[*at, *gh, *moved.get(at, [0.0, 0.0])] for at, gh in numbers(field[1:]).items()])


def read_shdf(lines: list[str]) -> list[Model]:
    """Models of several epochs: % lines hold keys, a new model begins at the key SHDF, #
    lines are notes, the others type,n,m,g,h,gdot,hdot with blanks for none. External
    terms are passed over."""
    out, epoch, rows = [], None, []

    def close():
        if rows:
            out.append(Model(epoch, rows))

    for line in lines:
        line = line.strip()
        if line.startswith("%"):
            if line[1:].strip().startswith("SHDF"):
                close()
                epoch, rows = None, []
            elif line[1:].startswith("Epoch:"):
                epoch = float(line.split(":")[1])
        elif line and not line.startswith("#"):
            f = [v.strip() for v in line.split(",")]
            if f[0] == "I":
                rows.append([float(v or 0) for v in [*f[1:7], "", "", "", ""][:6]])
    close()
    return out


RECORD = 80


def read_epochs(lines: list[str], record: int | None = RECORD) -> list[Model]:
    """Several epochs in one file; a header line begins with three blanks. The change of
    an epoch is that towards the next one, of the last its own. Records have
    `record` characters without their line end (None: any); others are an error."""
    heads, blocks = [], []
    for i, line in enumerate(lines):
        if record and line.strip() and len(line.rstrip("\r\n")) != record:
            raise ValueError(f"record {i + 1} has {len(line)} characters, not {record}")
        if line.startswith("   "):
            heads.append(float(line.split()[1]))
            blocks.append([])
        elif line.strip():
            blocks[-1].append([float(v) for v in line.split()[:6]])
    out = [Model(e, b) for e, b in zip(heads, blocks, strict=True)]
    for a, b in zip(out, out[1:], strict=False):
        n = min(a.top, b.top) + 1
        a.gdot[:], a.hdot[:] = -a.g / (b.epoch - a.epoch), -a.h / (b.epoch - a.epoch)
        a.gdot[:n, :n], a.hdot[:n, :n] = (b.g[:n, :n] - a.g[:n, :n]) / (b.epoch - a.epoch), (b.h[:n, :n] - a.h[:n, :n]) / (b.epoch - a.epoch)
    return out


def choose(models: list[Model], year: float) -> Model:
    """The last epoch at or before the year, the first for earlier years, moved to it."""
    fit = [m for m in models if m.epoch <= year]
    return (fit[-1] if fit else models[0]).at(year)


def schmidt(top: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Schmidt semi-normalised P[n, m] of cos(theta), and their derivatives in theta."""
    c, s = np.cos(theta), np.sin(theta)
    p, d = np.zeros((top + 1, top + 1, len(theta))), np.zeros((top + 1, top + 1, len(theta)))
    p[0, 0] = 1
    for n in range(1, top + 1):
        k = 1.0 if n == 1 else np.sqrt((2 * n - 1) / (2 * n))
        p[n, n] = k * s * p[n - 1, n - 1]
        d[n, n] = k * (s * d[n - 1, n - 1] + c * p[n - 1, n - 1])
        for m in range(n):
            a = (2 * n - 1) / np.sqrt(n * n - m * m)
            p[n, m] = a * c * p[n - 1, m]
            d[n, m] = a * (c * d[n - 1, m] - s * p[n - 1, m])
            if n - 2 >= m:
                b = np.sqrt(((n - 1) ** 2 - m * m) / (n * n - m * m))
                p[n, m] -= b * p[n - 2, m]
                d[n, m] -= b * d[n - 2, m]
    return p, d


def synthesize(g: np.ndarray, h: np.ndarray, lat: np.ndarray, lon: np.ndarray, height: np.ndarray) -> np.ndarray:
    """North, east, down in nT at geodetic places (degrees, km over the ellipsoid). Latitudes
    beyond 90 degrees go on along the meridian, beyond the pole; north keeps its sense."""
    phi, lam = np.radians(lat), np.radians(lon)
    e2 = 1 - (MINOR / MAJOR) ** 2
    n = MAJOR / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    rho, z = (n + height) * np.cos(phi), (n * (1 - e2) + height) * np.sin(phi)
    r = np.hypot(rho, z)
    theta = np.arctan2(rho, z)  # under 0 beyond a pole
    side = np.where(theta < 0, -1.0, 1.0)
    theta = side * np.clip(np.abs(theta), 1e-9, np.pi - 1e-9)  # the poles by their neighbourhood
    top = g.shape[0] - 1
    p, d = schmidt(top, theta)
    north, east, down = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    for k in range(1, top + 1):
        ratio = (SPHERE / r) ** (k + 2)
        for m in range(k + 1):
            cos, sin = np.cos(m * lam), np.sin(m * lam)
            v = g[k, m] * cos + h[k, m] * sin
            north += ratio * v * d[k, m]
            east += ratio * m * (g[k, m] * sin - h[k, m] * cos) * p[k, m] / np.sin(theta)
            down -= (k + 1) * ratio * v * p[k, m]
    turn = (np.pi / 2 - theta) - phi  # from the sphere's frame to the ellipsoid's
    return np.stack([north * np.cos(turn) - down * np.sin(turn), east, north * np.sin(turn) + down * np.cos(turn)])


def elements(xyz: np.ndarray, dot: np.ndarray) -> dict[str, np.ndarray]:
    """The seven elements and their yearly changes."""
    x, y, z = xyz
    dx, dy, dz = dot
    with np.errstate(divide="ignore", invalid="ignore"):
        h, f = np.hypot(x, y), np.sqrt(x * x + y * y + z * z)
        hd, fd = (x * dx + y * dy) / h, (x * dx + y * dy + z * dz) / f
        return {
            "x": x, "xdot": dx, "y": y, "ydot": dy, "z": z, "zdot": dz, "h": h, "hdot": hd, "f": f, "fdot": fd,
            "incl": np.degrees(np.arctan2(z, h)), "incldot": np.degrees((h * dz - z * hd) / (f * f)),
            "decl": np.degrees(np.arctan2(y, x)), "decldot": np.degrees((x * dy - y * dx) / (h * h)),
        }


def main_field(points: DataFrame, models: list[Model], lat: str = "lat", lon: str = "lon", height: str = "height", year: str = "year") -> DataFrame:
    """points with a struct `field` of the elements. Models are a few hundred numbers
    in the closure; years are grouped inside a batch."""
    ship(points.sparkSession)

    @F.pandas_udf(SCHEMA)
    def field(la: pd.Series, lo: pd.Series, he: pd.Series, ye: pd.Series) -> pd.DataFrame:
        a, b, c, t = (s.to_numpy(float) for s in (la, lo, he, ye))
        names = [x for f in FIELDS for x in (f, f"{f}dot")]
        out = {k: np.full(len(a), np.nan) for k in names}
        for one in np.unique(t[~np.isnan(t)]):
            at, m = t == one, choose(models, one)
            got = elements(synthesize(m.g, m.h, a[at], b[at], c[at]), synthesize(m.gdot, m.hdot, a[at], b[at], c[at]))
            for k in names:
                out[k][at] = got[k]
        return pd.DataFrame(out)

    return points.withColumn("field", field(lat, lon, height, year))


def single_point(spark, lat: float, lon: float, height: float, year: float) -> DataFrame:
    """One place as a table for main_field()."""
    return spark.createDataFrame([(float(lat), float(lon), float(height), float(year))], "lat double, lon double, height double, year double")


#: fixed values: uncertainties of the elements in nT and degrees; declination by geo.horizontal_uncertainty
UNCERTAINTY = {"f": 138.0, "h": 133.0, "x": 137.0, "y": 89.0, "z": 141.0, "incl": 0.20}
#: fixed value: latitude from which grid north is that of the polar projection
POLAR = 55.0


def grid_variation(decl: Column, lat: Column, lon: Column) -> Column:
    """Declination from grid north: of the polar projection beyond POLAR degrees, else of
    the transverse Mercator projection of the place's zone."""
    return F.when(lat >= POLAR, decl - lon).when(lat <= -POLAR, decl + lon).otherwise(decl - geo.convergence(lat, lon))


#: the columns of a result as users see it, in order
RESULT = ["lat", "lon", "height", "year", *(x for f in ("f", "h", "x", "y", "z", "decl", "incl") for x in (f, f"{f}dot"))]


def result_table(points: DataFrame, models: list[Model], lat: str = "lat", lon: str = "lon", height: str = "height", year: str = "year", weak: float = 100.0) -> DataFrame:
    """points' other columns, the 18 columns of RESULT, grid variation gv and gvdot, and the
    uncertainties u_*. At a pole (to 1/1000 degree), and where the horizontal field is under `weak` nT,
    declination, its change and what depends on them are null."""
    out = main_field(points, models, lat, lon, height, year)
    vague = (F.abs(F.pmod(F.col(lat), F.lit(180.0)) - 90.0) <= 1e-3) | (F.col("field.h") < weak)
    of = lambda c: F.when(~vague, F.col(f"field.{c}")) if c in ("decl", "decldot") else F.col(f"field.{c}")
    rest = [c for c in points.columns if c not in (lat, lon, height, year)]
    cols = [F.col(c).alias(n) for c, n in ((lat, "lat"), (lon, "lon"), (height, "height"), (year, "year"))] + [of(c).alias(c) for c in RESULT[4:]]
    cols += [grid_variation(of("decl"), F.col(lat), F.col(lon)).alias("gv"), of("decldot").alias("gvdot")]
    cols += [F.lit(v).alias(f"u_{c}") for c, v in UNCERTAINTY.items()] + [geo.horizontal_uncertainty(F.col("field.h")).alias("u_decl")]
    return out.select(*rest, *cols)


def with_crust(core: list[Model], crust: Model, split: int = 15) -> list[Model]:
    """Yearly core models, each with the crustal terms of a degree over `split`, which don't
    change."""
    out = []
    for m in core:
        top = max(m.top, crust.top)
        one = Model.__new__(Model)
        one.epoch, one.top = m.epoch, top
        one.g, one.h, one.gdot, one.hdot = (np.zeros((top + 1, top + 1)) for _ in range(4))
        for name in ("g", "h", "gdot", "hdot"):
            part = getattr(m, name)
            n = min(split, m.top) + 1
            getattr(one, name)[:n, :n] = part[:n, :n]
        one.g[split + 1 : crust.top + 1, : crust.top + 1], one.h[split + 1 : crust.top + 1, : crust.top + 1] = crust.g[split + 1 :], crust.h[split + 1 :]
        out.append(one)
    return out


def curvatures(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radii in km of the ellipsoid's curvature along the meridian and across it."""
    e2 = 1 - (MINOR / MAJOR) ** 2
    w = 1 - e2 * np.sin(np.radians(lat)) ** 2
    return MAJOR * (1 - e2) / w**1.5, MAJOR / np.sqrt(w)


def gradients(points: DataFrame, models: list[Model], step_km: float = 0.1, lat: str = "lat", lon: str = "lon", height: str = "height", year: str = "year") -> DataFrame:
    """points with structs d_north, d_east and d_down: the change of north, east and down
    components in nT a km along these directions on the ellipsoid: central differences
    over step_km, along the parallel the derivative itself."""
    ship(points.sparkSession)

    @F.pandas_udf("nx double, ny double, nz double, ex double, ey double, ez double, dx double, dy double, dz double")
    def slope(la: pd.Series, lo: pd.Series, he: pd.Series, ye: pd.Series) -> pd.DataFrame:
        a, b, c, t = (s.to_numpy(float) for s in (la, lo, he, ye))
        out = np.full((9, len(a)), np.nan)
        along, across = curvatures(a)
        turn = np.degrees(step_km / (along + c))
        cos = np.cos(np.radians(a))
        radius = (across + c) * np.where(np.abs(cos) < 1e-9, 1e-9, cos)
        for one in np.unique(t[~np.isnan(t)]):
            at, m = t == one, choose(models, one)
            order = np.arange(m.top + 1)[None]
            for k, (da, dc) in ((0, (turn, 0.0)), (2, (0.0, -step_km))):
                up, back = (synthesize(m.g, m.h, (a + sign * da)[at], b[at], (c + sign * dc)[at]) for sign in (1, -1))
                out[3 * k : 3 * k + 3, at] = (up - back) / (2 * step_km)
            # in longitude the terms g cos + h sin have the derivatives order * (h cos - g sin)
            out[3:6, at] = synthesize(order * m.h, -order * m.g, a[at], b[at], c[at]) / radius[at]
        return pd.DataFrame(dict(zip(("nx", "ny", "nz", "ex", "ey", "ez", "dx", "dy", "dz"), out, strict=True)))

    got = points.withColumn("_s", slope(lat, lon, height, year))
    return got.withColumns({f"d_{n}": F.struct(*[F.col(f"_s.{n[0]}{c}").alias(c) for c in "xyz"]) for n in ("north", "east", "down")}).drop("_s")


def to_epoch(points: DataFrame, models: list[Model], year0: float, year1: float, value: str = "t", **names) -> DataFrame:
    """Reduction of total-field values from one year to another: less the main field
    then, plus the main field now, in column `reduced`."""
    a = main_field(points.withColumn("_y0", F.lit(year0)), models, year="_y0", **names).withColumn("_f0", F.col("field.f")).drop("field", "_y0")
    b = main_field(a.withColumn("_y1", F.lit(year1)), models, year="_y1", **names)
    return b.withColumn("reduced", F.col(value) - F.col("_f0") + F.col("field.f")).drop("_y1", "_f0", "field")

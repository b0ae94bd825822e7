"""Field continuation in the frequency domain, one grid a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import ship
from isogon.operators.stats import difference_report

METHODS = {"tikhonov": 1, "integral": 2, "landweber": 3, "iterated_tikhonov": 4}
#: Fixed values of the downward filters.
ROUNDS, SIGMA, EARTH_KM = 13, 0.95, 6371.0
MOST_CELLS = 16_000_000


def up_factor(k: np.ndarray, h: float) -> np.ndarray:
    return np.exp(-k * h)


def down_factor(r: np.ndarray, method: str) -> np.ndarray:
    """Stable inverses of the upward factor r."""
    if method == "tikhonov":
        return r / (SIGMA + r * r)
    if method == "integral":
        left = 1 - r
    elif method == "landweber":
        left = 1 - SIGMA * r * r
    elif method == "iterated_tikhonov":
        left = SIGMA / (r * r + SIGMA)
    else:
        raise ValueError(f"no method {method}")
    return (1 - left**ROUNDS) / r


def continued(t: np.ndarray, dx: float, dy: float, h: float, method: str | None = None) -> np.ndarray:
    """A grid of rows in y and columns in x, continued by h: up, or down by a method.
    Edges are repeated to powers of two."""
    rows, cols = (1 << max(0, n - 1).bit_length() for n in t.shape)
    top, left = (rows - t.shape[0]) // 2, (cols - t.shape[1]) // 2
    padded = np.pad(t, ((top, rows - t.shape[0] - top), (left, cols - t.shape[1] - left)), mode="edge")
    k = 2 * np.pi * np.hypot(np.fft.fftfreq(rows, dy)[:, None], np.fft.fftfreq(cols, dx)[None])
    factor = up_factor(k, abs(h))
    if method:
        factor = down_factor(factor, method)
    return np.fft.ifft2(np.fft.fft2(padded) * factor).real[top : top + t.shape[0], left : left + t.shape[1]]


def regrid(x: np.ndarray, y: np.ndarray, v: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bilinear from a (possibly holed) grid of points to steps dx, dy; holes are 0."""
    xs, ys = np.unique(x), np.unique(y)
    if len(xs) * len(ys) > MOST_CELLS or (xs[-1] - xs[0]) / dx * ((ys[-1] - ys[0]) / dy) > MOST_CELLS:
        raise ValueError(f"a grid of over {MOST_CELLS} cells: cut it into several")
    z = np.zeros((len(ys), len(xs)))
    z[np.searchsorted(ys, y), np.searchsorted(xs, x)] = v
    nx, ny = xs[0] + np.arange(int((xs[-1] - xs[0]) / dx + 1e-9) + 1) * dx, ys[0] + np.arange(int((ys[-1] - ys[0]) / dy + 1e-9) + 1) * dy
    along = np.stack([np.interp(nx, xs, row) for row in z])
    return nx, ny, np.stack([np.interp(ny, ys, col) for col in along.T], 1)


def continue_grids(df: DataFrame, h: float, dx: float, dy: float, method: str | None = None, geographic: bool = False, grid: str = "grid_id", x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(grid, x, y, value): each grid's points put on steps dx, dy and continued by h. In
    the geographic form x, y are degrees, h km, and a step is its length at the grid's
    mean latitude."""
    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.groupby(["x", "y"], as_index=False).agg({"g": "first", "v": "mean"})
        xs, ys, z = regrid(g["x"].to_numpy(), g["y"].to_numpy(), g["v"].to_numpy(), dx, dy)
        km = np.pi * EARTH_KM / 180 if geographic else 1.0
        out = continued(z, dx * km * (np.cos(np.radians(ys.mean())) if geographic else 1.0), dy * km, h, method)
        gx, gy = np.meshgrid(xs, ys)
        return pd.DataFrame({"g": g["g"].iloc[0], "x": gx.ravel(), "y": gy.ravel(), "value": out.ravel()})

    rows = df.select(F.col(grid).cast("long").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v"))
    return rows.groupBy("g").applyInPandas(run, "g long, x double, y double, value double").withColumnRenamed("g", grid)


def accuracy_report(df: DataFrame, h: float, dx: float, dy: float, method: str, compat: bool = False, **names) -> DataFrame:
    """(part, max, min, mean, spread, n): a grid continued up by h and down again by a method
    (b), against the grid itself (a), and their difference."""
    keep = {k: v for k, v in names.items() if k != "v"}
    own = continue_grids(df, 0.0, dx, dy, **names).withColumnRenamed("value", "a")
    up = continue_grids(df, h, dx, dy, **names)
    down = continue_grids(up, h, dx, dy, method, v="value", **keep).withColumnRenamed("value", "b")
    return difference_report(own.join(down, [names.get("grid", "grid_id"), "x", "y"]), "a", "b", compat)

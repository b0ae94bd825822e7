"""Matching of tracks to a base map. The terrain-style search is relational; filters
that are sequential along a track run one task a track with the part of the map around it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import checkpointed, ship
from isogon.operators.joins import idw, within

MOST_CELLS = 4_000_000


def candidates(base: DataFrame, first: DataFrame, radius: float) -> DataFrame:
    """(track_id, cx, cy): base places nearer than radius to a track's first fix."""
    near = within(base.select("x", "y").distinct(), first.select("x", "y"), radius)
    d2 = (F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2
    f = first.select("track_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    size = radius
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    f = f.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_cx": F.floor(F.col("fx") / size) + F.col("_i"), "_cy": F.floor(F.col("fy") / size) + F.col("_j")}).drop("_i", "_j")
    b = near.withColumns({"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)})
    return b.join(f, ["_cx", "_cy"]).where(d2 < radius * radius).select("track_id", F.col("x").alias("cx"), F.col("y").alias("cy"))


def tercom(base: DataFrame, track: DataFrame, radius: float = 9.0, cell: float = 1.0, neighbours: int = 10, angles: list[float] | None = None, refine: float | None = None, passes: int = 50) -> DataFrame:
    """(track_id, dx, dy, angle, msd): for each track (track_id, seq, x, y, v) the shift, and
    the turn about its first fix if angles are given, whose values on the map (inverse
    distance, weight 1 / d, of the nearest places within radius, else of the nearest)
    differ least from the track's. With refine, turns by this step around the best one are
    tried for its shift, up to the angles' step away, as long as one is better."""
    base = checkpointed(base.groupBy("x", "y").agg(F.avg("v").alias("v")).withColumn("id", F.struct("x", "y")))
    first = track.groupBy("track_id").agg(F.min_by("x", "seq").alias("x"), F.min_by("y", "seq").alias("y"))
    turns = F.array(*[F.lit(float(a)) for a in angles or [0.0]])
    best = _best(base, track, first, candidates(base, first, radius).withColumn("angle", F.explode(turns)), radius, cell, neighbours)
    if not refine or not angles or len(angles) < 2:
        return best
    best, reach = checkpointed(best), abs(angles[1] - angles[0])
    fine = F.array(*[F.lit(k * refine) for k in range(-round(reach / refine), round(reach / refine) + 1)])
    at = first.select("track_id", F.col("x").alias("fx"), F.col("y").alias("fy"))
    for _ in range(passes):
        around = best.join(at, "track_id").select("track_id", (F.col("fx") + F.col("dx")).alias("cx"), (F.col("fy") + F.col("dy")).alias("cy"), F.explode(F.transform(fine, lambda a: a + F.col("angle"))).alias("angle"))
        new = _best(base, track, first, around, radius, cell, neighbours).select("track_id", F.col("angle").alias("_a"), F.col("msd").alias("_m"))
        both = checkpointed(best.join(new, "track_id").withColumn("_b", F.col("_m") < F.col("msd")))
        best = both.select("track_id", "dx", "dy", F.when(F.col("_b"), F.col("_a")).otherwise(F.col("angle")).alias("angle"), F.least("_m", "msd").alias("msd"))
        if both.where("_b").isEmpty():
            break
    return best


def _best(base: DataFrame, track: DataFrame, first: DataFrame, cand: DataFrame, radius: float, cell: float, neighbours: int) -> DataFrame:
    """Of candidates (track_id, cx, cy, angle) each track's best as (track_id, dx, dy, angle, msd)."""
    t = track.join(first.select("track_id", F.col("x").alias("fx"), F.col("y").alias("fy")), "track_id").join(cand, "track_id")
    a, ox, oy = F.radians("angle"), F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    moved = t.select("track_id", "seq", "cx", "cy", "angle", (F.col("cx") - F.col("fx")).alias("dx"), (F.col("cy") - F.col("fy")).alias("dy"), F.col("v").cast("double").alias("tv"), F.struct((F.col("cx") + ox * F.cos(a) - oy * F.sin(a)).alias("x"), (F.col("cy") + ox * F.sin(a) + oy * F.cos(a)).alias("y")).alias("q_id"))
    # one look-up for each distinct place
    places = moved.select("q_id").distinct().select(F.col("q_id").alias("id"), "q_id.x", "q_id.y")
    values = idw(places, base, neighbours, cell, power=1, radius=radius)
    got = moved.join(values, "q_id")
    cost = got.groupBy("track_id", "dx", "dy", "angle").agg(F.avg((F.col("tv") - F.col("value")) ** 2).alias("msd"))
    best = cost.groupBy("track_id").agg(F.min(F.struct("msd", F.abs("angle").alias("turn"), "dx", "dy", "angle")).alias("b"))
    return best.select("track_id", "b.dx", "b.dy", "b.angle", "b.msd")


class Map:
    """A dense grid of the base map: step, origin and values by nearest place. Places without
    a value take the mean of their neighbours', from the rims inwards."""

    def __init__(self, x: np.ndarray, y: np.ndarray, v: np.ndarray, step: float):
        self.step, self.x0, self.y0 = step, x.min(), y.min()
        shape = int(round((y.max() - self.y0) / step)) + 1, int(round((x.max() - self.x0) / step)) + 1
        if shape[0] * shape[1] > MOST_CELLS:
            raise ValueError("the map around a track is over 4 million cells: cut the track")
        self.z = np.full(shape, np.nan)
        self.z[np.round((y - self.y0) / step).astype(int), np.round((x - self.x0) / step).astype(int)] = v
        while (hole := np.isnan(self.z)).any():
            wide = np.pad(self.z, 1, constant_values=np.nan)
            near = np.stack([wide[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3)])
            known = ~np.isnan(near)
            total, n = np.where(known, near, 0).sum(0), known.sum(0)
            self.z[hole & (n > 0)] = (total / np.maximum(n, 1))[hole & (n > 0)]

    def cell(self, x: float, y: float) -> tuple[int, int]:
        r, c = int(round((y - self.y0) / self.step)), int(round((x - self.x0) / self.step))
        return min(max(r, 0), self.z.shape[0] - 1), min(max(c, 0), self.z.shape[1] - 1)

    def value(self, x: float, y: float) -> float:
        r, c = min(max((y - self.y0) / self.step, 0), self.z.shape[0] - 1.001), min(max((x - self.x0) / self.step, 0), self.z.shape[1] - 1.001)
        i, j = int(r), int(c)
        a, b = r - i, c - j
        z = self.z[i : i + 2, j : j + 2]
        return float(z[0, 0] * (1 - a) * (1 - b) + z[0, 1] * (1 - a) * b + z[1, 0] * a * (1 - b) + z[1, 1] * a * b)

    def plane(self, x: float, y: float, half: int = 2) -> tuple[float, float, float]:
        """Value and slopes in x and y of the plane through the 5 x 5 around a place."""
        r, c = self.cell(x, y)
        rows, cols = np.arange(max(r - half, 0), min(r + half + 1, self.z.shape[0])), np.arange(max(c - half, 0), min(c + half + 1, self.z.shape[1]))
        cc, rr = np.meshgrid(cols, rows)
        a = np.column_stack([np.ones(cc.size), (self.x0 + cc.ravel() * self.step) - x, (self.y0 + rr.ravel() * self.step) - y])
        return tuple(np.linalg.lstsq(a, self.z[np.ix_(rows, cols)].ravel(), rcond=None)[0])


def sitan_track(m: Map, x: np.ndarray, y: np.ndarray, v: np.ndarray, start: float = 1.0, process: float = 0.05, noise: float = 4.0) -> np.ndarray:
    """Kalman filter of the position error along one track: between fixes it moves as
    the track does, at a fix the map's local plane is its measurement. A row for each
    fix but the first."""
    err, cov, out = np.zeros(2), np.eye(2) * start**2, []
    for i in range(1, len(x)):
        cov = cov + np.eye(2) * process
        at = np.array([x[i], y[i]]) + err
        z, sx, sy = m.plane(*at)
        slope = np.array([sx, sy])
        gain = cov @ slope / (slope @ cov @ slope + noise)
        err = err + gain * (v[i] - z)
        cov = (np.eye(2) - np.outer(gain, slope)) @ cov
        out.append(np.array([x[i], y[i]]) + err)
    return np.array(out).reshape(-1, 2)


def contour_points(m: Map, level: float, x: float, y: float, reach: float) -> np.ndarray:
    """Where the map crosses a level near a place, along grid lines."""
    r0, c0 = m.cell(x - reach, y - reach)
    r1, c1 = m.cell(x + reach, y + reach)
    z = m.z[r0 : r1 + 1, c0 : c1 + 1] - level
    points = []
    for axis in (0, 1):
        a, b = (z[:-1], z[1:]) if axis == 0 else (z[:, :-1], z[:, 1:])
        i, j = np.nonzero((a < 0) != (b < 0))
        t = a[i, j] / (a[i, j] - b[i, j])
        points.append(np.column_stack([m.x0 + (c0 + j + (t if axis else 0)) * m.step, m.y0 + (r0 + i + (0 if axis else t)) * m.step]))
    return np.concatenate(points)


def iccp_track(m: Map, x: np.ndarray, y: np.ndarray, v: np.ndarray, reach: float = 5.0, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Iterated closest contour points: each fix goes to the nearest point of its value's
    contour, the track follows by the best rigid motion, until it rests."""
    at = np.column_stack([x, y]).astype(float)
    for _ in range(rounds):
        goal = at.copy()
        for i, (place, level) in enumerate(zip(at, v, strict=True)):
            points = contour_points(m, level, *place, reach)
            if len(points):
                goal[i] = points[((points - place) ** 2).sum(1).argmin()]
        ca, cg = at.mean(0), goal.mean(0)
        a, g = at - ca, goal - cg
        turn = np.arctan2((a[:, 0] * g[:, 1] - a[:, 1] * g[:, 0]).sum(), (a * g).sum())
        rot = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        new = a @ rot.T + cg
        moved, at = ((new - at) ** 2).sum(), new
        if moved < tolerance:
            break
    return at


def match_tracks(base: DataFrame, track: DataFrame, step: float, method: str) -> DataFrame:
    """(track_id, seq, x, y): `sitan` or `iccp` over each track by itself, on the base map's
    grid around it (4 million cells at most): the map's cells go to the tracks that pass by
    through tiles, and a track and its cells meet in one task. A track without any cell of
    the map around it has no rows."""
    ship(track.sparkSession)
    margin, tile = 20 * step, 64 * step
    rows = track.select(F.col("track_id").cast("long").alias("track_id"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v"))
    box = rows.groupBy(F.col("track_id").alias("track_id")).agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    for k in "xy":
        box = box.withColumn(f"t{k}", F.explode(F.sequence(F.floor(F.col(f"{k}0") / tile), F.floor(F.col(f"{k}1") / tile))))
    cells = base.groupBy((F.round(F.col("x") / step) * step).alias("x"), (F.round(F.col("y") / step) * step).alias("y")).agg(F.avg("v").cast("double").alias("v"))
    cells = cells.withColumns({f"t{k}": F.floor(F.col(k) / tile) for k in "xy"})
    near = cells.join(box, ["tx", "ty"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select(F.col("track_id").alias("map_of"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("v").alias("mv"))

    def run(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        if not len(g) or not len(m):
            return g[["track_id", "seq", "x", "y"]].iloc[:0]
        grid = Map(m["mx"].to_numpy(), m["my"].to_numpy(), m["mv"].to_numpy(), step)
        x, y, v = g["x"].to_numpy(float), g["y"].to_numpy(float), g["v"].to_numpy(float)
        if method == "sitan":
            got, g = sitan_track(grid, x, y, v), g.iloc[1:]
        else:
            got = iccp_track(grid, x, y, v)
        return pd.DataFrame({"track_id": g["track_id"], "seq": g["seq"], "x": got[:, 0], "y": got[:, 1]})

    return rows.groupBy("track_id").cogroup(near.groupBy("map_of")).applyInPandas(run, "track_id long, seq long, x double, y double")


def shifted(track: DataFrame, found: DataFrame) -> DataFrame:
    """Tracks moved as tercom() found."""
    first = track.groupBy("track_id").agg(F.min_by("x", "seq").alias("fx"), F.min_by("y", "seq").alias("fy"))
    t = track.join(first, "track_id").join(found, "track_id")
    a, ox, oy = F.radians("angle"), F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    return t.select("track_id", "seq", (F.col("fx") + F.col("dx") + ox * F.cos(a) - oy * F.sin(a)).alias("x"), (F.col("fy") + F.col("dy") + ox * F.sin(a) + oy * F.cos(a)).alias("y"), "v")


def autonav(base: DataFrame, track: DataFrame, step: float = 0.5, radius: float = 9.0) -> DataFrame:
    """(track_id, seq, x, y, method): the search, then both filters on what it found, and
    the contour filter on the raw track too."""
    near = shifted(track, tercom(base, track, radius, step))
    parts = [near.select("track_id", "seq", "x", "y").withColumn("method", F.lit("tercom"))]
    for name, rows, method in (("sitan", near, "sitan"), ("iccp", near, "iccp"), ("iccp_raw", track, "iccp")):
        parts.append(match_tracks(base, rows, step, method).withColumn("method", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def track_rms(track: DataFrame, truth: DataFrame) -> DataFrame:
    """(track_id, rms, n) of the distance to the truth at the same seq."""
    j = track.join(truth.select("track_id", "seq", F.col("x").alias("tx"), F.col("y").alias("ty")), ["track_id", "seq"])
    return j.groupBy("track_id").agg(F.sqrt(F.avg((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)).alias("rms"), F.count("*").alias("n"))


def tercom_then_contours(base: DataFrame, track: DataFrame, truth: DataFrame, step: float = 0.5, radius: float = 9.0) -> DataFrame:
    """(method, track_id, rms, n): how far the raw track, the search's and the contour filter's
    on what the search found lie from the truth."""
    found = shifted(track, tercom(base, track, radius, step))
    parts = {"raw": track, "tercom": found, "iccp": match_tracks(base, found, step, "iccp")}
    out = None
    for name, rows in parts.items():
        part = track_rms(rows, truth).select(F.lit(name).alias("method"), "track_id", "rms", "n")
        out = part if out is None else out.unionByName(part)
    return out


def misfit(track: DataFrame, truth: DataFrame, v: str = "v") -> DataFrame:
    """(track_id, msd, n): mean squared difference of the values at the same seq."""
    j = track.select("track_id", "seq", F.col(v).cast("double").alias("a")).join(truth.select("track_id", "seq", F.col(v).cast("double").alias("b")), ["track_id", "seq"])
    return j.groupBy("track_id").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("msd"), F.count("*").alias("n"))

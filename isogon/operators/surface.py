"""Surface models. Polynomials are fitted from sums over the whole table; kernels of
all points are solved in one task, with an error above a stated size, and above it
block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isogon.cluster import ship, through_table
from isogon.functions.geo import fusion_weight, legendre
from isogon.operators.joins import idw, influence, nearest
from isogon.operators.stats import robust_bounds

MOST_KERNEL = 4_000


def normaliser(df: DataFrame, *cols: str) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] if row[f"hi_{c}"] is not None else 1.0) for c in cols}


def scaled(c: Column, span: tuple[float, float], symmetric: bool = False) -> Column:
    lo, hi = span
    unit = (c - lo) / ((hi - lo) or 1.0)
    return 2 * unit - 1 if symmetric else unit


def unscaled(c: Column, span: tuple[float, float], symmetric: bool = False) -> Column:
    """scaled() undone."""
    lo, hi = span
    return lo + ((c + 1) / 2 if symmetric else c) * ((hi - lo) or 1.0)


class Polynomial:
    """Least squares over all monomials of total degree up to cutoff, in coordinates
    scaled to [0, 1]: sums of products in the cluster, by batches, and one small solve here.
    Rows with a null count for nothing."""

    def __init__(self, cutoff: int = 5, x: str = "x", y: str = "y", v: str = "v"):
        self.cutoff, self.x, self.y, self.v = cutoff, x, y, v
        self.powers = [(i, j) for i in range(cutoff + 1) for j in range(cutoff + 1 - i)]
        if len(self.powers) > 2000:
            raise ValueError("over 2000 terms")

    def terms(self) -> list[Column]:
        a, b = scaled(F.col(self.x), self.span[self.x]), scaled(F.col(self.y), self.span[self.y])
        return [F.pow(a, i) * F.pow(b, j) for i, j in self.powers]

    def fit(self, df: DataFrame) -> Polynomial:
        ship(df.sparkSession)
        self.span = normaliser(df, self.x, self.y)
        a, b, v = scaled(F.col(self.x), self.span[self.x]).alias("a"), scaled(F.col(self.y), self.span[self.y]).alias("b"), F.col(self.v).cast("double").alias("v")
        low, high = self.cutoff + 1, 2 * self.cutoff + 1

        def moments(batches):
            # a product of two monomials is a monomial: each sum is taken once
            lhs, rhs = np.zeros((high, high)), np.zeros((low, low))
            for batch in batches:
                x, y, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                p, q = np.vander(x, high, increasing=True), np.vander(y, high, increasing=True)
                lhs += p.T @ q
                rhs += (p[:, :low] * v[:, None]).T @ q[:, :low]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(high * high + low * low)), pa.array(np.concatenate([lhs.ravel(), rhs.ravel()]))], names=["k", "s"])

        rows = df.select(a, b, v).where("a IS NOT NULL AND b IS NOT NULL AND v IS NOT NULL")
        sums = rows.mapInArrow(moments, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
        s = np.array([r.s for r in sums])
        if not len(s) or not s[0]:
            raise ValueError("no points to fit")
        m, r = s[: high * high].reshape(high, high), s[high * high :].reshape(low, low)
        lhs = np.array([[m[i + k, j + n] for k, n in self.powers] for i, j in self.powers])
        rhs = np.array([r[i, j] for i, j in self.powers])
        lhs[np.diag_indices(len(lhs))] += 1e-10 * lhs.diagonal().max()
        self.coefficients = np.linalg.solve(lhs, rhs)
        return self

    def evaluate(self, df: DataFrame, name: str = "fit") -> DataFrame:
        return df.withColumn(name, sum((F.lit(float(c)) * t for c, t in zip(self.coefficients, self.terms(), strict=True)), F.lit(0.0)))


def legendre_surface(df: DataFrame, at: DataFrame, degree: int = 5, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """`at` with fit: the projection on products of Legendre polynomials over [-1, 1]
    (sums, not least squares), all in column expressions."""
    span = normaliser(df, x, y)
    px, py = legendre(scaled(F.col(x), span[x], True), degree), legendre(scaled(F.col(y), span[y], True), degree)
    sums = df.agg(*[(F.sum(F.col(v).cast("double") * px[n] * py[m]) / F.count(v) * ((2 * n + 1) * (2 * m + 1) / 4)).alias(f"c{n}_{m}") for n in range(degree + 1) for m in range(degree + 1)])
    return at.join(F.broadcast(sums)).withColumn("fit", sum((F.col(f"c{n}_{m}") * px[n] * py[m] for n in range(degree + 1) for m in range(degree + 1)), F.lit(0.0))).select(*at.columns, "fit")


# kernels: pure NumPy


def multiquadric(d2: np.ndarray, sigma2: float, inverse: bool = False) -> np.ndarray:
    q = np.sqrt(d2 + sigma2)
    return 1 / q if inverse else q


def tension(d2: np.ndarray, eps: float) -> np.ndarray:
    return d2 * np.log(d2 + eps)


def thin_plate(d2: np.ndarray) -> np.ndarray:
    return d2 * np.log(np.maximum(np.sqrt(d2), 1e-10))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, by products: no more than one number a pair at a time."""
    centre = b.mean(0) if len(b) else 0.0
    a, b = a - centre, b - centre
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def solve_multiquadric(p: np.ndarray, v: np.ndarray, q: np.ndarray, sigma2: float = 10.0, inverse: bool = False) -> np.ndarray:
    if len(p) > MOST_KERNEL:
        raise ValueError(f"{len(p)} points; above {MOST_KERNEL} model block by block")
    w = np.linalg.lstsq(multiquadric(distances(p, p), sigma2, inverse), v, rcond=None)[0]
    return multiquadric(distances(q, p), sigma2, inverse) @ w


def solve_tension(p: np.ndarray, v: np.ndarray, q: np.ndarray, eps: float = 0.01, c: int = 1000) -> np.ndarray:
    """Spline in tension with an affine trend; the diagonal is c // 2."""
    if len(p) > MOST_KERNEL:
        raise ValueError(f"{len(p)} points; above {MOST_KERNEL} model block by block")
    n = len(p)
    a = np.zeros((n + 3, n + 3))
    a[:n, :n] = tension(distances(p, p), eps)
    a[np.arange(n), np.arange(n)] = c // 2
    a[:n, n], a[:n, n + 1 :] = 1, p
    a[n:, :n] = a[:n, n:].T
    w = np.linalg.lstsq(a, np.append(v, np.zeros(3)), rcond=None)[0]
    return tension(distances(q, p), eps) @ w[:n] + w[n] + q @ w[n + 1 :]


def solve_local(p: np.ndarray, v: np.ndarray, q: np.ndarray, k: int = 30) -> np.ndarray:
    """Thin plate over the k nearest with a bilinear trend, one small system a place;
    kept within the neighbours' values, widened by half their range."""
    out = np.empty(len(q))
    for i, place in enumerate(q):
        d2 = ((p - place) ** 2).sum(1)
        near = np.argpartition(d2, min(k, len(p)) - 1)[: min(k, len(p))]
        if d2[near].min() < 1e-12:
            out[i] = v[near[d2[near].argmin()]]
            continue
        c, val = p[near] - place, v[near]
        n = len(near)
        trend = np.column_stack([np.ones(n), c, c[:, 0] * c[:, 1]])
        a = np.zeros((n + 4, n + 4))
        a[:n, :n] = thin_plate(distances(c, c)) + 1e-6 * np.eye(n)
        a[:n, n:], a[n:, :n] = trend, trend.T
        w = np.linalg.lstsq(a, np.append(val, np.zeros(4)), rcond=None)[0]
        got = thin_plate((c**2).sum(1)) @ w[:n] + w[n]
        room = (val.max() - val.min()) / 2
        out[i] = min(max(got, val.min() - room), val.max() + room)
    return out


def fit_lssvm(p: np.ndarray, v: np.ndarray, sigma: float, c: float):
    """Least-squares support vectors with a Gaussian kernel and a bias."""
    n = len(p)
    if n > MOST_KERNEL:
        raise ValueError(f"{n} points; above {MOST_KERNEL} model block by block")
    a = np.zeros((n + 1, n + 1))
    a[0, 1:] = a[1:, 0] = 1
    a[1:, 1:] = np.exp(-distances(p, p) / sigma**2) + np.eye(n) / c
    w = np.linalg.solve(a, np.append(0.0, v))
    return lambda q: np.exp(-distances(q, p) / sigma**2) @ w[1:] + w[0]


def swarm(loss, bounds: list[tuple[float, float]], particles: int, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Particle swarm: inertia falls from 1 to 0.4, velocities and places are clamped,
    an improvement below 1e-6 over ten rounds ends it; the best particle leads. loss
    takes all places at once."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds).T
    at = rng.uniform(lo, hi, (particles, len(lo)))
    speed = rng.uniform(-1, 1, at.shape) * (hi - lo) * 0.1
    cost = np.asarray(loss(at))
    best, best_cost = at.copy(), cost.copy()
    history = [best_cost.min()]
    for i in range(rounds):
        lead = best[best_cost.argmin()]
        r1, r2 = rng.random(at.shape), rng.random(at.shape)
        speed = np.clip((1 - 0.6 * i / max(rounds - 1, 1)) * speed + 2 * r1 * (best - at) + 2 * r2 * (lead - at), -(hi - lo) * 0.2, (hi - lo) * 0.2)
        at = np.clip(at + speed, lo, hi)
        cost = np.asarray(loss(at))
        better = cost < best_cost
        best[better], best_cost[better] = at[better], cost[better]
        history.append(best_cost.min())
        if len(history) > 10 and history[-11] - history[-1] < 1e-6:
            break
    return best[best_cost.argmin()], float(best_cost.min())


def tune_lssvm(df: DataFrame, particles: int = 40, rounds: int = 15, seed: int = 1, x: str = "x", y: str = "y", v: str = "v", most: int = 2000) -> tuple[float, float, float]:
    """(sigma, c, error): the swarm's losses are computed by the executors, one particle a
    row, on 70 of 100 rows of a training set of at most `most` points, in the closure."""
    spark = df.sparkSession
    ship(spark)
    data = df.select(F.col(x).cast("double"), F.col(y).cast("double"), F.col(v).cast("double")).orderBy(F.xxhash64(x, y, v), x, y, v).limit(most).toPandas().to_numpy()
    scale = data.std(0)
    data = (data - data.mean(0)) / np.where(scale > 0, scale, 1)
    cut = int(0.7 * len(data))
    train, test = data[:cut], data[cut:]

    def errors(batches):
        for b in batches:
            out = []
            for s, c in zip(b.sigma, b.c, strict=True):
                f = fit_lssvm(train[:, :2], train[:, 2], s, c)
                out.append(float(np.sqrt(((f(test[:, :2]) - test[:, 2]) ** 2).mean())))
            yield pd.DataFrame({"i": b.i, "e": out})

    def loss(places: np.ndarray) -> np.ndarray:
        rows = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(places)), "sigma": places[:, 0], "c": places[:, 1]})).repartition(spark.sparkContext.defaultParallelism)
        return rows.mapInPandas(errors, "i long, e double").orderBy("i").toPandas()["e"].to_numpy()

    best, cost = swarm(loss, [(0.05, 5.0), (0.1, 1000.0)], particles, rounds, seed)
    return float(best[0]), float(best[1]), cost


def by_blocks(points: DataFrame, targets: DataFrame, size: float, halo: float, solve, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """targets (x, y and more) with fit, by a kernel solved block by block: a block models
    its square and `halo` around it and answers for its square. Points go to all blocks
    whose halo holds them."""
    ship(points.sparkSession)
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    reach = int(np.ceil(halo / size))
    steps = F.array(*[F.lit(i).cast("long") for i in range(-reach, reach + 1)])
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v")).where("v is not null")
    p = p.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumns({"bx": F.floor(F.col("x") / size) + F.col("i"), "by": F.floor(F.col("y") / size) + F.col("j")})
    inside = (F.col("x") >= F.col("bx") * size - halo) & (F.col("x") <= (F.col("bx") + 1) * size + halo) & (F.col("y") >= F.col("by") * size - halo) & (F.col("y") <= (F.col("by") + 1) * size + halo)
    # points of one place would make the system singular: their mean
    p = p.where(inside).groupBy("bx", "by", "x", "y").agg(F.avg("v").alias("v"))
    t = targets.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct().withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(a):
            return pd.DataFrame({"x": b["x"], "y": b["y"], "fit": np.full(len(b), np.nan)})
        a = a.sort_values(["x", "y"])
        return pd.DataFrame({"x": b["x"], "y": b["y"], "fit": solve(a[["x", "y"]].to_numpy(), a["v"].to_numpy(), b[["x", "y"]].to_numpy())})

    fit = p.groupBy("bx", "by").cogroup(t.groupBy("bx", "by")).applyInPandas(block, "x double, y double, fit double")
    return targets.join(fit, [F.col(x) == fit.x, F.col(y) == fit.y], "left").select(*[targets[c] for c in targets.columns], "fit") if (x, y) != ("x", "y") else targets.join(fit, ["x", "y"], "left")


def without_outliers(points: DataFrame, v: str = "v", limit: float = 1000.0, width: float = 5.0, fallback: float = 300.0) -> DataFrame:
    """points whose value lies within `width` deviations (by the median of distances) of the
    median of the values below limit; within +-fallback where these do not vary."""
    b = robust_bounds(points, v, limit, width, fallback)
    still = F.col("mad").isNull() | (F.col("mad") < 1e-10)
    b = b.select(F.when(still, -fallback).otherwise(F.col("low")).alias("_low"), F.when(still, fallback).otherwise(F.col("high")).alias("_high"))
    return points.join(F.broadcast(b), F.col(v).cast("double").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def local_surface(points: DataFrame, targets: DataFrame, size: float, halo: float) -> DataFrame:
    """targets with fit: the local thin-plate surface through the points that are no outliers;
    where a block has none around it, the value of the nearest of all points."""
    clean = without_outliers(points).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v"))
    fit = through_table(by_blocks(clean, targets, size, halo, solve_local), "local-surface")
    lost = fit.where(F.col("fit").isNull() | F.isnan("fit")).select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
    p = clean.groupBy("x", "y").agg(F.avg("v").alias("v")).withColumn("id", F.struct("x", "y"))
    near = nearest(lost, p, 1, size).join(p.select(F.col("id").alias("p_id"), "v"), "p_id").select(F.col("q_id.x").alias("x"), F.col("q_id.y").alias("y"), F.col("v").alias("_near"))
    return fit.join(near, ["x", "y"], "left").withColumn("fit", F.when(F.col("fit").isNull() | F.isnan("fit"), F.col("_near")).otherwise(F.col("fit"))).drop("_near")


def fill_by_surface(grid: DataFrame, block: int = 50, halo: int = 10) -> DataFrame:
    """(row, col, mean, filled): every cell of the grid's extent, those without a row by the
    local surface through the others around, block by block."""
    e = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("r0 is not null")
    cells = e.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select("row", "col")
    holes = cells.join(grid.select("row", "col"), ["row", "col"], "left_anti").select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    points = grid.select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("mean").cast("double").alias("v"))
    fit = by_blocks(points, holes, float(block), float(halo), solve_local)
    filled = fit.select(F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"), F.col("fit").alias("mean"), F.lit(True).alias("filled"))
    return grid.select("row", "col", F.col("mean").cast("double").alias("mean"), F.lit(False).alias("filled")).unionByName(filled)


def block_model(blocks: DataFrame, nodes: DataFrame, solve=solve_multiquadric) -> DataFrame:
    """(bi, bj, x, y, fit): each block's points (bi, bj, x, y, v) solved at its own nodes."""
    ship(blocks.sparkSession)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"bi": [], "bj": [], "x": [], "y": [], "fit": []})
        a = a.groupby(["x", "y"], as_index=False)["v"].mean()
        return pd.DataFrame({"bi": b["bi"], "bj": b["bj"], "x": b["x"], "y": b["y"], "fit": solve(a[["x", "y"]].to_numpy(), a["v"].to_numpy(), b[["x", "y"]].to_numpy())})

    p = blocks.select(F.col("bi").cast("int").alias("bi"), F.col("bj").cast("int").alias("bj"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")])
    return p.groupBy("bi", "bj").cogroup(nodes.groupBy("bi", "bj")).applyInPandas(one, "bi int, bj int, x double, y double, fit double")


def fuse_blocks(fit: DataFrame, grid: DataFrame, window: float = 3.0) -> DataFrame:
    """Overlapping blocks as one surface: fuse() of their nodes, equal in accuracy, on grid
    (gx, gy)."""
    points = fit.select(F.lit(1.0).alias("m"), F.col("x").alias("l"), F.col("y").alias("b"), F.col("fit").alias("t"))
    return fuse(grid, points, window, window)


def block_accuracy(blocks: DataFrame, fit: DataFrame, step: float = 0.5) -> DataFrame:
    """(bi, bj, rms, n) of each block's points against its nearest node, and a row of nulls
    over all."""
    near = lambda c: F.floor(F.col(c) / step + 0.5)
    f = fit.select("bi", "bj", near("x").alias("kx"), near("y").alias("ky"), "fit")
    e = f.groupBy("bi", "bj").agg(F.min("kx").alias("x0"), F.max("kx").alias("x1"), F.min("ky").alias("y0"), F.max("ky").alias("y1"))
    keep = lambda c, k: F.greatest(F.least(near(c), F.col(f"{k}1")), F.col(f"{k}0"))
    p = blocks.join(F.broadcast(e), ["bi", "bj"]).withColumns({"kx": keep("x", "x"), "ky": keep("y", "y")})  # a row for each block
    d = p.join(f, ["bi", "bj", "kx", "ky"]).select("bi", "bj", (F.col("fit") - F.col("v").cast("double")).alias("d"))
    got = d.rollup("bi", "bj").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    return got.where("g IN (0, 3)").drop("g")


# bicubic spline

MOST_NODES = 500


def spline_slopes(y: np.ndarray, h: float) -> np.ndarray:
    """Slopes at even nodes (along the last axis) of the cubic spline whose first and last
    pieces are parabolas."""
    n = y.shape[-1]
    if n < 3:
        return np.repeat(np.diff(y, axis=-1) / h, n, axis=-1)[..., :n] if n == 2 else np.zeros_like(y)
    a = np.zeros((n, n))
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = 1, 4, 1
    a[0, 0] = a[0, 1] = a[-1, -1] = a[-1, -2] = 1
    rhs = np.empty_like(y, dtype=float)
    rhs[..., 1:-1] = 3 * (y[..., 2:] - y[..., :-2]) / h
    rhs[..., 0], rhs[..., -1] = 2 * (y[..., 1] - y[..., 0]) / h, 2 * (y[..., -1] - y[..., -2]) / h
    return np.linalg.solve(a, rhs.reshape(-1, n).T).T.reshape(y.shape)


class Bicubic:
    """The spline through a dense grid z[row, col] at x0 + col hx, y0 + row hy."""

    def __init__(self, z: np.ndarray, x0: float, y0: float, hx: float, hy: float):
        self.z, self.x0, self.y0, self.hx, self.hy = z, x0, y0, hx, hy
        self.dx, self.dy = spline_slopes(z, hx), spline_slopes(z.T, hy).T
        self.dxy = spline_slopes(self.dy, hx)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rows, cols = self.z.shape
        u, w = (x - self.x0) / self.hx, (y - self.y0) / self.hy
        j, i = np.clip(np.floor(u).astype(int), 0, cols - 2), np.clip(np.floor(w).astype(int), 0, rows - 2)
        u, w = u - j, w - i

        def basis(t):
            return ((1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)), (t * (1 - t) ** 2, t * t * (t - 1))

        (vx, sx), (vy, sy) = basis(u), basis(w)
        out = np.zeros(len(x))
        for a in (0, 1):
            for b in (0, 1):
                at = (i + a, j + b)
                out += vy[a] * (vx[b] * self.z[at] + self.hx * sx[b] * self.dx[at]) + self.hy * sy[a] * (vx[b] * self.dy[at] + self.hx * sx[b] * self.dxy[at])
        return out


def smooth_surface(points: DataFrame, targets: DataFrame, nodes: int = 200, k: int = 32, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """targets with fit: inverse-distance means of the k nearest points on nodes x nodes places
    over the points' extent, and the bicubic spline through them. The nodes' values, at
    most MOST_NODES squared, are gathered and sent to all tasks."""
    if not 2 <= nodes <= MOST_NODES:
        raise ValueError(f"from 2 to {MOST_NODES} nodes")
    spark = points.sparkSession
    ship(spark)
    e = points.agg(F.min(x).cast("double"), F.max(x).cast("double"), F.min(y).cast("double"), F.max(y).cast("double"), F.count("*")).first()
    if not e[4]:
        return targets.withColumn("fit", F.lit(None).cast("double"))
    hx, hy = (e[1] - e[0]) / (nodes - 1) or 1.0, (e[3] - e[2]) / (nodes - 1) or 1.0
    at = spark.range(nodes * nodes).select("id", (F.lit(e[0]) + F.col("id") % nodes * hx).alias("x"), (F.lit(e[2]) + F.floor(F.col("id") / nodes) * hy).alias("y"))
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v")).where("v is not null").groupBy("x", "y").agg(F.avg("v").alias("v")).withColumn("id", F.struct("x", "y"))
    cell = max(((e[1] - e[0]) * (e[3] - e[2]) * k / e[4]) ** 0.5, hx, hy) / 2
    z = np.full(nodes * nodes, np.nan)
    got = idw(at, p, k, cell).toPandas()
    z[got["q_id"].to_numpy()] = got["value"].to_numpy()
    sent = spark.sparkContext.broadcast(Bicubic(z.reshape(nodes, nodes), e[0], e[2], hx, hy))

    @F.pandas_udf("double")
    def fit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(sent.value(a.to_numpy(float), b.to_numpy(float)))

    return targets.withColumn("fit", fit(F.col(x).cast("double"), F.col(y).cast("double")))


def fuse(grid: DataFrame, points: DataFrame, window_x: float, window_y: float) -> DataFrame:
    """(gx, gy, t, n): grid nodes with the mean of the points (l, b, t, source error m)
    around them, weighted by distance and by 1 / m squared."""
    pairs = influence(grid, points, window_x, window_y)
    w = fusion_weight(F.col("gx") - F.col("l"), F.col("gy") - F.col("b"), F.col("b"), window_x, window_y) / F.col("m") / F.col("m")
    return pairs.withColumn("w", w).groupBy("gx", "gy").agg(F.try_divide(F.sum(F.col("w") * F.col("t").cast("double")), F.sum("w")).alias("t"), F.count("*").alias("n"))


# compressive sensing


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal cosine transform: rows are frequencies."""
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def cosamp(a: np.ndarray, y: np.ndarray, sparsity: int, rounds: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    x, rest = np.zeros(a.shape[1]), y.copy()
    for _ in range(rounds):
        proxy = np.abs(a.T @ rest)
        support = np.union1d(np.argpartition(proxy, -min(2 * sparsity, len(proxy)))[-min(2 * sparsity, len(proxy)) :], np.flatnonzero(x))
        sol = np.linalg.lstsq(a[:, support], y, rcond=None)[0]
        keep = np.argsort(-np.abs(sol), kind="stable")[:sparsity]
        x = np.zeros(a.shape[1])
        x[support[keep]] = sol[keep]
        rest = y - a @ x
        if np.linalg.norm(rest) < tolerance * max(np.linalg.norm(y), 1e-300):
            break
    return x


def reconstruct(v: np.ndarray, share: float, sparsity: int, seed: int) -> tuple[np.ndarray, float]:
    """Values rebuilt from a random share of them, and the error on the others."""
    if len(v) > 5000:
        raise ValueError("over 5000 points: tile them")
    rng = np.random.default_rng(seed)
    taken = np.sort(rng.choice(len(v), max(1, int(share * len(v))), replace=False))
    basis = dct_matrix(len(v)).T
    got = basis @ cosamp(basis[taken], v[taken], min(sparsity, len(taken)))
    held = np.setdiff1d(np.arange(len(v)), taken)
    return got, float(np.sqrt(((got[held] - v[held]) ** 2).mean())) if len(held) else 0.0


def reconstruct_tiles(df: DataFrame, tile: str, share: float = 0.5, sparsity: int = 20, seed: int = 1, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(tile, x, y, value, error): each tile's points in x, y order, rebuilt by itself."""
    ship(df.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y", "v"])
        got, err = reconstruct(g["v"].to_numpy(float), share, sparsity, seed)
        return pd.DataFrame({"tile": g["tile"], "x": g["x"], "y": g["y"], "value": got, "error": err})

    return df.select(F.col(tile).cast("long").alias("tile"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v")).groupBy("tile").applyInPandas(run, "tile long, x double, y double, value double, error double")

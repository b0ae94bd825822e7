"""Look-ups and spatial joins: cell keys make them equi-joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isogon.cluster import checkpointed, ship


def index_lookup(points: DataFrame, grid: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """points with lon, lat and z of the grid cell that key names; without a cell its
    own place and 0. The grid is read for the points' distinct keys only, by a semi-join
    that Spark broadcasts if they are few, and what it gives is joined back."""
    keyed = points.withColumn("index_ij", key)
    hits = grid.join(keyed.select("index_ij").distinct(), "index_ij", "left_semi").select("index_ij", F.col("lon").alias("g_lon"), F.col("lat").alias("g_lat"), F.col(value).alias("g_v"))
    out = keyed.join(hits, "index_ij", "left")
    return out.withColumns({"lon": F.coalesce("g_lon", "lon"), "lat": F.coalesce("g_lat", "lat"), "z": F.coalesce("g_v", F.lit(0))}).drop("g_lon", "g_lat", "g_v")


def _cells(df: DataFrame, size: float, x: str, y: str, around: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumns({"_cx": cx, "_cy": cy})
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    return df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_cx": cx + F.col("_i"), "_cy": cy + F.col("_j")}).drop("_i", "_j")


def within(points: DataFrame, others: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """points that have one of others within radius. Cells as wide as the radius; the
    distinct places of others visit the nine around them."""
    o = _cells(others.select(F.col(x).alias("_ox"), F.col(y).alias("_oy")).distinct(), radius, "_ox", "_oy", True)
    p = _cells(points, radius, x, y, False)
    near = (p._cx == o._cx) & (p._cy == o._cy) & ((F.col(x) - F.col("_ox")) ** 2 + (F.col(y) - F.col("_oy")) ** 2 <= radius * radius)
    return p.join(o, near, "left_semi").drop("_cx", "_cy")


#: points a tile of nearest() has in the mean, tiles at most, and queries to a task
TILE, MOST_TILES, PART = 2048, 8192, 1_000_000


def _tiles(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A tree that halves places again and again across their wider side, until it has count
    leaves or more: (axes 0 or 1, cuts) of its inner nodes in heap order, and its levels."""
    levels = max(0, int(np.ceil(np.log2(max(1, count)))))
    axes, cuts, parts = [], [], [np.arange(len(x))]
    for _ in range(levels):
        after = []
        for part in parts:
            axis = 0 if not len(part) or np.ptp(x[part]) >= np.ptp(y[part]) else 1
            v = (x, y)[axis][part]
            cut = float(np.median(v)) if len(part) else 0.0
            axes.append(axis)
            cuts.append(cut)
            after += [part[v < cut], part[v >= cut]]
        parts = after
    return np.array(axes, int), np.array(cuts, float), levels


def _leaf(tree, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The tile of each place."""
    axes, cuts, levels = tree
    at = np.zeros(len(x), np.int64)  # place in the level; the level's nodes begin at 2 ** level - 1
    for level in range(levels):
        node = at + 2**level - 1
        at = 2 * at + (np.where(axes[node] == 0, x, y) >= cuts[node])
    return at


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, q_id: str = "id", p_id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(q_id, p_id, d2, rank): the k nearest points, by distance and then id, exact; null and
    infinite places and NaN count for nothing. A tree over a bounded draw of the places cuts
    the points into tiles, whose bounds and counts (MOST_TILES at most) go to the queries. A
    query first goes to the tiles nearest to it that hold k points; what it finds
    bounds its distance, and it goes to all tiles within it. Of points at one place the
    k least ids count. `cell`, a width of cells in earlier versions, is not used."""
    spark = queries.sparkSession
    ship(spark)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    p = points.select(F.col(p_id).alias("p_id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).where(finite("px") & finite("py"))
    q = queries.select(F.col(q_id).alias("q_id"), F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")).where(finite("qx") & finite("qy"))
    p = p.withColumn("_n", F.row_number().over(W.partitionBy("px", "py").orderBy("p_id"))).where(F.col("_n") <= k).drop("_n")
    pid, qid = p.schema["p_id"].dataType, q.schema["q_id"].dataType
    out = T.StructType([T.StructField("q_id", qid), T.StructField("p_id", pid), T.StructField("d2", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    p = checkpointed(p)
    n = p.count()
    if not n:
        return spark.createDataFrame([], out)
    want = min(MOST_TILES, -(-n // TILE))
    drawn = p.select("px", "py").orderBy(F.xxhash64("px", "py")).limit(want * 16).toPandas() if want > 1 else None
    tree = _tiles(drawn["px"].to_numpy(), drawn["py"].to_numpy(), want) if want > 1 else (np.zeros(0, int), np.zeros(0), 0)

    @F.pandas_udf("long")
    def tile(px: pd.Series, py: pd.Series) -> pd.Series:
        return pd.Series(_leaf(tree, px.to_numpy(), py.to_numpy()))

    p = p.withColumn("tile", tile("px", "py"))
    got = p.groupBy("tile").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("px", "py") for f in (F.min, F.max)]).toPandas()
    sent = spark.sparkContext.broadcast({c: got[c].to_numpy() for c in got.columns})

    def away(qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) squared distance of places to the tiles' bounds."""
        t = sent.value
        gap = [np.maximum(np.maximum(t[f"{c}_min"] - v[:, None], v[:, None] - t[f"{c}_max"]), 0) for c, v in (("px", qx), ("py", qy))]
        far = [np.maximum(np.abs(v[:, None] - t[f"{c}_min"]), np.abs(v[:, None] - t[f"{c}_max"])) for c, v in (("px", qx), ("py", qy))]
        return gap[0] ** 2 + gap[1] ** 2, far[0] ** 2 + far[1] ** 2

    def first(batches):
        """Queries and the tiles whose farthest corners are nearest, which hold k points together."""
        t = sent.value
        for batch in batches:
            qx, qy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("qx", "qy"))
            for a in range(0, len(qx), 256):
                far = away(qx[a : a + 256], qy[a : a + 256])[1]
                order = np.argsort(far, axis=1, kind="stable")
                held = np.cumsum(t["n"][order], axis=1)
                i, j = np.nonzero(held - t["n"][order] < k)
                yield _sent(batch, a + i, t["tile"][order[i, j]])

    def rest(batches):
        """Queries and all tiles within the distance found (none: all tiles)."""
        t = sent.value
        for batch in batches:
            qx, qy, most = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("qx", "qy", "most"))
            for a in range(0, len(qx), 256):
                bound = most[a : a + 256, None] * (1 + 1e-9)
                i, j = np.nonzero(~(away(qx[a : a + 256], qy[a : a + 256])[0] > bound))
                yield _sent(batch, a + i, t["tile"][j])

    def search(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        qx, qy, px, py = (t.column(c).to_numpy() for t, c in ((asked, "qx"), (asked, "qy"), (held, "px"), (held, "py")))
        ids = held.select(["p_id"])
        while any(pa.types.is_struct(t) for t in ids.schema.types):
            ids = ids.flatten()
        order = pc.sort_indices(ids, sort_keys=[(c, "ascending") for c in ids.column_names], null_placement="at_start").to_numpy()  # ties of distance by id
        px, py = px[order], py[order]
        at, whose, d2s = [], [], []
        step = max(1, 1_000_000 // max(1, len(px)))
        for a in range(0, len(qx), step):
            d2 = (qx[a : a + step, None] - px) ** 2 + (qy[a : a + step, None] - py) ** 2
            bound = np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if len(px) > k else np.full((len(d2), 1), np.inf)
            i, j = np.nonzero(d2 <= bound)
            d = d2[i, j]
            s = np.lexsort((j, d, i))
            i, j, d = i[s], j[s], d[s]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            at.append(a + i[keep])
            whose.append(order[j[keep]])
            d2s.append(d[keep])
        at, whose, d2s = (np.concatenate(v) if v else np.zeros(0, int) for v in (at, whose, d2s))
        return pa.table({"row": asked.column("row").take(pa.array(at)), "p_id": held.column("p_id").take(pa.array(whose)), "d2": pa.array(d2s, pa.float64())})

    q = checkpointed(q.withColumn("row", F.monotonically_increasing_id()))
    # the queries of a tile are cut into parts of about PART
    parts = -(-max(1, q.count()) // PART)
    part, dealt = F.pmod(F.xxhash64("row"), F.lit(parts)), p.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    spread = "row long, qx double, qy double, tile long"
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("p_id", pid), T.StructField("d2", T.DoubleType())])
    best = W.partitionBy("row").orderBy("d2", "p_id")

    def found(asked: DataFrame) -> DataFrame:
        hits = asked.withColumn("part", part).groupBy("tile", "part").cogroup(dealt.groupBy("tile", "part")).applyInArrow(search, kind)
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    spots = q.select("row", "qx", "qy")
    near = found(spots.mapInArrow(first, spread)).groupBy("row").agg(F.when(F.count("*") >= k, F.max("d2")).alias("most"))
    done = found(spots.join(near, "row", "left").mapInArrow(rest, spread))
    return q.select("row", "q_id").join(done, "row").select("q_id", "p_id", "d2", "rank")


def _sent(batch: pa.RecordBatch, at: np.ndarray, tile: np.ndarray) -> pa.RecordBatch:
    rows = batch.select(["row", "qx", "qy"]).take(pa.array(at))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(tile, pa.int64())], names=["row", "qx", "qy", "tile"])


def idw(queries: DataFrame, points: DataFrame, k: int, cell: float, power: int = 2, v: str = "v", radius: float | None = None, exact: float = 1e-6, **names) -> DataFrame:
    """(q_id, value): inverse distance to the power, of the k nearest; a point nearer than
    `exact` gives its own value. With a radius only points nearer than it count; where
    there is none, the nearest point's value stands."""
    near = nearest(queries, points, k, cell, **names)
    vals = near.join(points.select(F.col(names.get("p_id", "id")).alias("p_id"), F.col(v).cast("double").alias("v")), "p_id")
    inside = F.col("d2") < radius * radius if radius is not None else F.lit(True)
    weight = F.when((F.col("d2") >= exact * exact) & inside, 1 / F.pow(F.sqrt("d2"), power))
    got = vals.groupBy("q_id").agg(F.min_by(F.when(F.col("d2") < exact * exact, F.col("v")), "rank").alias("hit"), F.sum(weight * F.col("v")).alias("s"), F.sum(weight).alias("w"), F.min_by("v", "rank").alias("first"))
    return got.select("q_id", F.coalesce("hit", F.try_divide("s", "w"), "first").alias("value"))


def influence(grid: DataFrame, points: DataFrame, window_x: float, window_y: float) -> DataFrame:
    """Pairs of grid nodes (gx, gy) and points (l, b, ...) within half a window: an
    equi-join on cells of half a window's size."""
    hx, hy = window_x / 2, window_y / 2
    g = grid.withColumns({"_cx": F.floor(F.col("gx") / hx), "_cy": F.floor(F.col("gy") / hy)})
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    p = points.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns({"_cx": F.floor(F.col("l") / hx) + F.col("_i"), "_cy": F.floor(F.col("b") / hy) + F.col("_j")}).drop("_i", "_j")
    return g.join(p, ["_cx", "_cy"]).where((F.abs(F.col("gx") - F.col("l")) <= hx) & (F.abs(F.col("gy") - F.col("b")) <= hy)).drop("_cx", "_cy")

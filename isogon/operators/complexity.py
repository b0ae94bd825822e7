"""Field complexity: features of moving squares, principal components, line spacing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import through_table
from isogon.functions.geo import line_spacing
from isogon.operators.grids import bin_mean, box_sums, framed_sum, gradients, grid_over
from isogon.operators.stats import scatter
from isogon.operators.surface import smooth_surface

FEATURES = ["sigma", "average", "slope", "flatness", "grad_sigma", "roughness"]


def features(grid: DataFrame, radius: int) -> DataFrame:
    """(row, col, FEATURES): over the 2 radius + 1 square of each cell with data, from
    sums of powers by two windows. Values are centred by the table's mean first, which
    the moments don't see. Cells without a full neighbourhood have gradient 0."""
    centre = grid.agg(F.avg("mean").alias("_c"))
    g = gradients(grid).fillna(0.0, ["e", "n", "ne", "se"]).join(F.broadcast(centre)).withColumn("v", F.col("mean") - F.col("_c"))
    right = F.lead("v").over(W.partitionBy("row").orderBy("col"))
    next_col = F.lead("col").over(W.partitionBy("row").orderBy("col"))
    below = F.lead("v").over(W.partitionBy("col").orderBy("row"))
    next_row = F.lead("row").over(W.partitionBy("col").orderBy("row"))
    g = g.withColumns({"_r": F.when(next_col == F.col("col") + 1, right), "_b": F.when(next_row == F.col("row") + 1, below)})
    one = F.lit(1.0)
    parts = {"k": one, "s1": F.col("v"), "s2": F.col("v") ** 2, "s3": F.col("v") ** 3, "s4": F.col("v") ** 4, "gm": F.sqrt(F.col("e") ** 2 + F.col("n") ** 2 + F.col("ne") ** 2 + F.col("se") ** 2)}
    for c in ("e", "n", "ne", "se"):
        parts |= {f"{c}1": F.col(c), f"{c}2": F.col(c) ** 2}
    g = g.select("row", "col", "_c", *[v.alias(k) for k, v in parts.items()], F.coalesce((F.col("v") - F.col("_r")) ** 2, F.lit(0.0)).alias("dx"), F.col("_r").isNotNull().cast("double").alias("nx"), F.coalesce((F.col("v") - F.col("_b")) ** 2, F.lit(0.0)).alias("dy"), F.col("_b").isNotNull().cast("double").alias("ny"))
    g = box_sums(g, radius, *parts)
    # differences between neighbours inside the square: one step less along their direction
    g = g.withColumns({c: framed_sum(c, "row", "col", -radius, radius - 1) for c in ("dx", "nx")} | {c: framed_sum(c, "row", "col", -radius, radius) for c in ("dy", "ny")})
    g = g.withColumns({c: framed_sum(c, "col", "row", -radius, radius) for c in ("dx", "nx")} | {c: framed_sum(c, "col", "row", -radius, radius - 1) for c in ("dy", "ny")})
    m = F.col("s1") / F.col("k")
    var = F.greatest(F.col("s2") / F.col("k") - m * m, F.lit(0.0))
    fourth = F.col("s4") / F.col("k") - 4 * m * F.col("s3") / F.col("k") + 6 * m * m * F.col("s2") / F.col("k") - 3 * m**4
    spread = lambda c: F.sqrt(F.greatest(F.col(f"{c}2") / F.col("k") - (F.col(f"{c}1") / F.col("k")) ** 2, F.lit(0.0)))
    rx, ry = F.pow(F.try_divide("dx", "nx"), 2), F.pow(F.try_divide("dy", "ny"), 2)
    rough = F.coalesce((rx + ry) / 2, rx, ry, F.lit(0.0))
    return g.where("k >= 3").select("row", "col", F.sqrt(var).alias("sigma"), (m + F.col("_c")).alias("average"), (F.col("gm") / F.col("k")).alias("slope"), F.coalesce(-F.try_divide(fourth, var * var), F.lit(0.0)).alias("flatness"), (spread("e") + spread("n") + spread("ne") + spread("se")).alias("grad_sigma"), rough.alias("roughness"))


def components(row, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights of the standardised features) from scatter(). compat:
    the covariance divides the products by n - 1 and not the means' product."""
    n, k = row["n"], len(FEATURES)
    mean = np.array([row[f"s_{c}"] for c in FEATURES]) / n
    raw = np.zeros((k, k))
    for i, a in enumerate(FEATURES):
        for j in range(i, k):
            raw[i, j] = raw[j, i] = row[f"p_{a}_{FEATURES[j]}"]
    cov = raw / (n - 1) - np.outer(mean, mean) if compat else (raw - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    share = values / values.sum()
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return mean, np.sqrt(np.maximum(cov.diagonal(), 1e-300)), (vectors * np.where(sign == 0, 1, sign)) @ share


def complexity(points: DataFrame, cell: float, jump: int = 15, air: bool = False, x: str = "x", y: str = "y", v: str = "v", compat: bool = False) -> DataFrame:
    """(row, col, FEATURES, complexity, spacing) of cells at least jump from the edge:
    features once, their scatter in the cluster, a 6 x 6 decomposition here, and the
    score as a column expression."""
    grid = through_table(bin_mean(points, cell, x, y, v).select("row", "col", "mean"), "complexity-grid")
    edge = grid.agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    f = features(grid, jump).join(F.broadcast(edge)).where((F.col("row") >= jump) & (F.col("col") >= jump) & (F.col("row") <= F.col("_h") - jump) & (F.col("col") <= F.col("_w") - jump)).drop("_h", "_w")
    f = through_table(f, "complexity-features")
    row = scatter(f, FEATURES).first()
    if row["n"] < 2:
        return f.withColumns({"complexity": F.lit(None).cast("double"), "spacing": F.lit(None).cast("double")})
    mean, dev, weight = components(row, compat)
    score = sum((F.lit(float(w)) * (F.col(c) - float(m)) / float(d) for c, m, d, w in zip(FEATURES, mean, dev, weight, strict=True)), F.lit(0.0))
    f = f.withColumn("complexity", score)
    return f.withColumn("spacing", line_spacing(F.col("complexity"), air))


def export(df: DataFrame) -> DataFrame:
    """The flag that exports carry: 1 for a spacing of 8 or more."""
    return df.withColumn("index", F.when(F.col("spacing") >= 8, 1).otherwise(0))


def gridded_complexity(points: DataFrame, step: float, jump: int = 15, nodes: int = 200, air: bool = False, compat: bool = False) -> DataFrame:
    """complexity() of points put on a regular grid of a step over their extent, its values by
    the smooth surface through nodes x nodes inverse-distance means."""
    grid = grid_over(points, step, step).select("x", "y")
    return complexity(smooth_surface(points, grid, nodes).withColumnRenamed("fit", "v"), step, jump, air, compat=compat)

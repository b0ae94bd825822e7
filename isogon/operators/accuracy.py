"""Accuracy of a background model against check lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import checkpointed
from isogon.operators.filters import every_nth, finite, in_box
from isogon.operators.joins import within
from isogon.operators.stats import least_spacing, rmse, weighted_rmse
from isogon.operators.surface import by_blocks, solve_local
from isogon.operators.windows import moving_average, moving_average_by_size, trend_offset


def predicted(background: DataFrame, lines: DataFrame, block: float, halo: float) -> DataFrame:
    """lines (line_id, seq, x, y, v) with the background interpolated at their places."""
    return by_blocks(background, lines, block, halo, solve_local).where(F.col("fit").isNotNull() & ~F.isnan("fit"))


def check_lines(background: DataFrame, lines: DataFrame, block: float = 5.0, halo: float = 2.0, window: int | None = None, near: DataFrame | None = None, radius: float = 0.002, sample: int = 1) -> DataFrame:
    """(line_id, offset, rmse, n): lines sampled and kept near given places if there are
    any, the background interpolated at them, both smoothed (by a window for the length of
    each line, if none is given), and the constant offset taken out."""
    if sample > 1:
        lines = every_nth(lines, sample, "seq", ["line_id"])
    if near is not None:
        lines = within(lines, near, radius)
    fit = predicted(background, lines.withColumn("v", F.col("v").cast("double")), block, halo)
    if window:
        both = _smoothed(fit, window, "v", "fit")
    else:
        both = fit
        for c in ("v", "fit"):
            both = moving_average_by_size(both, v=c).drop("window").withColumnRenamed("smooth", f"t_{c}")
    return trend_offset(both, "t_fit", "t_v", ["line_id"])


#: fixed value: metres in a degree
DEGREE = 111_319.0


def sparse_check_lines(classed: DataFrame, lines: DataFrame, block: float = 5.0, halo: float = 2.0, every: int = 5, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(rmse, n, lines) over lines (line_id, seq, x, y, v) in degrees, weighted by points: each
    line's every fifth point, in the box if one is given and no further from a point of
    class 1 than two of these points' least distance in longitude, against the surface
    through the points of class 1. rmse is NOTHING where no point is left."""
    spark = lines.sparkSession
    inside = classed.where(F.col("index") == 1)
    e = inside.agg(F.min("y"), F.max("y"), F.count("*")).first()
    none = spark.createDataFrame([(NOTHING, 0, 0)], "rmse double, n long, lines long")
    if not e[2]:
        return none
    turn = math.cos(math.radians((e[0] + e[1]) / 2))
    step = least_spacing(inside, "x").first()[0]
    if step is None:
        return none
    metres = lambda df: df.withColumns({"_mx": F.col("x") * DEGREE * turn, "_my": F.col("y") * DEGREE})
    chosen = every_nth(lines, every, "seq", ["line_id"])
    if box:
        chosen = in_box(chosen, *box)
    chosen = within(metres(chosen), metres(inside), step * DEGREE * turn * 2, "_mx", "_my").drop("_mx", "_my")
    per = checkpointed(check_lines(inside.select("x", "y", "v"), chosen, block, halo))
    if per.isEmpty():
        return none
    return weighted_rmse(per).select("rmse", "n").join(F.broadcast(per.agg(F.count("*").alias("lines"))))


NOTHING, NO_SPACING, TOO_FEW = -1.0, -2.0, -3.0


def _smoothed(df: DataFrame, window: int, *cols: str) -> DataFrame:
    """df with t_ means of cols over the window, in the order of seq in each line."""
    for c in cols:
        df = moving_average(df, window, v=c).withColumnRenamed("smooth", f"t_{c}")
    return df


def _size(n: int, window: int = 1120) -> int:
    size = max(min(window, n // 4), 5)
    return size + 1 - size % 2


def check_line(background: DataFrame, line: DataFrame, complexity: DataFrame, spacing: float = 8.5, tolerance: float = 0.1, radius: float = 0.002, box: tuple[float, float, float, float] | None = None, block: float = 5.0, halo: float = 2.0, fewest: int = 10) -> DataFrame:
    """(result, rmse, offset, trend_rmse, n, selected_rmse) of one line (seq, x, y, v) against
    the background, in one row. The first point is pinned to the line; offset brings the
    smoothed background to the smoothed line; points near places of complexity (x, y,
    spacing) whose spacing is the one sought are selected. result: the smoothed selected
    points' rmse, or their plain one where they are fewer than the window; NOTHING without
    points, NO_SPACING without such places, TOO_FEW with under `fewest` points selected."""
    spark = line.sparkSession
    fields = "result double, rmse double, offset double, trend_rmse double, n long, selected_rmse double"
    if box:
        line = in_box(line, *box)
    line = finite(line.select(F.lit(0).alias("line_id"), "seq", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]), "x", "y", "v")
    background = finite(background.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "v")]), "x", "y", "v")
    if line.isEmpty() or background.isEmpty() or complexity.isEmpty():
        return spark.createDataFrame([(NOTHING, None, None, None, 0, None)], fields)
    fit = predicted(background, line, block, halo)
    start = fit.agg(F.min("seq")).first()[0]
    fit = checkpointed(fit.withColumn("fit", F.when(F.col("seq") == F.lit(start), F.col("v")).otherwise(F.col("fit"))))
    n, rms = fit.agg(F.count("*"), F.sqrt(F.avg((F.col("v") - F.col("fit")) ** 2))).first()
    if not n:
        return spark.createDataFrame([(NOTHING, None, None, None, 0, None)], fields)
    window = _size(n)
    trend = trend_offset(_smoothed(fit, window, "v", "fit"), "t_fit", "t_v").first()
    places = complexity.where(F.abs(F.col("spacing") - spacing) <= tolerance)
    if places.isEmpty():
        return spark.createDataFrame([(NO_SPACING, rms, trend["offset"], trend["rmse"], n, None)], fields)
    chosen = checkpointed(within(fit.withColumn("fit", F.col("fit") + trend["offset"]), places, radius))
    k, plain = chosen.agg(F.count("*"), F.sqrt(F.avg((F.col("v") - F.col("fit")) ** 2))).first()
    if k < fewest:
        return spark.createDataFrame([(TOO_FEW, rms, trend["offset"], trend["rmse"], n, plain)], fields)
    result = plain
    if k >= window:
        result = _smoothed(chosen, window, "v", "fit").agg(F.sqrt(F.avg((F.col("t_v") - F.col("t_fit")) ** 2))).first()[0]
    return spark.createDataFrame([(result, rms, trend["offset"], trend["rmse"], n, plain)], fields)


def process_line(background: DataFrame, line: DataFrame, block: float = 5.0, halo: float = 2.0, window: int = 1120) -> DataFrame:
    """(line_id, rmse, offset, trend_rmse, n) of each line: against the background as it is, and
    what is left between the smoothed two after the offset."""
    fit = predicted(background, line.withColumn("v", F.col("v").cast("double")), block, halo)
    plain = rmse(fit, "v", "fit", ["line_id"]).withColumnRenamed("rmse", "_r").drop("n")
    got = trend_offset(_smoothed(fit, window, "v", "fit"), "t_fit", "t_v", ["line_id"])
    return got.join(plain, "line_id").select("line_id", F.col("_r").alias("rmse"), "offset", F.col("rmse").alias("trend_rmse"), "n")


def overall(per_line: DataFrame) -> DataFrame:
    return weighted_rmse(per_line)

"""Window-like operators along survey lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import through_table


def moving_average(df: DataFrame, window: int, line: str = "line_id", order: str = "seq", v: str = "v") -> DataFrame:
    """Centred mean of window // 2 rows to either side, fewer at the ends."""
    h = window // 2
    w = W.partitionBy(line).orderBy(order).rowsBetween(-h, h)
    return df.withColumn("smooth", F.sum(v).over(w).cast("double") / F.count(v).over(w))


def window_size(n: Column, window: int = 140 * 8) -> Column:
    """The window for a line of n rows: a quarter of the line, 1 at least, where it is no
    longer than the window."""
    return F.when(n > window, F.lit(window)).otherwise(F.greatest(F.floor(n / 4), F.lit(1))).cast("long")


def moving_average_by_size(df: DataFrame, window: int = 140 * 8, line: str = "line_id", order: str = "seq", v: str = "v") -> DataFrame:
    """df with `window`, by window_size() of each line, and `smooth`, the centred mean over it:
    differences of running sums, as a frame's bounds must be the same for all rows."""
    rows = W.partitionBy(line).orderBy(order)
    p = df.withColumns({"_i": F.row_number().over(rows).cast("long"), "_n": F.count("*").over(W.partitionBy(line)), "_s": F.sum(v).over(rows.rowsBetween(W.unboundedPreceding, 0))})
    p = through_table(p.withColumn("window", window_size(F.col("_n"), window)), "running-sums")
    h = F.floor(F.col("window") / 2)
    p = p.withColumns({"_to": F.least(F.col("_i") + h, F.col("_n")), "_from": F.greatest(F.col("_i") - h - 1, F.lit(0))})
    at = lambda name: p.select(F.col(line).alias(f"{name}_l"), F.col("_i").alias(f"{name}_i"), F.col("_s").alias(f"{name}_s"))
    a, b = at("_a"), at("_b")
    got = p.join(a, (F.col(line) == F.col("_a_l")) & (F.col("_to") == F.col("_a_i"))).join(b, (F.col(line) == F.col("_b_l")) & (F.col("_from") == F.col("_b_i")), "left")
    smooth = (F.col("_a_s") - F.coalesce("_b_s", F.lit(0))).cast("double") / (F.col("_to") - F.col("_from"))
    return got.select(*df.columns, "window", smooth.alias("smooth"))


def trend_offset(df: DataFrame, a: str, b: str, by: list[str] | None = None, step: float = 0.01) -> DataFrame:
    """The offset of the scan from min(b - a) - 5 by steps that makes a + offset closest
    to b, and the remaining rmse. The mean difference is the optimum and the error a
    parabola, so that the scan's step next to the mean is found without a scan."""
    d = (F.col(b) - F.col(a)).alias("d")
    s = df.select(*(by or []), d).groupBy(*(by or [])).agg(F.min("d").cast("double").alias("lo"), (F.sum("d").cast("double") / F.count("d")).alias("m"), (F.sum(F.col("d") * F.col("d")).cast("double") / F.count("d")).alias("q"), F.count("d").alias("n"))
    start = F.col("lo") - 5.0
    k = F.floor((F.col("m") - start) / step + 0.5)
    s = s.withColumn("offset", start + k * step)
    return s.select(*(by or []), "offset", F.sqrt(F.greatest(F.col("q") - 2 * F.col("offset") * F.col("m") + F.col("offset") * F.col("offset"), F.lit(0.0))).alias("rmse"), "n")


def path_json(df: DataFrame, line: str = "line_id", order: str = "seq", *cols: str) -> DataFrame:
    """(line, path): each line's points in order, as a JSON text; for lines thinned to be
    drawn, as one line becomes one text."""
    point = F.struct(order, *(cols or [c for c in df.columns if c not in (line, order)]))
    return df.groupBy(line).agg(F.to_json(F.struct(F.sort_array(F.collect_list(point)).alias("path"))).alias("path"))

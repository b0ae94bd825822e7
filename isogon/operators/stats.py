"""Aggregations. Sums of decimals are exact, so that results don't depend on the
order of rows; they become doubles at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import checkpointed


def mean(c: Column) -> Column:
    return F.sum(c).cast("double") / F.count(c)


def rms(c: Column) -> Column:
    return F.sqrt(F.sum(c * c).cast("double") / F.count(c))


def sigma(c: Column) -> Column:
    """Population standard deviation from two exact sums."""
    m = mean(c)
    return F.sqrt(F.greatest(F.sum(c * c).cast("double") / F.count(c) - m * m, F.lit(0.0)))


def summary(df: DataFrame, v: str = "v", compat: bool = False, by: list[str] | None = None) -> DataFrame:
    """max, min, mean, spread. compat: the spread is twice the root mean square, as the
    values' own sums enter it; else the population standard deviation."""
    c = F.col(v)
    return df.groupBy(*(by or [])).agg(F.max(c).alias("max"), F.min(c).alias("min"), mean(c).alias("mean"), (2 * rms(c) if compat else sigma(c)).alias("spread"), F.count(c).alias("n"))


def centroid(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in cols])


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def rmse(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Root mean square difference and count; -1 for no rows."""
    d = F.col(a) - F.col(b)
    sums = df.groupBy(*(by or [])).agg(F.sum(d * d).cast("double").alias("s"), F.count(d).alias("n"))
    return sums.select(*(by or []), F.when(F.col("n") > 0, F.sqrt(F.col("s") / F.col("n"))).otherwise(-1.0).alias("rmse"), "n")


def weighted_rmse(per_line: DataFrame) -> DataFrame:
    """Over lines with rmse and n, weighted by points."""
    return per_line.agg(F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * F.col("n")) / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))


def _ranged(df: DataFrame, c: str) -> DataFrame:
    """df dealt to tasks by ranges of c, with the range's number in _p, ascending."""
    return checkpointed(df.repartitionByRange(F.col(c)).withColumn("_p", F.spark_partition_id()))


def nearest_rank(df: DataFrame, fractions: list[float], v: str = "v", by: list[str] | None = None) -> DataFrame:
    """Percentiles that are values of the table: of n sorted values the one at
    floor(n p). By group; one whole table is sorted by counting its distinct values
    first, in ranges, and the counts of earlier ranges are added, so that no task gets
    all of them."""
    by = by or []
    counts = df.where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("k"))
    if by:
        ranked = counts.withColumn("_to", F.sum("k").over(W.partitionBy(*by).orderBy(v))).withColumn("_n", F.sum("k").over(W.partitionBy(*by)))
    else:
        counts = _ranged(counts, v)
        parts = counts.groupBy("_p").agg(F.sum("k").alias("_k"))  # a row for each range
        parts = parts.select("_p", (F.sum("_k").over(W.orderBy("_p")) - F.col("_k")).alias("_base"), F.sum("_k").over(W.partitionBy()).alias("_n"))
        ranked = counts.withColumn("_in", F.sum("k").over(W.partitionBy("_p").orderBy(v))).join(F.broadcast(parts), "_p").withColumn("_to", F.col("_base") + F.col("_in"))
    at = lambda p: F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1)
    picks = [F.max(F.when((F.col("_to") > at(p)) & (F.col("_to") - F.col("k") <= at(p)), F.col(v))).alias(f"p{round(p * 100)}") for p in fractions]
    return ranked.groupBy(*by).agg(*picks)


def robust_bounds(df: DataFrame, v: str = "v", limit: float = 1000.0, width: float = 5.0, fallback: float = 300.0) -> DataFrame:
    """Upper median and 1.4826 MAD of the values below limit, and the bounds at width
    MADs; +- fallback where there are none."""
    inside = df.where(F.abs(v) < limit).select(F.col(v).cast("double").alias("v"))
    med = nearest_rank(inside, [0.5]).withColumnRenamed("p50", "median")
    dev = inside.join(F.broadcast(med)).select(F.abs(F.col("v") - F.col("median")).alias("d"))
    mad = nearest_rank(dev, [0.5], "d").select((F.col("p50") * 1.4826).alias("mad"))
    out = med.join(F.broadcast(mad))
    return out.select("median", "mad", F.coalesce(F.col("median") - width * F.col("mad"), F.lit(-fallback)).alias("low"), F.coalesce(F.col("median") + width * F.col("mad"), F.lit(fallback)).alias("high"))


def gaps(df: DataFrame, c: str) -> DataFrame:
    """(gap) between neighbouring distinct values: inside ranges of values, and from each
    range to the next."""
    d = _ranged(df.select(c).where(F.col(c).isNotNull()).distinct(), c)
    inside = d.select((F.col(c) - F.lag(c).over(W.partitionBy("_p").orderBy(c))).alias("gap"))
    ends = d.groupBy("_p").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))  # a row for each range
    between = ends.select((F.col("lo") - F.lag("hi").over(W.orderBy("_p"))).alias("gap"))
    return inside.unionAll(between).where("gap is not null")


def least_spacing(df: DataFrame, c: str) -> DataFrame:
    """The least positive distance of neighbouring distinct values."""
    return gaps(df, c).agg(F.min("gap").alias("spacing"))


def median_spacing(df: DataFrame, c: str, eps: float = 1e-9) -> DataFrame:
    return nearest_rank(gaps(df, c).where(F.col("gap") > eps), [0.5], "gap").withColumnRenamed("p50", "spacing")


def is_regular(df: DataFrame, x: str = "x", y: str = "y", tolerance: float = 0.1) -> DataFrame:
    """Whether distinct x times distinct y is the number of rows, within tolerance."""
    c = df.agg(F.count_distinct(x).alias("nx"), F.count_distinct(y).alias("ny"), F.count("*").alias("n"))
    return c.select("nx", "ny", "n", (F.abs(F.col("nx") * F.col("ny") - F.col("n")) <= tolerance * F.col("n")).alias("regular"))


def contour_levels(df: DataFrame, k: int = 10, v: str = "v") -> DataFrame:
    """k levels evenly between the least and the greatest value."""
    e = df.agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")).where("lo is not null")
    return e.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k)))).select("i", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (k + 1)).alias("level"))


def scatter(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, sums and products of cols in one row: partial sums, then one."""
    out = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols]]
    out += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return df.agg(*out)


def difference_report(df: DataFrame, a: str, b: str, compat: bool = False) -> DataFrame:
    """(part, max, min, mean, spread, n): summary() of a, of b and of a - b."""
    parts = F.array(*[F.struct(F.lit(n).alias("part"), c.cast("double").alias("v")) for n, c in (("a", F.col(a)), ("b", F.col(b)), ("a - b", F.col(a) - F.col(b)))])
    return summary(df.select(F.explode(parts).alias("p")).select("p.*"), "v", compat, ["part"])

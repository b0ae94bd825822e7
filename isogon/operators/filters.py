"""Predicates and samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.functions import geo


def in_box(df: DataFrame, x0: float, x1: float, y0: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """Inclusive on all sides; reaches the scan."""
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def catalogue(df: DataFrame, datatypes: list[str] | None = None, platforms: list[str] | None = None, name: str | None = None, path: str | None = None, x: tuple | None = None, y: tuple | None = None, time: tuple | None = None) -> DataFrame:
    """Catalogue filter; each condition given must hold. Ranges look at the upper bounds."""
    if datatypes:
        df = df.where(F.col("datatype").isin(datatypes))
    if platforms:
        df = df.where(F.col("platform").isin(platforms))
    if name:
        df = df.where(F.col("name").contains(name))
    if path:
        df = df.where(F.col("path").contains(path))
    for col, span in (("max_x", x), ("max_y", y), ("time", time)):
        if span:
            df = df.where(F.col(col).between(*span))
    return df


def on_lines(y: Column, n: int, tolerant: bool = False) -> Column:
    """Rows on every n-th tenth of y, truncated toward zero as integers are."""
    if n <= 0:
        return F.lit(False)
    hit = (10 * y + 0.1).cast("int") % n < 1
    return hit | ((10 * y - 0.1).cast("int") % n < 1) if tolerant else hit


def random_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """An exact count of one n-th of the rows, without replacement: those of the least
    hashes. The hashes' upper 16 bits are counted; all rows below the bits where the count
    is reached are taken, and only rows with just these bits are sorted."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    high = F.shiftright(h, 48)
    counts = df.groupBy(high.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 65,536 rows at most
    left = sum(r.n for r in counts) // n
    for r in counts:
        if r.n > left:
            return df.where(high < r.b).unionAll(df.where(high == r.b).orderBy(h, key).limit(left))
        left -= r.n
    return df


def every_nth(df: DataFrame, n: int, order: str, group: list[str]) -> DataFrame:
    """By ordinal within each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(order)) - 1).where(F.col("_n") % n == 0).drop("_n")


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray towards -x; the boundary is inside; an edge counts at its upper end. The
    ring must be closed by its first point; it is a literal, so there is no join."""
    on, crossings = F.lit(False), F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on = on | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when((y > min(y1, y2)) & (y <= max(y1, y2)) & (at < x), 1).otherwise(0)
    return on | (crossings % 2 == 1)


def unwrap_antimeridian(df: DataFrame, ring: str, order: str, lon: str = "lon") -> DataFrame:
    """Adds 360 to negative longitudes of a ring any edge of which spans over 180."""
    step = F.abs(F.col(lon) - F.lag(lon).over(W.partitionBy(ring).orderBy(order)))
    wide = F.max(F.coalesce(F.col("_step") > 180, F.lit(False))).over(W.partitionBy(ring))
    turned = F.when(wide & (F.col(lon) < 0), F.col(lon) + 360).otherwise(F.col(lon))
    return df.withColumn("_step", step).withColumn(lon, turned).drop("_step")


def valid_position(lat: Column, lon: Column, height: Column | None = None) -> Column:
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    if height is not None:
        ok = ok & height.between(-9999.9999, 9999.9999)
    return F.coalesce(ok, F.lit(False))


def valid_entry(lat: Column, lon: Column, height: Column, begin: Column, end: Column, step: Column, year: Column, month: Column, day: Column) -> Column:
    """Position, height, step and date of a query as entered, all valid."""
    return valid_position(lat, lon, height) & geo.valid_step(begin, end, step) & geo.valid_date(year, month, day)

"""Grids: generators, binning, neighbourhoods and contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import checkpointed
from isogon.operators.filters import in_box, in_polygon
from isogon.operators.stats import sigma


def lattice(spark: SparkSession, **axes: tuple[float, float, float]) -> DataFrame:
    """Points of a lattice: for each axis (begin, end, step), int((end - begin) / step)
    values from begin, the end left out. The first axis is a distributed range, the
    others are sequences of it."""
    (name, (a, b, s)), *rest = axes.items()
    df = spark.range(max(0, int((b - a) / s))).select((F.lit(a) + F.col("id") * F.lit(s)).alias(name))
    for name, (a, b, s) in rest:
        n = int((b - a) / s)
        if n <= 0:
            return df.limit(0).withColumn(name, F.lit(0.0))
        df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(name, F.lit(a) + F.col("_k") * F.lit(s)).drop("_k")
    return df


def grid_over(df: DataFrame, dx: float, dy: float, x: str = "x", y: str = "y") -> DataFrame:
    """Nodes from the least x and y, int(extent / step) + 1 along each: (row, col, x, y)."""
    e = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    e = e.where("x0 is not null").withColumn("nx", ((F.col("x1") - F.col("x0")) / dx).cast("int")).withColumn("ny", ((F.col("y1") - F.col("y0")) / dy).cast("int"))
    e = e.withColumn("row", F.explode(F.expr("sequence(0, ny)"))).withColumn("col", F.explode(F.expr("sequence(0, nx)")))
    return e.select("row", "col", (F.col("x0") + F.col("col") * dx).alias("x"), (F.col("y0") + F.col("row") * dy).alias("y"))


def bin_mean(df: DataFrame, size: float, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(row, col, mean, n) of the cells with data; a cell is the truncated offset."""
    e = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    at = df.join(F.broadcast(e)).select(((F.col(y) - F.col("y0")) / size).cast("int").alias("row"), ((F.col(x) - F.col("x0")) / size).cast("int").alias("col"), F.col(v).alias("v"))
    return at.groupBy("row", "col").agg((F.sum("v").cast("double") / F.count("v")).alias("mean"), F.count("v").alias("n"))


def nearest_cell(df: DataFrame, dx: float, dy: float, x: str = "x", y: str = "y", v: str = "v", order: str = "id") -> DataFrame:
    """(row, col, value): points put on the nearest cell, of several the last by order."""
    e = df.agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    at = df.join(F.broadcast(e)).select(F.round((F.col(y) - F.col("y0")) / dy).cast("int").alias("row"), F.round((F.col(x) - F.col("x0")) / dx).cast("int").alias("col"), F.col(v).alias("v"), F.col(order).alias("o"))
    return at.groupBy("row", "col").agg(F.max_by("v", "o").alias("value"))


def gradients(grid: DataFrame, v: str = "mean") -> DataFrame:
    """(row, col, mean, e, n, ne, se): weighted differences over the 3 x 3 around a
    cell, null where not all nine have data. Every cell sends itself to its nine
    neighbours and they sum up: one aggregation, no self-join."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    sent = grid.select("row", "col", F.col(v).alias("v"), F.explode(offsets).alias("o"))
    # a value from offset (-r, -c) of the target
    weight = lambda along, across: -F.col(f"o.{along}") * F.when(F.col(f"o.{across}") == 0, 2).otherwise(1)
    got = sent.select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "v", (F.col("v") * weight("c", "r")).alias("we"), (F.col("v") * weight("r", "c")).alias("wn"), F.when((F.col("o.r") == 0) & (F.col("o.c") == 0), F.col("v")).alias("own"))
    out = got.groupBy("row", "col").agg(F.count("v").alias("n9"), F.sum("we").alias("we"), F.sum("wn").alias("wn"), F.max("own").alias("mean")).where("mean is not null")
    full = F.col("n9") == 9
    out = out.select("row", "col", "mean", F.when(full, F.col("we") / 8).alias("e"), F.when(full, F.col("wn") / 8).alias("n"))
    return out.withColumn("ne", (F.col("n") + F.col("e")) / 2**0.5).withColumn("se", (F.col("n") - F.col("e")) / 2**0.5)


def framed_sum(c: str, by: str, order: str, lo: int, hi: int) -> Column:
    """The sum of c over the rows of `by` whose order is from lo to hi away: the difference of
    two sums that only grow, so that a wide frame costs no more than a narrow one."""
    w = W.partitionBy(by).orderBy(order)
    return F.sum(c).over(w.rangeBetween(W.unboundedPreceding, hi)) - F.coalesce(F.sum(c).over(w.rangeBetween(W.unboundedPreceding, lo - 1)), F.lit(0.0))


def box_sums(grid: DataFrame, radius: int, *cols: str) -> DataFrame:
    """Sums of cols over the square of 2 radius + 1 cells, first along rows and then along
    columns; needs every cell of interest to have a row."""
    grid = grid.withColumns({c: framed_sum(c, "row", "col", -radius, radius) for c in cols})
    return grid.withColumns({c: framed_sum(c, "col", "row", -radius, radius) for c in cols})


def contours(grid: DataFrame, levels: list[float], v: str = "mean") -> DataFrame:
    """Polylines of marching squares, (level, row, col, points): in the square from (row, col)
    to the next row and column the places where its edges cross the level, in the order of
    the first row, the next column, the next row, the first column: two, or four at a
    saddle, by linear interpolation. A corner at the level counts as below. Corners come by
    shifting, not by a self-join."""
    corners = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    sent = grid.select("row", "col", F.col(v).cast("double").alias("v"), F.explode(corners).alias("o"))
    sq = sent.groupBy((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col")).agg(*[F.max(F.when((F.col("o.r") == r) & (F.col("o.c") == c), F.col("v"))).alias(f"c{r}{c}") for r in (0, 1) for c in (0, 1)])
    sq = sq.where("c00 is not null and c01 is not null and c10 is not null and c11 is not null")
    sq = sq.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    at = lambda a, b: F.when((F.col(a) <= F.col("level")) != (F.col(b) <= F.col("level")), (F.col("level") - F.col(a)) / (F.col(b) - F.col(a)))
    edges = {"bottom": at("c00", "c01"), "right": at("c01", "c11"), "top": at("c10", "c11"), "left": at("c00", "c10")}
    sq = sq.withColumns(edges)
    points = F.array_compact(F.array(
        F.when(F.col("bottom").isNotNull(), F.struct((F.col("col") + F.col("bottom")).alias("x"), F.col("row").cast("double").alias("y"))),
        F.when(F.col("right").isNotNull(), F.struct((F.col("col") + 1.0).alias("x"), (F.col("row") + F.col("right")).alias("y"))),
        F.when(F.col("top").isNotNull(), F.struct((F.col("col") + F.col("top")).alias("x"), (F.col("row") + 1.0).alias("y"))),
        F.when(F.col("left").isNotNull(), F.struct(F.col("col").cast("double").alias("x"), (F.col("row") + F.col("left")).alias("y"))),
    ))
    return sq.withColumn("points", points).where(F.size("points") >= 2).select("level", "row", "col", "points")


def rounded_grid(df: DataFrame, step: float, x: str = "x", y: str = "y") -> DataFrame:
    """Nodes (row, col, x, y) over the extent of coordinates rounded to a tenth (halves away
    from 0), from the least by whole steps as far as the greatest."""
    tenth = lambda c: F.signum(c) * F.floor(F.abs(c) * 10 + 0.5) / 10
    e = df.agg(*[f(tenth(F.col(c))).alias(f"{k}{n}") for c, n in ((x, "x"), (y, "y")) for f, k in ((F.min, "lo"), (F.max, "hi"))]).where("lox is not null")
    count = lambda n: F.floor((F.col(f"hi{n}") - F.col(f"lo{n}")) / step + 1e-9)
    e = e.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), count("x")))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), count("y"))))
    return e.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (F.col("lox") + F.col("col") * step).alias("x"), (F.col("loy") + F.col("row") * step).alias("y"))


def fusion_grid(spark: SparkSession, b: tuple[float, float], l: tuple[float, float], db: float, dl: float, centred: bool = True) -> DataFrame:  # noqa: E741
    """Nodes (row, col, b, l) that cover b and l: by steps out of their centre, or out of the
    origin; beyond the outer bounds by up to one step, and one more row and column after."""
    def axis(span: tuple[float, float], step: float) -> tuple[float, int]:
        lo, hi = span
        down, up = ((lo + hi) / 2 - step, (lo + hi) / 2 + step) if centred else (step, step)
        n1, n2 = max(0, -int((lo - down) // step)), max(0, -int((up - hi) // step))
        return down - n1 * step, n1 + n2 + 3

    (b0, rows), (l0, cols) = axis(b, db), axis(l, dl)
    nodes = spark.range(rows).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return nodes.select("row", "col", (F.lit(b0) + F.col("row") * F.lit(db)).alias("b"), (F.lit(l0) + F.col("col") * F.lit(dl)).alias("l"))


def block_bounds(rows: int, cols: int, row_blocks: int, col_blocks: int, row_overlap: int, col_overlap: int) -> list[tuple[int, int, int, int, int, int]]:
    """(bi, bj, row from, row to, col from, col to), both ends included: blocks of a dense grid
    that overlap, kept within it; the last reaches the end. Sizes divide in whole numbers."""
    def cuts(n: int, blocks: int, overlap: int) -> list[tuple[int, int]]:
        size, last = (n + (blocks - 1) * overlap) // blocks, n - 1
        keep = lambda v: min(max(v, 0), last)
        return [(keep(i * (size - overlap)), last if i == blocks - 1 else keep(i * (size - overlap) + size - 1)) for i in range(blocks)]

    return [(i, j, *r, *c) for i, r in enumerate(cuts(rows, row_blocks, row_overlap)) for j, c in enumerate(cuts(cols, col_blocks, col_overlap))]


def overlap_blocks(grid: DataFrame, bounds: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """grid (row, col, ...) with bi, bj, a row for each block that holds the cell."""
    hits = F.filter(F.array(*[F.when(F.col("row").between(r0, r1) & F.col("col").between(c0, c1), F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj"))) for i, j, r0, r1, c0, c1 in bounds]), lambda b: b.isNotNull())
    return grid.withColumn("_b", F.explode(hits)).select(*grid.columns, "_b.bi", "_b.bj")


def block_nodes(blocks: DataFrame, step: float = 0.5) -> DataFrame:
    """(bi, bj, x, y): output nodes of each block, from its least x and y put on a multiple of
    the step, as far as its greatest, rounded to whole steps."""
    e = blocks.groupBy("bi", "bj").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    near = lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)
    e = e.withColumns({"x0": near(F.col("x0") / step) * step, "y0": near(F.col("y0") / step) * step})
    for k in "xy":
        e = e.withColumn(f"_{k}", F.explode(F.sequence(F.lit(0).cast("long"), near((F.col(f"{k}1") - F.col(f"{k}0")) / step).cast("long"))))
    return e.select("bi", "bj", (F.col("x0") + F.col("_x") * step).alias("x"), (F.col("y0") + F.col("_y") * step).alias("y"))


def to_block(points: DataFrame, rows: int, cols: int, order: str = "id", v: str = "v") -> DataFrame:
    """(row, col, v): points in their order laid out row by row in a dense block; cells
    without a point hold 0, points beyond it go. order counts from 0."""
    at = points.where(F.col(order).between(0, rows * cols - 1)).select(F.floor(F.col(order) / cols).cast("int").alias("row"), (F.col(order) % cols).cast("int").alias("col"), F.col(v).cast("double").alias("v"))
    cells = points.sparkSession.range(rows).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return cells.join(at, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def gradient_spread(g: DataFrame) -> DataFrame:
    """(row, col, spread): over the 3 x 3 around a cell with gradients, the population standard
    deviations of the four gradients, summed. Every cell sends itself to its neighbours."""
    g = g.where("e IS NOT NULL")
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    s = g.withColumn("o", F.explode(offsets)).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), "e", "n", "ne", "se", ((F.col("o.r") == 0) & (F.col("o.c") == 0)).alias("own"))
    total = F.stddev_pop("e") + F.stddev_pop("n") + F.stddev_pop("ne") + F.stddev_pop("se")
    return s.groupBy("row", "col").agg(total.alias("spread"), F.max("own").alias("own")).where("own").select("row", "col", "spread")


def block_sigma(points: DataFrame, size: float, step: float, x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """(bi, bj, sigma, n) of squares of a size that begin at each multiple of step: they
    overlap where the step is less than the size."""
    reach = int(size / step + 1 - 1e-9)
    back = F.array(*[F.lit(i).cast("long") for i in range(reach)])
    p = points.withColumn("_i", F.explode(back)).withColumn("_j", F.explode(back)).withColumns({"bi": F.floor(F.col(x) / step) - F.col("_i"), "bj": F.floor(F.col(y) / step) - F.col("_j")})
    p = p.where((F.col(x) < F.col("bi") * step + size) & (F.col(y) < F.col("bj") * step + size))
    return p.groupBy("bi", "bj").agg(sigma(F.col(v)).alias("sigma"), F.count(v).alias("n"))


def _cells_of(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every cell of the grid's extent, those without a row)."""
    e = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).where("r0 is not null")
    cells = e.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1"))).select("row", "col")
    return cells, cells.join(grid.select("row", "col"), ["row", "col"], "left_anti")


def _shared(grid: DataFrame, radius: int) -> DataFrame:
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("mean").alias("_v")).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select((F.col("_r") + F.col("_i")).alias("row"), (F.col("_c") + F.col("_j")).alias("col"), "_v", F.greatest(F.abs("_i"), F.abs("_j")).alias("_d"))


def fill_near(grid: DataFrame, most: int = 5, enough: int = 4) -> DataFrame:
    """grid (row, col, mean) with its holes filled once: a hole looks at squares about it of
    growing radius, adding up what each holds, until it has `enough` values or `most` is
    reached, and takes their mean; cells of an inner square count again in the outer ones.
    A hole without any stays one."""
    grid = grid.select("row", "col", F.col("mean").cast("double").alias("mean"))
    _, holes = _cells_of(grid)
    near = _shared(grid, most).join(holes, ["row", "col"])
    rings = near.groupBy("row", "col").agg(*[f for d in range(1, most + 1) for f in (F.sum(F.when(F.col("_d") <= d, F.col("_v"))).alias(f"s{d}"), F.count(F.when(F.col("_d") <= d, F.col("_v"))).alias(f"n{d}"))])
    s, n, value = F.lit(0.0), F.lit(0), F.lit(None).cast("double")
    for d in range(1, most + 1):
        s, n = s + F.coalesce(F.col(f"s{d}"), F.lit(0.0)), n + F.col(f"n{d}")
        stop = (n >= enough) if d < most else (n > 0)
        value = F.coalesce(value, F.when(stop, s / n))
    return grid.unionByName(rings.select("row", "col", value.alias("mean")))


def fill_holes(grid: DataFrame, rounds: int = 1000) -> DataFrame:
    """grid (row, col, mean) with every hole of its extent filled, from the rims inwards: in a
    round each hole with a filled neighbour takes the mean of those of its eight that
    were filled before the round."""
    grid = checkpointed(grid.select("row", "col", F.col("mean").cast("double").alias("mean")))
    for _ in range(rounds):
        _, holes = _cells_of(grid)
        new = checkpointed(_shared(grid, 1).join(holes, ["row", "col"]).groupBy("row", "col").agg(F.avg("_v").alias("mean")))
        if new.isEmpty():
            break
        grid = checkpointed(grid.unionByName(new))
    return grid


def simple_gradients(grid: DataFrame, size: float) -> DataFrame:
    """(row, col, mean, e, n, ne, se, spread) of a grid without holes: central differences, one-
    sided at the rims; ne to the row before and se to the row after, in the next column;
    spread is the deviation of the four amounts. What has no neighbour is 0."""
    spots = {"l": (0, -1), "r": (0, 1), "u": (-1, 0), "d": (1, 0), "ur": (-1, 1), "dr": (1, 1)}
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, (r, c) in {"own": (0, 0), **spots}.items()])
    sent = grid.select("row", "col", F.col("mean").alias("v"), F.explode(offsets).alias("o"))
    got = sent.groupBy((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col")).agg(*[F.max(F.when(F.col("o.k") == k, F.col("v"))).alias(k) for k in ("own", *spots)]).where("own is not null")
    two = lambda a, b: F.coalesce((F.col(b) - F.col(a)) / (2 * size), (F.col("own") - F.col(a)) / size, (F.col(b) - F.col("own")) / size, F.lit(0.0))
    one = lambda a: F.coalesce((F.col(a) - F.col("own")) / (2**0.5 * size), F.lit(0.0))
    g = got.select("row", "col", F.col("own").alias("mean"), two("l", "r").alias("e"), two("u", "d").alias("n"), one("ur").alias("ne"), one("dr").alias("se"))
    four = [F.abs(c) for c in ("e", "n", "ne", "se")]
    m = (four[0] + four[1] + four[2] + four[3]) / 4
    return g.withColumn("spread", F.sqrt(sum(((c - m) * (c - m) for c in four), F.lit(0.0)) / 4))


def polygon_cells(points: DataFrame, ring: list[tuple[float, float]], size: float, x: str = "x", y: str = "y", v: str = "v", none: float = -99999.9) -> DataFrame:
    """(c, r, total, n) of the cells of a size with valid points inside a closed ring: the
    ring's box reaches the scan, then the ring."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    p = in_box(points, min(xs), max(xs), min(ys), max(ys), x, y).where((F.col(v) >= none) & in_polygon(F.col(x), F.col(y), ring))
    return p.groupBy(F.floor(F.col(x) / size).alias("c"), F.floor(F.col(y) / size).alias("r")).agg(F.sum(v).cast("double").alias("total"), F.count(v).alias("n"))

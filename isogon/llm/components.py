"""Connected components of an edge table, as a distributed star contraction, and a join
of many rows with a table that has one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import checkpointed


def _sum(df: DataFrame):
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, most: int = 1024) -> DataFrame:
    """rows with the columns of table but n; table has one row for each value of key, and in
    column n how many of rows have it. Values with over one `most`-th of all rows are
    `most` at most: their rows of table are broadcast, so that no task gets them all."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * most > total).drop(n)
    cold = table.where(F.col(n) * most <= total).drop(n)
    common = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return common.unionByName(others)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (id, root) for every vertex that has an edge; root is the smallest id
    that can be reached. Alternates large-star and small-star steps. Each is a
    grouped minimum (combined before the shuffle) joined back to the edges, so no
    neighbour list is ever gathered. Self-loops and null ends are ignored; an
    empty table gives an empty table. Ids are long."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = checkpointed(e)
    state = _sum(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: neighbours above u go to the least of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: u and its neighbours below go to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u > v").distinct())
        was, state = state, _sum(e)
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())

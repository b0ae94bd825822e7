"""Sharding by a two-pass external shuffle.

Law `key`: a row's shard is the one whose seeded hash with the row's id is the
highest of all shards, so that id and shard count decide, and one more shard takes
rows only into itself. Pass one scatters a shard's rows uniformly, by another seeded
hash, into buckets of at most about bucket_bytes. Pass two loads a bucket, puts it
in an order that depends on its rows only, shuffles it after Fisher and Yates with
a generator seeded by shard and bucket, and writes it. A row's slot is its place in
its shard, buckets in turn.

A null text has no bytes. Null ids count as one id for the shard. Buckets are dealt
by id and text, so that copies under many ids spread; rows equal in both share a
bucket and are interchangeable. Extra columns are kept in the files; where docs has
one of the names _shard, _bucket and _place, the added column has underscores after it
(`added()` tells the names). Buckets grow beyond bucket_bytes where there would be more
than `most` of them, so that the number of tasks stays bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isogon.cluster import free, scratch, ship


def highest(key: Column, shards: int, seed: int) -> Column:
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"))))
    return best["i"].cast("int")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly drawn order of range(n)."""
    order = list(range(n))
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def added(columns: list[str]) -> tuple[str, str, str]:
    """The names of the columns that write() adds: shard, bucket, place in the bucket."""
    out: list[str] = []
    for name in ("_shard", "_bucket", "_place"):
        out.append(free(name, [*columns, *out]))
    return tuple(out)


def write(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20, seed: int = 11, most: int = 200_000) -> DataFrame:
    """Writes docs below path, partitioned by shard, and returns them as read back,
    with the columns of added()."""
    spark = docs.sparkSession
    ship(spark)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    per = max(1, min(-(-total // (shards * bucket_bytes)), most // shards))
    at_shard, at_bucket, at_place = added(docs.columns)
    shard = highest(F.col(id_col), shards, seed)
    bucket = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed + 1)), F.lit(per)).cast("int")
    rows = docs.withColumns({at_shard: shard, at_bucket: bucket})
    dealt = rows.repartitionById(shards * per, F.col(at_shard) * per + F.col(at_bucket))

    def shuffle(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        keys = table.select([at_shard, at_bucket])
        groups = keys.group_by([at_shard, at_bucket]).aggregate([]).sort_by([(at_shard, "ascending"), (at_bucket, "ascending")])
        for s, b in zip(groups.column(at_shard).to_pylist(), groups.column(at_bucket).to_pylist(), strict=True):
            import pyarrow.compute as pc

            mine = table.filter(pc.and_(pc.equal(table.column(at_shard), s), pc.equal(table.column(at_bucket), b))) if groups.num_rows > 1 else table
            mine = mine.take(pc.sort_indices(mine.select([id_col, text_col]).rename_columns(["a", "b"]), [("a", "ascending"), ("b", "ascending")]))
            order = fisher_yates(mine.num_rows, np.random.default_rng([seed, s, b]))
            mine = mine.take(pa.array(order)).append_column(at_place, pa.array(np.arange(mine.num_rows, dtype=np.int64)))
            yield from mine.to_batches(max_chunksize=2048)

    schema = T.StructType([*dealt.schema.fields, T.StructField(at_place, T.LongType())])
    dealt.mapInArrow(shuffle, schema).write.partitionBy(at_shard).parquet(path)
    return spark.read.schema(schema).parquet(path)


def slots(written: DataFrame, names: tuple[str, str, str] = ("_shard", "_bucket", "_place"), slot: str = "slot") -> DataFrame:
    """written with slot: gapless from 0 in each shard. The windows run over one row
    for each bucket. names: the columns of added()."""
    shard, bucket, place = names
    n = free("_before", written.columns)
    sizes = written.groupBy(shard, bucket).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(W.partitionBy(shard).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return written.join(sizes.select(shard, bucket, before.alias(n)), [shard, bucket]).withColumn(slot, F.col(n) + F.col(place)).drop(n)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seed = 11
    out = slots(write(docs.select("doc_id", "text", "lang", "source", "n_chars"), scratch(spark, "op3"), 8, seed=seed).withColumns({
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
    }).drop("text", "lang", "source", "n_chars"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_shard").alias("shard"), "slot", highest(F.col("doc_id"), 9, seed).alias("grown_shard"))

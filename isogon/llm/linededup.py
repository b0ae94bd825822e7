"""Line dedup by content-defined chunks of lines.

A text is cut after a line where a rolling hash over the hashes of the last
`window` lines is divisible by `divisor`: boundaries depend on the lines around
them only, so that they are found again where a passage has moved. Of chunks of
`least` lines or more that occur more than once in all documents the first
occurrence (by id, then hash of id and text, then place) stays; an occurrence
elsewhere is removed if its bytes are those of the first. A chunk that only shares
the hash stays.

Chunks alone miss short repeats that lie across a cut, chunks of one line and the ends
of longer repeats. With `runs` every pair of adjacent lines is looked up as well, in the
same two passes and again with its bytes: lines go that belong to a pair whose first
occurrence is elsewhere (in one document, does not overlap it). So of every run of two
lines or more that stands earlier as adjacent lines, all lines go. The first
occurrence of a line always stays.

The first pass sends hashes only. The second sends the bytes of chunks whose hash
may repeat; it tells by a bit map of 16 bits for each of these hashes, 2 ** 28 bits
(32 MB) at most, whose false hits cost some traffic and are dropped by the join that
follows. The occurrences of a common chunk are dealt to several tasks, each of which
gets a copy of the first one's row: the first pass has counted them, and of chunks
with over one 2,048th of all occurrences there are 2,048 at most.

A null text stays null; a text that loses all chunks is empty. Rows equal in id and
text are one document: what is first in one is first in all. Null ids sort first.
Extra columns are kept, and so is the order of columns; where docs has a column by the
name of one of the added ones, the added one has underscores after its name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isogon.cluster import free, ship, through_table, tidy

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def chunks(data: bytes, window: int = 2, divisor: int = 2) -> list[list[bytes]]:
    """The lines of data in chunks; all chunks joined by line ends are data."""
    import xxhash

    lines = data.split(b"\n")
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    out, at, roll, drop = [], 0, 0, pow(BASE, window, 1 << 64)
    for i, h in enumerate(hashes):
        roll = (roll * BASE + h - (hashes[i - window] * drop if i >= window else 0)) & MASK
        if i + 1 >= window and (roll ^ roll >> 29) % divisor == 0:
            out.append(lines[at : i + 1])
            at = i + 1
    if at < len(lines):
        out.append(lines[at:])
    return out


def _long_chunks(data, window, divisor, least):
    """(number, hash, bytes) of the chunks that count."""
    import xxhash

    for i, c in enumerate(chunks(data, window, divisor)):
        if len(c) >= least:
            raw = b"\n".join(c)
            h = xxhash.xxh64_intdigest(raw, 1)
            yield i, h - (1 << 64) if h >> 63 else h, raw


def _pairs(data, *_):
    """(number, hash, bytes) of the pairs of adjacent lines."""
    import xxhash

    lines = data.split(b"\n")
    for i in range(len(lines) - 1):
        raw = lines[i] + b"\n" + lines[i + 1]
        h = xxhash.xxh64_intdigest(raw, 2)
        yield i, h - (1 << 64) if h >> 63 else h, raw


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2, least: int = 2, units=_long_chunks, apart: int = 1, deal: int = 20_000) -> DataFrame:
    """(id, sig, numbers): for each document (by id and hash of id and text) that has
    some, the numbers of its chunks (or other units) to remove. In the document of the
    first occurrence these are `apart` or more after it. A task gets about `deal`
    occurrences of one chunk, or one 2,048th of all if that is more."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("sig"), F.col(text_col).cast("binary").alias("t"))
    kind = rows.schema["id"].dataType

    def hashed(batches):
        for b in batches:
            where, no, hs, size = [], [], [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                for i, h, raw in units(t, window, divisor, least):
                    where.append(k)
                    no.append(i)
                    hs.append(h)
                    size.append(len(raw))
            at = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(hs, pa.int64()), pa.array(size, pa.int32())], names=["id", "sig", "no", "h", "size"])

    place = [T.StructField("id", kind), T.StructField("sig", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("h", T.LongType())]
    first = rows.mapInArrow(tidy(hashed), T.StructType([*place, T.StructField("size", T.IntegerType())]))
    known = through_table(first.groupBy("h", "size").agg(F.min(F.struct("id", "sig", "no")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-repeats")
    total, keys = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    deal = max(deal, -(-total // 2048))
    parts = {r["h"]: -(-r["n"] // deal) for r in known.where(F.col("n") > deal).groupBy("h").agg(F.max("n").alias("n")).collect()}  # total / deal <= 2,048 rows
    bits = min(28, max(20, (16 * keys).bit_length()))
    spot = F.pmod(F.col("h"), F.lit(1 << bits)) + 1  # these bit maps count from 1
    maps = known.select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator()
    board = np.zeros(1 << bits >> 3, np.uint8)
    for r in maps:
        at = (r["b"] - 1) * 4096
        board[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(board) - at]
    sent = docs.sparkSession.sparkContext.broadcast((board, parts))  # 2 ** bits / 8 bytes, 2,048 numbers

    def bytes_of(batches):
        (seen, dealt), mask = sent.value, (1 << bits) - 1
        for b in batches:
            where, no, hs, raws, salts = [], [], [], [], []
            sigs = b.column(1).to_pylist()
            for k, t in enumerate(b.column(2).to_pylist()):
                for i, h, raw in units(t, window, divisor, least):
                    spot = h & mask
                    if seen[spot >> 3] >> (spot & 7) & 1:
                        where.append(k)
                        no.append(i)
                        hs.append(h)
                        raws.append(raw)
                        salts.append(((sigs[k] ^ i * BASE) & MASK) % dealt[h] if h in dealt else 0)
            at = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int32()), pa.array(hs, pa.int64()), pa.array(raws, pa.binary()), pa.array(salts, pa.int32())], names=["id", "sig", "no", "h", "raw", "salt"])

    again = rows.mapInArrow(tidy(bytes_of), T.StructType([*place, T.StructField("raw", T.BinaryType()), T.StructField("salt", T.IntegerType())])).withColumn("size", F.octet_length("raw"))
    most = F.max("n").over(W.partitionBy("h")) if parts else F.col("n")  # sizes that share a hash share its parts
    salted = known.withColumn("parts", F.when(most > deal, F.ceil(most / deal)).otherwise(1).cast("int"))
    found = through_table(again.join(salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("n"), ["h", "size", "salt"]), "line-chunks")
    mine = F.struct("id", "sig", "no") == F.col("first")
    home = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sig") == F.col("first.sig"))
    is_first = F.coalesce(mine, home & (F.col("no") == F.col("first.no")))
    overlaps = home & (F.col("no") < F.col("first.no") + apart)
    kept = found.where(is_first).select("h", "size", "parts", F.col("raw").alias("first_raw")).dropDuplicates(["h", "size"])
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    gone = found.where(~is_first & ~overlaps).join(kept, ["h", "size", "salt"]).where("raw = first_raw")
    return gone.groupBy("id", "sig").agg(F.collect_set("no").alias("numbers"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2, least: int = 2, runs: bool = False) -> DataFrame:
    """docs with the repeats taken out of the text, and _chunks, _lines, _removed_chunks
    (all of whose lines went) and _removed_lines."""
    removed = repeats(docs, id_col, text_col, window, divisor, least).withColumn("pairs", F.array().cast("array<int>"))
    if runs:
        pairs = repeats(docs, id_col, text_col, units=_pairs, apart=2).select("id", "sig", F.array().cast("array<int>").alias("numbers"), F.col("numbers").alias("pairs"))
        removed = removed.unionAll(pairs).groupBy("id", "sig").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("numbers", "pairs")))
    names, added = docs.columns, added_names(docs.columns)
    own = [free(c, [*names, *added]) for c in ("_id", "_sig", "_gone", "_s")]
    removed = through_table(removed, "line-removed").select(F.col("id").alias(own[0]), F.col("sig").alias(own[1]), F.struct("numbers", "pairs").alias(own[2]))
    marked = docs.withColumn(own[3], F.xxhash64(id_col, text_col))
    joined = marked.join(removed.hint("merge"), (F.col(own[3]) == F.col(own[1])) & F.col(id_col).eqNullSafe(F.col(own[0])), "left").drop(own[0], own[1], own[3])
    where = names.index(text_col)

    def rebuild(batches):
        for b in batches:
            texts, counts = [], ([], [], [], [])
            for t, gone in zip(b.column(where).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                parts = chunks(t.encode(), window, divisor) if t is not None else []
                ends = np.cumsum([0] + [len(p) for p in parts]).tolist()
                out = {i for n in gone["numbers"] for i in range(ends[n], ends[n + 1])} if gone else set()
                out.update(i + k for i in (gone["pairs"] if gone else ()) for k in (0, 1))
                texts.append(t if not out else b"\n".join(x for i, x in enumerate(x for p in parts for x in p) if i not in out).decode())
                whole = sum(all(i in out for i in range(ends[n], ends[n + 1])) for n in range(len(parts))) if out else 0
                for c, v in zip(counts, (len(parts), ends[-1], whole, len(out)), strict=True):
                    c.append(v)
            cols = [pa.array(texts, pa.string()) if i == where else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int32()) for c in counts)], names=[*names, *added])

    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields), *(T.StructField(c, T.IntegerType()) for c in added)])
    return joined.mapInArrow(tidy(rebuild), schema)


ADDED = ["_chunks", "_lines", "_removed_chunks", "_removed_lines"]


def added_names(columns: list[str]) -> list[str]:
    """The names of the columns that dedup() adds to these."""
    return [free(c, columns) for c in ADDED]


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, runs=True).select("doc_id", "text", *(F.col(c).alias(f"n{c}") for c in ADDED))

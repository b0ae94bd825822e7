"""SimHash near-duplicates through tables of distances to reference fingerprints.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of
`shingle` words (fewer words: the whole sequence), XXH64 with seed 42; a bit is
set if it is set in over half the hashes, repeats counted. No words or null: 0.

Links (at most two differing bits) are found with pivots, for distinct fingerprints.

Candidates: a base fingerprint and 64 references. A reference differs from the base in
some bits of one of eight groups of eight bits; the distance to it, less the distance to
the base, depends on that group only, and the eight of a group tell whether two
fingerprints agree in it. Two fingerprints at distance two differ in two groups at most;
so for each of the 28 choices of two groups left out, fingerprints whose distances agree
for the other six meet. That loses no link. They differ in 16 bits at most, so that
no more than 2 ** 16 distinct fingerprints can meet, whatever the table's size.

Discarding: what meets is sorted by its distance to the first of INDEPENDENT references
drawn at random; only fingerprints whose distances to it differ by two at most are
looked at, pairs are discarded whose distances to any of them differ by more, and the
rest verified bit by bit. Independent references alone can't choose the candidates: two
unlike fingerprints pass one of them in about a third of all cases, and each one more
doubles what a fingerprint must visit or halves what it skips.

What meets gives links that join it, one less than its members at most, no pairs.

Nulls: a null id keeps its row; a component's id is its least id that is not
null. Equal rows stay separate rows. Other columns are dropped."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isogon.cluster import checkpointed, ship, through_table, tidy
from isogon.llm.components import connected_components, spread_join

MAX_BITS = 2
GROUPS, INDEPENDENT = 8, 16


def simhash(data: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text in UTF-8, unsigned."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    h = xxhash.xxh64_intdigest
    parts = [words[i:] for i in range(shingle)]
    hashes = np.fromiter((h(b" ".join(s), 42) for s in zip(*parts, strict=False)), np.uint64, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): one row per document, fp as a signed long."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.fromiter((simhash(x, shingle) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), "id long, fp long").withColumnRenamed("id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(seed: int = 7) -> tuple[int, list[list[int]], list[int]]:
    """The base, the references of each group, and the independent ones."""
    rng = random.Random(seed)
    base, bits = rng.getrandbits(64), list(range(64))
    rng.shuffle(bits)
    per = 64 // GROUPS
    near = [[base ^ sum(1 << b for b in bits[per * g : per * g + k]) for k in range(1, per + 1)] for g in range(GROUPS)]
    return base, near, [rng.getrandbits(64) for _ in range(INDEPENDENT)]


def _distance(a: Column, b: int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(b)).cast("long")))


def _unions(n: int):
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, root


def links_among(fps: np.ndarray, refs: np.ndarray, step: int = 512) -> list[tuple[int, int]]:
    """Links (positions) that join distinct fingerprints within MAX_BITS, one less than
    there are at most."""
    table = np.bitwise_count(fps[:, None] ^ refs[None]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_fps = table[order], fps[order]
    parent, root = _unions(len(fps))
    out = []
    first = table[:, 0].astype(np.int16)
    for a in range(0, len(fps), step):
        z = min(a + step, len(fps))
        end = int(np.searchsorted(first, first[z - 1] + MAX_BITS, side="right"))
        for c in range(a, end, 4 * step):
            d = min(c + 4 * step, end)
            near = np.abs(table[a:z, None, 0] - table[None, c:d, 0]) <= MAX_BITS
            i, j = np.nonzero(near)
            keep = i + a < j + c
            i, j = i[keep] + a, j[keep] + c
            for k in range(1, table.shape[1], 5):
                keep = (np.abs(table[i, k : k + 5] - table[j, k : k + 5]) <= MAX_BITS).all(1)
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(sorted_fps[i] ^ sorted_fps[j]) <= MAX_BITS
            for p, q in zip(order[i[keep]].tolist(), order[j[keep]].tolist(), strict=True):
                r, s = root(p), root(q)
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    out.append((p, q))
    return out


def similar_links(fps: DataFrame, seed: int = 7) -> DataFrame:
    """Links (src, dst) between distinct fingerprints in column fp that join the same
    fingerprints into the same components as all pairs within two bits."""
    ship(fps.sparkSession)
    base, near, independent = references(seed)
    refs = np.array(independent, np.uint64)
    table = fps.select("fp").distinct().withColumn("b", _distance(F.col("fp"), base))
    group = [F.array(*[(_distance(F.col("fp"), r) - F.col("b")).cast("byte") for r in g]) for g in near]
    table = table.select("fp", *[F.xxhash64(d).alias(f"g{i}") for i, d in enumerate(group)])
    left_out = [(a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
    keys = F.array(*[F.xxhash64(F.lit(n), *[F.col(f"g{i}") for i in range(GROUPS) if i not in pair]) for n, pair in enumerate(left_out)])
    met = table.select("fp", F.explode(keys).alias("key"))

    def run(batches):
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(key, fp):
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            src, dst = [], []
            for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                for p, q in links_among(fp[a:z].view(np.uint64), refs):
                    src.append(fp[a + p])
                    dst.append(fp[a + q])
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for b in batches:
            key, fp = (np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate((rest_key, rest_fp)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                yield linked(key[:last], fp[:last])
            rest_key, rest_fp = key[last:], fp[last:]
        if len(rest_key):
            yield linked(rest_key, rest_fp)

    return met.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(run), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp, component_id): one row per document."""
    rows = through_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = connected_components(similar_links(least)).withColumnsRenamed({"id": "fp"})
    member = checkpointed(least.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    best = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(rows, member.join(best, "root").select("fp", "component_id", "n"), "fp", "n").select(id_col, "fp", "component_id")


def op8(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

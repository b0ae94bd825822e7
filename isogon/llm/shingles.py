"""Near-duplicates by Jaccard similarity of word shingles, for the pipeline.

Sets: lower-case A-Z, words between ASCII white space, 64-bit hashes of `shingle`
words (fewer words: the whole sequence, none: the empty set). Two texts are linked
if the sets' Jaccard similarity is `least` or more; two empty sets have 1.

Candidates come from two searches, and every one is verified on the sets:

* SimHash fingerprints within two bits (`isogon.llm.simhash`), which finds hardly
  any text with edits: at a similarity of 0.8 fingerprints of 64 bits differ in about
  ten bits, a radius at which pivots and key groups prune nothing.
* MinHash bands: BANDS keys of ROWS minima each. A pair at similarity s has a key in
  common with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9998 at 0.8.

A key shared by more than `most` texts makes no pairs. Its texts go through one task,
each compared with the members of every group so far until one is alike: a large
group of near copies costs about one comparison a text, many unlike texts under one
key the square. The sets of one key's texts must fit a worker's memory.

Equal texts are one node. Null and empty texts have the empty set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import free, ship, through_table, tidy
from isogon.llm import simhash
from isogon.llm.components import connected_components
from isogon.llm.substrings import _board, _hits

BASE = np.uint64(0x9E3779B97F4A7C15)
BANDS, ROWS = 16, 4
_RNG = np.random.default_rng(11)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


class Shingles:
    """Sets of texts, with the hashes of the words met so far."""

    def __init__(self, shingle: int = 5, room: int = 100_000, chars: int = 8 << 20):
        self.shingle, self.room, self.chars, self.words, self.held = shingle, room, chars, {}, 0

    def of(self, data: bytes | None) -> np.ndarray:
        """The hashes of the text's shingles, sorted, each once."""
        import xxhash

        words = (data or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.room or self.held > self.chars:
            self.words, self.held = {}, 0
        known, h = self.words, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = h(w)
            self.held += len(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.shingle, len(words))
        n = len(words) - size + 1
        with np.errstate(over="ignore"):
            code = np.full(n, size, np.uint64)
            for i in range(size):
                code = code * BASE + hashes[i : i + n]
                code ^= code >> np.uint64(29)
            code *= BASE
            code ^= code >> np.uint64(32)
        return np.unique(code)


def keys(codes: np.ndarray) -> np.ndarray:
    """The band keys of a set; one common key for the empty set."""
    if not len(codes):
        return np.zeros(1, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(codes), 4096):
            low = np.minimum(low, ((codes[at : at + 4096, None] * FACTORS + SHIFTS) >> np.uint64(20)).min(0))
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            key = (key ^ row) * BASE
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Jaccard similarity of two sorted sets is `least` or more."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return True
    if not len(a) or len(a) < least * len(b) - 1e-9:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def links_of(rows: DataFrame, nodes: DataFrame, shingle: int, least: float, most: int) -> DataFrame:
    """Links (src, dst) between texts by sig. rows: (id, sig, t); nodes: (sig, fp, keys),
    a row for each sig."""
    spark = rows.sparkSession
    keyed = nodes.select("sig", F.explode("keys").alias("key"))
    count = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = through_table(keyed.join(count, "key"), "shingle-keys")
    few, many = shared.where(F.col("n") <= most), shared.where(F.col("n") > most).select("key", "sig")
    banded = few.select("key", F.col("sig").alias("src")).join(few.select("key", F.col("sig").alias("dst")), "key").where("src < dst").select("src", "dst")
    reps = nodes.groupBy("fp").agg(F.min("sig").alias("rep"))
    same = nodes.join(reps, "fp").where("rep < sig").select(F.col("rep").alias("src"), F.col("sig").alias("dst"))
    bits = simhash.similar_links(nodes).withColumnsRenamed({"src": "fa", "dst": "fb"})
    bits = bits.join(reps.select(F.col("fp").alias("fa"), F.col("rep").alias("a")), "fa").join(reps.select(F.col("fp").alias("fb"), F.col("rep").alias("b")), "fb")
    bits = bits.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    pairs = through_table(banded.unionAll(same).unionAll(bits).distinct(), "shingle-pairs")

    asked = pairs.select(F.col("src").alias("sig")).unionAll(pairs.select("dst")).unionAll(many.select("sig")).distinct()
    size = 23
    named = spark.sparkContext.broadcast(_board(asked.select(F.col("sig").alias("k")), size))  # 2 ** size / 8 bytes

    def sets(batches):
        find = Shingles(shingle)
        for b in batches:
            b = b.filter(pa.array(_hits(named.value, b.column(1).to_numpy(zero_copy_only=False), size)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([find.of(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["sig", "raw"])

    found = through_table(rows.mapInArrow(tidy(sets), "sig long, raw binary").dropDuplicates(["sig"]), "shingle-sets")
    a, b = found.select(F.col("sig").alias("src"), F.col("raw").alias("ra")), found.select(F.col("sig").alias("dst"), F.col("raw").alias("rb"))

    def verified(batches):
        for b in batches:
            yield b.select(["src", "dst"]).filter(pa.array([alike(_set(x), _set(y), least) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_()))

    near = pairs.join(a, "src").join(b, "dst").select("src", "dst", "ra", "rb").mapInArrow(tidy(verified), "src long, dst long")

    def grouped(batches):
        key, groups = None, []
        for b in batches:
            src, dst = [], []
            for now, sig, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now != key:
                    key, groups = now, []
                mine, apart, joined = _set(raw), [], [(sig, _set(raw))]
                for g in groups:
                    at = next((i for i, (_, x) in enumerate(g) if alike(x, mine, least)), None)
                    if at is None:
                        apart.append(g)
                        continue
                    g[0], g[at] = g[at], g[0]
                    src.append(g[0][0])
                    dst.append(sig)
                    g.extend(joined)
                    joined = g
                groups = [*apart, joined]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    star = many.join(found, "sig").select("key", "sig", "raw").repartition("key").sortWithinPartitions("key", "sig").mapInArrow(tidy(grouped), "src long, dst long")
    return near.unionAll(star)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, most: int = 32) -> DataFrame:
    """docs with one row for each component: that of the least id (a null id counts as
    the greatest), of the rows with this id the one whose text is in the component, of
    several texts under it the one with the least hash, and of rows equal in id and text
    the one with the least hash of all its columns."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).cast("binary").alias("t"))

    def sketched(batches):
        find = Shingles(shingle)
        for b in batches:
            texts = b.column(2).to_pylist()
            fps = np.fromiter((simhash.simhash(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array([keys(find.of(t)) for t in texts], pa.list_(pa.int64()))], names=["id", "sig", "fp", "keys"])

    table = through_table(rows.mapInArrow(tidy(sketched), "id long, sig long, fp long, keys array<long>"), "shingles")
    nodes = table.select("sig", "fp", "keys").dropDuplicates(["sig"])
    roots = connected_components(links_of(rows, nodes, shingle, least, most)).withColumnsRenamed({"id": "sig"})
    first = table.groupBy("sig").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("f"))
    best = first.join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min(F.struct("f", "sig")).alias("b"))
    names = docs.columns
    s, i, k = (free(c, names) for c in ("_sig", "_id", "_keep"))
    keep = best.select(F.col("b.f.id").alias(i), F.col("b.sig").alias(k))
    marked = docs.withColumn(s, F.xxhash64(text_col))
    kept = marked.join(keep.hint("merge"), (F.col(s) == F.col(k)) & F.col(id_col).eqNullSafe(F.col(i)), "left_semi")
    return kept.groupBy(s, id_col).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias(k)).select(f"{k}.*")

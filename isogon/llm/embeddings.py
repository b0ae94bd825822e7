"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine t or more have a squared distance of at most 2 - 2t. After
a rotation they are split into blocks; in some block the squared distance is at most
that block's share of the budget. Each block is range-joined by itself: reference
points (a bounded draw of the vectors) cut its space into cells, a vector's home is
its nearest point's cell, and it visits every cell whose bisector with its home lies
within the block's radius, so that each vector within the radius of a home vector
visits that cell. Cells are in an order; a vector visits those before its home, and
so a pair meets once a block. What meets is compared in the block, then over all blocks
and by the cosine in double precision. A link counts in the first block whose budget it
keeps.

Distances to reference points and inside a cell are matrix products; what these let pass
is decided row by row. A vector's homes are found once and go with it, so that all tasks
agree on them.

Cells next to each other form regions, as many as keep about REGION vectors each, or
WIDE_REGION where there would be over FEW. A vector goes to a region once, for all blocks
in which its home or a visit lies there, and cells inside a region cost no copies. Regions
of over HOME_PART homes or VISIT_PART rows are cut into parts. A task gives for each vector the number of links it found and the
least key of those joined to it, not the links.

Equal vectors are one class (told by two 64-bit hashes and the length) that is joined
once, with its number. Vectors of different lengths don't link; lengths between two
powers of two are joined together, with zeros at the ends. Vectors that are null, empty,
zero or that hold null or non-finite components, and rows without an id, link with
nothing. Equal rows are equal vectors and link. Other columns are dropped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import checkpointed, ship, through_table
from isogon.llm.components import connected_components, spread_join

SLACK, SINGLE = 1e-9, 1e-5  # of squared distances, in double and in single precision
REGION, WIDE_REGION, FEW, HOME_PART, VISIT_PART = 16_384, 32_768, 16, 131_072, 131_072


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotated(v: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Row by row and component by component, so that a row's result doesn't depend on the others."""
    return np.stack([(v * rot[:, k]).sum(1) for k in range(rot.shape[1])], 1)


def in_regions(points: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, region of each in this order): halved again and again across
    the widest axis, the largest part first."""
    parts = [np.arange(len(points))]
    while len(parts) < regions and max(map(len, parts)) > 1:
        i = max(range(len(parts)), key=lambda k: len(parts[k]))
        part = parts[i]
        axis = np.ptp(points[part], axis=0).argmax()
        part = part[np.argsort(points[part, axis], kind="stable")]
        parts[i : i + 1] = [part[: len(part) // 2], part[len(part) // 2 :]]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def squared(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of rows by a matrix product."""
    return (y * y).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (y @ p.T)


class Cells:
    """The cells of each block."""

    def __init__(self, points: np.ndarray, rot: np.ndarray, blocks: int, budget: float, regions: int):
        self.rot, self.dims = rot, [x[0] + np.arange(len(x)) for x in np.array_split(np.arange(rot.shape[0]), blocks)]
        self.share = [budget * len(d) / rot.shape[0] for d in self.dims]
        self.points, self.region = [], []
        for d in self.dims:
            p = np.unique(rotated(points, rot)[:, d], axis=0)
            order, region = in_regions(p, regions)
            self.points.append(p[order])
            self.region.append(region)
        self.regions = 1 + max(int(r[-1]) for r in self.region)
        self.within = []
        for p, share in zip(self.points, self.share, strict=True):
            apart = np.sqrt(np.maximum(squared(p, p), 0))
            self.within.append(2 * apart * (np.sqrt(share) + 4e-6) + 1e-7)

    def visits(self, y: np.ndarray, b: int, home: np.ndarray | None = None, cells: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(home cell, mask of it and the cells before it that are visited, among those asked
        for) of rotated vectors' components y of block b. A cell is visited if its bisector with
        the home lies within the block's radius."""
        p = self.points[b]
        if home is None:
            d = squared(y, p)
            home = d.argmin(1)
            least = d[np.arange(len(y)), home]
            d = d[:, cells]
        else:
            d, least = squared(y, p[cells]), ((y - p[home]) ** 2).sum(1)
        at = np.arange(len(p))[cells]
        seen = d - least[:, None] <= self.within[b][:, cells][home]
        return home, (seen | (at[None] == home[:, None])) & (at[None] <= home[:, None])

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell in each block, mask of the regions with a home, mask of the regions with a
        home or a visit)."""
        cell = np.zeros((len(x), len(self.dims)), np.int32)
        homes, goes = np.zeros((len(x), self.regions), bool), np.zeros((len(x), self.regions), bool)
        for a in range(0, len(x), 512):
            for b, dims in enumerate(self.dims):
                home, seen = self.visits(x[a : a + 512, dims], b)
                cell[a : a + 512, b] = home
                homes[np.arange(a, a + len(home)), self.region[b][home]] = True
                first = np.concatenate([[0], np.flatnonzero(np.diff(self.region[b])) + 1])
                goes[a : a + 512, : len(first)] |= np.logical_or.reduceat(seen, first, axis=1)
        return cell, homes, goes


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, blocks: int = 4, most_cells: int = 1024, seed: int = 3) -> DataFrame:
    """(id_col, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    good = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    hashes = [F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"), F.size("v").alias("len")]
    classes = through_table(rows.where(good).select("id", "v", *hashes).groupBy("a", "b", "len").agg(F.min("id").alias("least"), F.count("*").alias("mult"), F.first("v").alias("v")).withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    links = None
    for lo, hi in _spans(classes):
        part = _links(classes.where(F.col("len").between(lo, hi)), hi, kind, blocks, most_cells, 2 - 2 * threshold, threshold, seed)
        links = part if links is None else links.unionAll(part)
    if links is None:
        links = spark.createDataFrame([], "key long, n long, root long")
    links = checkpointed(links.groupBy("key", "root").agg(F.sum("n").alias("n")))
    counts = links.groupBy("key").agg(F.sum("n").alias("n"))
    roots = connected_components(links.where("key <> root"), "key", "root").withColumnsRenamed({"id": "key"})
    member = classes.drop("v").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).join(counts, "key", "left")
    member = checkpointed(member.select("a", "b", "len", "mult", "least", "root", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    best = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(best, "root").select(F.struct("a", "b", "len").alias("c"), "mult", "n_links", "component_id")
    linked = spread_join(rows.where(good).select("id", F.struct(*hashes).alias("c")), named, "c", "mult").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _spans(classes: DataFrame) -> list[tuple[int, int]]:
    """(least, greatest) length of the vectors between two powers of two, where there are
    two vectors to compare: a few dozen spans at most."""
    power = F.length(F.bin(F.col("len") - 1))
    return [(r.lo, r.hi) for r in classes.groupBy(power).agg(F.min("len").alias("lo"), F.max("len").alias("hi"), F.count("*").alias("n")).where("n > 1").orderBy("lo").collect()]


def _links(classes: DataFrame, dim: int, kind: str, blocks: int, most_cells: int, budget: float, threshold: float, seed: int) -> DataFrame:
    """(key, n, root) of the links among classes, whose vectors have dim components or fewer."""
    spark = classes.sparkSession
    padded = F.concat("v", F.array_repeat(F.lit(0).cast(kind[6:-1]), F.lit(dim) - F.size("v")))
    classes = classes.select("key", "mult", "len", F.when(F.size("v") == dim, F.col("v")).otherwise(padded).alias("v"))
    n = classes.count()
    drawn = classes.select("v").orderBy(F.xxhash64("v")).limit(int(min(most_cells, max(16, n**0.5)))).toArrow()
    made = Cells(unit(matrix(drawn.column("v").combine_chunks(), dim)), rotation(dim, seed), min(blocks, dim), budget, max(min(FEW, -(-n // REGION)), -(-n // WIDE_REGION)))
    sent = spark.sparkContext.broadcast(made)  # most_cells points and a rotation
    regions = made.regions

    def count(batches):
        c = sent.value
        home, goes = np.zeros(regions, np.int64), np.zeros(regions, np.int64)
        for batch in batches:
            _, h, g = c.placed(rotated(unit(matrix(batch.column(0), dim)), c.rot))
            home += h.sum(0)
            goes += g.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(regions)), pa.array(home), pa.array(goes)], names=["r", "h", "s"])

    plan, groups, region_of = {}, 0, []
    for r in classes.select("v").mapInArrow(count, "r long, h long, s long").groupBy("r").agg(F.sum("h").alias("h"), F.sum("s").alias("s")).orderBy("r").collect():
        parts = (max(1, -(-r.h // HOME_PART)), max(1, -(-r.s // VISIT_PART)))
        plan[r.r] = (groups, *parts)
        region_of += [r.r] * (parts[0] * parts[1])
        groups += parts[0] * parts[1]

    def deal(batches):
        c = sent.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cell, homes, goes = c.placed(rotated(unit(matrix(batch.column(3), dim)), c.rot))
            at, group, role = [], [], []
            for i, r in zip(*(z.tolist() for z in np.nonzero(goes)), strict=True):
                base, hp, vp = plan[r]
                p, q = int(keys[i] % hp), int(keys[i] // hp % vp)
                for j in range(hp):
                    for k in range(vp) if homes[i, r] and j == p else (q,):
                        at.append(i)
                        group.append(base + j * vp + k)
                        role.append((1 if homes[i, r] and j == p else 0) | (2 if k == q else 0))
            for z in range(0, len(at), 8192):
                rows = batch.take(pa.array(at[z : z + 8192], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(group[z : z + 8192], pa.int32()), pa.array(role[z : z + 8192], pa.int8()), pa.FixedSizeListArray.from_arrays(pa.array(cell[at[z : z + 8192]].ravel()), cell.shape[1]).cast(pa.list_(pa.int32())), *rows.columns], names=["g", "role", "home", "key", "mult", "len", "v"])

    def compare(group: pa.Table) -> pa.Table:
        c = sent.value
        region = region_of[group.column("g")[0].as_py()]
        role, key, mult, size = (group.column(n).to_numpy() for n in ("role", "key", "mult", "len"))
        raw = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        homes = group.column("home").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(raw), -1)
        x = np.concatenate([rotated(unit(raw[a : a + 4096].astype(float)), c.rot).astype(np.float32) for a in range(0, len(raw), 4096)])
        found, parent = {}, {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def joined(b: int, i: np.ndarray, j: np.ndarray) -> None:
            at, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            v = unit(raw[at].astype(float))
            t = rotated(v, c.rot)
            p, q = back[: len(i)], back[len(i) :]
            d = (t[p] - t[q]) ** 2
            inside = np.stack([d[:, dims].sum(1) <= share + SLACK / 2 for dims, share in zip(c.dims, c.share, strict=True)], 1)
            ok = ((v[p] * v[q]).sum(1) >= threshold) & inside[:, b] & ~inside[:, :b].any(1) & (size[i] == size[j])
            for i1, j1 in zip(key[i[ok]].tolist(), key[j[ok]].tolist(), strict=True):
                r1, r2 = root(i1), root(j1)
                if r1 != r2:
                    parent[max(r1, r2)] = min(r1, r2)
            for ks, ms in ((key[i[ok]], mult[j[ok]]), (key[j[ok]], mult[i[ok]])):
                ids, inv = np.unique(ks, return_inverse=True)
                for i1, m in zip(ids.tolist(), np.bincount(inv, ms, len(ids)).tolist(), strict=True):
                    found[i1] = found.get(i1, 0) + int(m)

        for b in range(len(c.dims)):
            cells = np.flatnonzero(c.region[b] == region)
            if not len(cells):
                continue
            y, home, span = np.ascontiguousarray(x[:, c.dims[b]]), homes[:, b], slice(cells[0], cells[-1] + 1)
            norm, one = (y * y).sum(1, keepdims=True), np.ones((len(y), 1), np.float32)
            # a product of these two gives squared distances
            left, right = np.hstack([-2 * y, norm, one]), np.hstack([y, one, norm])
            seen = np.concatenate([c.visits(y[a : a + 4096].astype(float), b, home[a : a + 4096], span)[1] for a in range(0, len(y), 4096)])
            for k, cell in enumerate(cells.tolist()):
                hs, vs = np.flatnonzero((home == cell) & (role & 1 > 0)), np.flatnonzero(seen[:, k] & (role & 2 > 0))
                for a in range(0, len(hs), 512):
                    h = hs[a : a + 512]
                    mine = left[h]
                    for z in range(0, len(vs), 2048):
                        w = vs[z : z + 2048]
                        p, q = np.divmod(np.flatnonzero(mine @ right[w].T <= np.float32(c.share[b] + SINGLE)), len(w))
                        p, q = h[p], w[q]
                        once = (home[q] > cell) | (key[p] < key[q])
                        p, q = p[once], q[once]
                        for s in range(0, len(p), 20_000):
                            joined(b, p[s : s + 20_000], q[s : s + 20_000])
        ids = sorted(found)
        return pa.table({"key": pa.array(ids, pa.int64()), "n": pa.array([found[i] for i in ids], pa.int64()), "root": pa.array([root(i) for i in ids], pa.int64())})

    return classes.mapInArrow(deal, f"g int, role byte, home array<int>, key long, mult long, len int, v {kind}").groupBy("g").applyInArrow(compare, "key long, n long, root long")


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

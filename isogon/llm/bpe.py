"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

The words of many documents are laid out as one array of symbols. An inverted
index holds, for each merge, the positions whose symbol and its right neighbour
it joins; the merges are replayed once over the whole array in rank order and
touch only those positions and their two neighbours. Each distinct word is
replayed once in a worker's life, as long as its cache has room.

A rank file also lets two tokens join whose union has a lower rank than the merge
just made; then the order inside the word matters, so that such words (rare) are
done again one merge at a time, as the definition has it, with the pairs in a heap:
n log n in a word's length. Which tokens can lead to that is known from the file.

Nulls are empty texts. Equal rows stay separate rows. Other columns are dropped."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isogon.cluster import CACHES, ship, tidy

NONE = np.int32(1 << 30)
#: Where a split of a text before a space could fall inside a run of white space.
_RUN = re.compile(r"\s \s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes batches of distinct words (bytes) by the ranks given."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        found = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a = ranks.get(t[:i])
                if a is not None and (b := ranks.get(t[i:])) is not None:
                    found[a << 20 | b] = r
        self.joins = found
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        # the last key can't occur, so that every search lands inside
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.rank = np.append(np.fromiter(found.values(), np.int32, len(found))[order], NONE)
        # tokens that can join into one of a lower rank: merging all their places at once may miss that
        self.early = np.zeros(len(self.token), bool)
        for k, r in found.items():
            for part in (k >> 20, k & (1 << 20) - 1):
                if r < part:
                    self.early[part] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.rank[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """By the definition: again and again the leftmost pair of least rank."""
        sym = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, joins = len(sym), self.joins
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := joins.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j < 0 or joins.get(sym[i] << 20 | sym[j]) != r:
                continue  # one of the two has been merged since
            sym[i], sym[j] = r, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := joins.get(r << 20 | sym[k])) is not None:
                    heapq.heappush(heap, (q, i))
            if (h := prv[i]) >= 0 and (q := joins.get(sym[h] << 20 | r)) is not None:
                heapq.heappush(heap, (q, h))
        return [x for x in sym if x >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of the words in them)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        n = int(ends[-1]) if len(words) else 0
        starts = ends - lens
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        some = lens > 0
        nxt[ends[some] - 1], prv[starts[some]] = -1, -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.pair(sym[inner], sym[nxt[inner]])
        live = np.flatnonzero(rank != NONE).astype(np.int32)
        live = live[np.argsort(rank[live], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[live])) + 1
        index: dict[int, list[np.ndarray]] = {int(rank[x[0]]): [x] for x in np.split(live, cuts) if len(x)}
        queue, again = list(index), []
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.early[r] and len(at) > 1:  # matters in words that have it twice
                word = np.searchsorted(ends, at, side="right")
                again.append(at[1:][word[1:] == word[:-1]])
            right = nxt[at]
            if len(at) > 1 and (at[1:] == right[:-1]).any():  # a run such as aaa: from the left
                keep, last = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                    if p != last:
                        keep.append(i)
                        last = q
                at, right = at[keep], right[keep]
            after = nxt[right]
            sym[at], sym[right] = r, -1
            rank[right] = NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            rank[at[~has]] = NONE
            left = np.concatenate([at[has], before[before >= 0]])
            if not len(left):
                continue
            new = self.pair(sym[left], sym[nxt[left]])
            rank[left] = new
            left, new = left[new != NONE], new[new != NONE]
            if not len(left):
                continue
            order = np.argsort(new, kind="stable")
            left, new = left[order], new[order]
            cut = np.flatnonzero(np.diff(new)) + 1
            for k, x in zip(new[np.concatenate([[0], cut])].tolist(), np.split(left, cut) if len(cut) else [left], strict=True):
                if k in index:
                    index[k].append(x)
                else:
                    index[k] = [np.sort(x)]
                    heapq.heappush(queue, k)
        alive = sym >= 0
        ids = sym[alive]
        offsets = np.concatenate([[0], np.cumsum(alive)[ends - 1] if some.all() else np.concatenate([[0], np.cumsum(alive)])[ends]])
        if sum(map(len, again)):
            ids, offsets = self._redo(words, ids, offsets, np.unique(np.searchsorted(ends, np.concatenate(again), side="right")))
        return ids, offsets

    def _redo(self, words, ids, offsets, which):
        parts, at = [], 0
        sizes = np.diff(offsets)
        for w in which.tolist():
            parts += [ids[at : offsets[w]], np.array(done := self.one(words[w]), np.int32)]
            at, sizes[w] = offsets[w + 1], len(done)
        parts.append(ids[at:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


class Encoder:
    """Encodes documents; keeps the ids of units of text (what lies between two
    safe splits before a space) as long as there is room for `room` of them and for
    `chars` characters."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 250_000, chars: int = 8 << 20):
        import regex

        self.replay, self.find, self.room, self.chars = MergeReplay(ranks), regex.compile(pattern).findall, room, chars
        self.number = [str(i) for i in range(len(self.replay.token))]
        self.clear()

    def clear(self) -> None:
        self.head: dict[str, int] = {}  # units as they stand
        self.tail: dict[str, int] = {}  # units after a space
        self.flat, self.start, self.held = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def units(self, text: str) -> tuple[list[str], list[str]]:
        if _RUN.search(text):
            return self.find(text), []
        first, *rest = text.split(" ")
        return ([first] if first else []), rest

    def learn(self, docs: list[tuple[list[str], list[str]]]) -> None:
        if len(self.start) > self.room or self.held > self.chars:
            self.clear()
        head = dict.fromkeys(u for h, _ in docs for u in h if u not in self.head)
        tail: dict[str, None] = {}
        for _, t in docs:
            tail.update(dict.fromkeys(t))
        tail = [u for u in tail if u not in self.tail]
        units = [*head, *(" " + u for u in tail)]
        if not units:
            return
        self.held += sum(map(len, units))
        words: dict[str, int] = {}
        split = [[words.setdefault(w, len(words)) for w in self.find(u)] for u in units]
        ids, offsets = self.replay.encode([w.encode() for w in words])
        seq = np.fromiter((w for s in split for w in s), np.int64)
        flat, lens = gather(ids, offsets[:-1], np.diff(offsets), seq)
        per = np.add.reduceat(np.append(lens, 0), np.minimum(np.cumsum([0, *map(len, split)])[:-1], len(lens))) * np.array([bool(s) for s in split])
        base = len(self.start) - 1
        self.head.update(zip(head, range(base, base + len(head)), strict=True))
        self.tail.update(zip(tail, range(base + len(head), base + len(units)), strict=True))
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(per)])

    def at(self, units: tuple[list[str], list[str]]) -> list[int]:
        head, tail = units
        return [*map(self.head.__getitem__, head), *map(self.tail.__getitem__, tail)]

    def ids(self, at: list[int]) -> np.ndarray:
        where = np.array(at, np.int64)
        return gather(self.flat, self.start[:-1], np.diff(self.start), where)[0] if len(at) < 64 else self._many(where)

    def _many(self, where: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start, None, where)[0]


def gather(flat: np.ndarray, start: np.ndarray, lens: np.ndarray | None, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces `which` of flat one after the other, and their lengths."""
    begin = start[which]
    size = lens[which] if lens is not None else start[which + 1] - begin
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)], size


def decode(tokens: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str, pattern: str) -> Encoder:
    """One for each vocabulary and pattern in a worker's life."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, step: int = 2 << 20) -> Iterator[tuple[pa.Array, list, Encoder]]:
    """(id column, [positions of each document's units], encoder), for `step` bytes of text
    at a time or one text: a step's words and the arrays of their replay are what a worker
    holds beside the cache."""
    enc = encoder(path, pattern)
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
            units = [enc.units(t or "") for t in b.column(1).slice(at, end - at).to_pylist()]
            enc.learn(units)
            places = [enc.at(u) for u in units]
            del units
            yield b.column(0).slice(at, end - at), places, enc
            at = end


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): one row per document."""

    def run(batches):
        for ids, docs_at, enc in _encoded(batches, path, pattern):
            got = [enc._many(np.array(a, np.int64)) if a else np.zeros(0, np.int32) for a in docs_at]
            offsets = np.cumsum([0, *map(len, got)]).astype(np.int32)
            flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(run, _ENCODERS), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data binary): the bytes of each row's ids; null ids give none."""
    ship(encoded.sparkSession)

    def run(batches):
        tokens = MergeReplay(load_ranks(path)).token
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(tokens, x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=["id", "data"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", step: int = 2 << 20) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode() and decode_ids() in
    one pass, with digests in place of the ids and bytes."""

    def run(batches):
        for ids, docs_at, enc in _encoded(batches, path, pattern, step):
            n, a, b = [], [], []
            for at in docs_at:
                got = enc._many(np.array(at, np.int64)).tolist() if at else []
                n.append(len(got))
                a.append(hashlib.sha256(",".join(map(enc.number.__getitem__, got)).encode()).hexdigest())
                b.append(hashlib.sha256(decode(enc.replay.token, got)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(run, _ENCODERS), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def production(docs: DataFrame, step: int = 2 << 20) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, step=step)


def op9(spark, sf_dir: str) -> DataFrame:
    # larger steps take less time; beside other stages a worker has no room for them
    return production(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8 << 20)

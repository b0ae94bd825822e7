"""Token ids in fixed-width binary files.

A file holds the ids of a range of documents: blocks of BLOCK ids, each id in the
least bits that the vocabulary needs, lowest bit first; then the offsets of the
blocks, the documents' ids and first positions, and a footer that says where these
are. A reader unpacks any block by itself, so that id n is found from the footer
and one block. Documents are in ascending order of their id over the files, and of
their ids' bytes where it is the same; a null id comes first.

Files are written under another name and moved when complete; what a file holds
depends on its documents only, so that a task that runs again writes it anew.

Where the tokenizer's file shows that no rule of it reaches over white space (`Tokens`
knows one such setup), the library gets each distinct word once in a worker's life, in
place of each whole text; the ids are those of the whole texts. With any other setup
it gets every whole text.

Null texts are empty: only the end id. Equal rows stay separate rows."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isogon.cluster import scratch, ship
from isogon.llm.bpe import gather

BLOCK = 1 << 16
FOOTER = struct.Struct("<IIQQQQQ8s")
MAGIC = b"ISOPACK1"


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Streams documents into one file."""

    def __init__(self, path: str, bits: int):
        self.fs, self.path = file_system(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.bits = self.fs.open_output_stream(self.temp), bits
        self.rest, self.waiting = [], 0
        self.offsets, self.docs, self.starts, self.n = [0], [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(-1 << 63 if doc is None else doc)
        self.starts.append(self.n)
        self.n += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= BLOCK or last and at < len(ids):
            data = pack(ids[at : at + BLOCK], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
            at += BLOCK
        self.rest, self.waiting = [ids[at:]], max(0, len(ids) - at)

    def close(self) -> None:
        self.flush(True)
        at = self.offsets[-1]
        tables = [np.array(x, t).tobytes() for x, t in ((self.offsets, "<u8"), (self.docs, "<i8"), ([*self.starts, self.n], "<u8"))]
        for t in tables:
            self.out.write(t)
        self.out.write(FOOTER.pack(self.bits, BLOCK, self.n, len(self.docs), at, at + len(tables[0]), at + len(tables[0]) + len(tables[1]), MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Reads one file; ids(a, b) opens only the blocks that hold these positions."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        self.bits, self.block, self.n, docs, offsets_at, docs_at, starts_at, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        self.offsets = np.frombuffer(self.file.read_at(docs_at - offsets_at, offsets_at), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self.file.read_at(8 * docs, docs_at), "<i8")
        self.starts = np.frombuffer(self.file.read_at(8 * (docs + 1), starts_at), "<u8").astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = [unpack(data[self.offsets[k] - self.offsets[first] : self.offsets[k + 1] - self.offsets[first]], min(self.block, self.n - k * self.block), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def __iter__(self):
        """(document's id, its ids), block by block of documents."""
        at, docs = 0, len(self.docs)
        while at < docs:
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + 16 * self.block, side="right")) - 1)
            ids = self.ids(int(self.starts[at]), int(self.starts[end]))
            for i in range(at, end):
                doc = int(self.docs[i])
                yield (None if doc == -1 << 63 else doc), ids[self.starts[i] - self.starts[at] : self.starts[i + 1] - self.starts[at]]
            at = end

    def close(self) -> None:
        self.file.close()


#: Texts that are plain enough to be cut into words here: ASCII and Latin-1 letters.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
#: What the tokenizer's own pattern cuts such a text into, when in lower case.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t\n\r ]+").findall
#: How the tokenizer must be set up for this to hold.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Tokens:
    """A tokenizer of the tokenizers library, with the ids of the parts met so far.

    If the vocabulary marks word ends and cuts by the pattern above, plain texts are
    cut into words here; words new to this worker go to the tokenizer by hundreds in
    one text, whose ids the marks tell apart. Of other texts each new part between
    spaces goes by itself. If the vocabulary is of another kind, whole texts go."""

    def __init__(self, path: str, room: int = 400_000, chars: int = 8 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.chars = Tokenizer.from_file(path), room, chars
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        steps = [setup.get("pre_tokenizer") or {}, *((setup.get("pre_tokenizer") or {}).get("pretokenizers") or [])]
        mark = setup["model"].get("end_of_word_suffix")
        kinds = [x.get("type") for x in (setup.get("normalizer") or {}).get("normalizers") or []]
        self.by_words = bool(mark) and kinds == ["NFC", "Replace", "Lowercase"] and any((x.get("pattern") or {}).get("Regex") == _PATTERN and x.get("invert") for x in steps)
        if self.by_words:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.at, self.flat, self.start, self.held = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def _learn(self, keys: list, flat: np.ndarray, ends: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.flat, self.start = np.concatenate([self.flat, flat]), np.concatenate([self.start, self.start[-1] + ends])

    def _words(self, new: list[str]) -> None:
        texts = [" ".join(new[i : i + 500]) for i in range(0, len(new), 500)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(new) or ends[-1] != len(flat):
            raise RuntimeError("the tokenizer cuts words in another way than expected")
        self._learn(new, flat, ends)

    def _parts(self, new: list[tuple[str]]) -> None:
        for a in range(0, len(new), 20_000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([p for p, in new[a : a + 20_000]], add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
            self._learn(new[a : a + 20_000], np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1])), ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if not self.by_words:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))
        if len(self.at) > self.room or self.held > self.chars:
            self.clear()
        # a word is a key; a part is a key in a tuple, as what it stands for is not cut yet
        docs = [_CUT(t.lower()) if _PLAIN(t) and not any(x in t for x in self.special) else [*zip(t.replace("\n", " ").split(" "), strict=True)] for t in texts]
        new = set(chain.from_iterable(docs)) - self.at.keys()
        parts = [k for k in new if isinstance(k, tuple)] if any(d and isinstance(d[0], tuple) for d in docs) else []
        new = list(new.difference(parts))
        self.held += sum(map(len, new)) + sum(len(p) for p, in parts)
        if new:
            self._words(new)
        self._parts(parts)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        ids, each = gather(self.flat, self.start, None, which)
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])


_TOKENS: dict[str, Tokens] = {}


def in_steps(texts: list, step: int = 4 << 20):
    """(from, to) of runs of texts of about step characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= step):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32 << 20) -> DataFrame:
    """Tokenizes docs and writes the files below path, about shard_bytes of text in
    each. Returns the manifest (shard, path, n_docs, n_ids, start), a small table
    that is also stored beside the files, start being the ids in the files before."""
    spark = docs.sparkSession
    ship(spark)
    bits = width(vocabulary)
    kind = "<u2" if bits <= 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cuts = sorted(set(docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / shards for i in range(1, shards)], 0.2 / shards))) if shards > 1 else []
    sent = spark.sparkContext.broadcast(np.array(cuts, float))  # a number a file

    def tokenize(batches):
        if tokenizer not in _TOKENS:
            _TOKENS[tokenizer] = Tokens(tokenizer)
        tokens = _TOKENS[tokenizer]
        for b in batches:
            texts = b.column(1).to_pylist()
            shard = np.searchsorted(sent.value, b.column(0).fill_null(-1 << 63).to_numpy(zero_copy_only=False).astype(float)).astype(np.int32)  # null ids go to the first
            for a, z in in_steps(texts):
                ids, sizes = tokens.encode(texts[a:z])
                ends = np.cumsum(sizes)
                data = np.insert(ids, ends, end_id).astype(kind)
                offsets = np.concatenate([[0], ends + np.arange(1, z - a + 1)]) * data.itemsize
                packed = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(shard[a:z]), b.column(0).slice(a, z - a), packed], names=["shard", "id", "ids"])

    def store(batches):
        writer, at = None, None
        done = []

        def finish():
            writer.close()
            done.append((at, f"{path}/shard-{at:06d}.bin", len(writer.docs), writer.n))

        for b in batches:
            for s, doc, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != at:
                    if writer:
                        finish()
                    writer, at = Writer(f"{path}/shard-{s:06d}.bin", bits), s
                writer.add(doc, np.frombuffer(ids, kind).astype(np.uint32))
        if writer:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_ids"])

    ids = rows.mapInArrow(tokenize, "shard int, id long, ids binary")
    dealt = ids.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(store, "shard int, path string, n_docs long, n_ids long").write.parquet(f"{path}/files.parquet")
    files = spark.read.parquet(f"{path}/files.parquet")
    start = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", start).write.parquet(f"{path}/manifest.parquet")
    return spark.read.parquet(f"{path}/manifest.parquet")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids array<long>) of each document, from the files."""
    return _read(spark, path, id_col, "ids array<long>", pa.list_(pa.int64()), lambda ids: ids.tolist())


def digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files."""
    return _read(spark, path, id_col, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark, path, id_col, column, kind, value) -> DataFrame:
    ship(spark)

    def run(batches):
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows, at = Reader(file), ([], [], [], []), base
                for doc, ids in reader:
                    for out, x in zip(rows, (doc, at, len(ids), value(ids)), strict=True):
                        out.append(x)
                    at += len(ids)
                    if len(rows[0]) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(),) * 3 + (kind,), strict=True)], names=["id", "start", "n_tokens", column.split()[0]])
                        rows = ([], [], [], [])
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(),) * 3 + (kind,), strict=True)], names=["id", "start", "n_tokens", column.split()[0]])

    files = spark.read.parquet(f"{path}/manifest.parquet").select("path", "start", "shard")
    n = max(1, files.count())
    return files.repartitionById(n, F.col("shard")).select("path", "start").mapInArrow(run, f"id long, start long, n_tokens long, {column}").withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "op1")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 2, 49_408)
    return digests(spark, path)

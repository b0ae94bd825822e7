"""Language identification with segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A
word (lower case, with the vocabulary's mark for a word's start before it) has in
a language the sum over all its segmentations into pieces of the product of their
probabilities, found by a forward pass; a text has the product over its words.
Pieces of up to `longest` characters take part; a character that is no piece
counts as a piece of least probability, so that no word is impossible.

Fitting: expectation maximisation over words of a bounded sample of the labelled
documents, `max_docs` (about) of each language, drawn by a hash of the id, without
words of `most_chars` characters or more. All texts are scored whole; a word of over
STRETCH characters has the product of its stretches' sums.

Null texts and texts without a letter are `und` with score 0, as is every text if
no language could be learned. Equal likelihoods go to the language that sorts
first. Equal rows stay separate rows; null ids pass through; other columns are
dropped."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isogon.cluster import CACHES, ship, tidy

START = "▁"
STRETCH = 256
MIX = np.uint64(0x9E3779B97F4A7C15)
SEED = np.uint64(0x51ED270B)


class Pieces:
    """The vocabulary, and where its pieces lie in words."""

    def __init__(self, pieces: list[str], longest: int = 10):
        self.longest = longest
        self.pieces = sorted({p for p in pieces if 0 < len(p) <= longest and p == p.lower()})
        self.none, self.odd = len(self.pieces), len(self.pieces) + 1  # no piece; a character that is no piece
        self.bits = 18
        size = 1 << self.bits
        self.key, self.id = np.zeros(size, np.uint64), np.full(size, self.none, np.int32)
        for i, p in enumerate(self.pieces):
            h = SEED
            with np.errstate(over="ignore"):
                for c in p:
                    h = (h ^ np.uint64(ord(c))) * MIX
                slot = int(h >> np.uint64(64 - self.bits))
            while self.key[slot]:
                if self.key[slot] == h:
                    raise ValueError("two pieces have the same hash")
                slot = (slot + 1) % size
            self.key[slot], self.id[slot] = h, i

    def look(self, h: np.ndarray) -> np.ndarray:
        out, slot = np.full(len(h), self.none, np.int32), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.key[slot[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.id[slot[todo[hit]]]
            todo = todo[~hit & (k != 0)]
            slot[todo] = (slot[todo] + 1) % len(self.key)
        return out

    def lattice(self, words: list[str]) -> np.ndarray:
        """ids[w, i, k]: the piece of k + 1 characters from character i; words of equal length."""
        n, width = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(width, n).astype(np.uint64)
        out = np.full((width, n, min(self.longest, n)), self.none, np.int32)
        h = np.full((width, n), SEED, np.uint64)
        for k in range(min(self.longest, n)):
            h = (h[:, : n - k] ^ chars[:, k:]) * MIX
            out[:, : n - k, k] = self.look(h.ravel()).reshape(width, n - k)
        one = out[:, :, 0]
        one[one == self.none] = self.odd
        return out


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations: (words, languages).
    prob: (pieces + 2, languages), 0 in the row of no piece."""
    width, n, most = ids.shape
    alpha = np.zeros((n + 1, width, prob.shape[1]))
    alpha[0] = 1
    log = np.zeros((width, prob.shape[1]))
    for j in range(1, n + 1):
        for k in range(min(most, j)):
            alpha[j] += alpha[j - k - 1] * prob[ids[:, j - k - 1, k]]
        if j % 8 == 0:  # against underflow: the window that later steps read
            scale = alpha[j].copy()
            log += np.log(scale)
            alpha[max(0, j - most) : j + 1] /= scale
    return log + np.log(alpha[n])


def expected(ids: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces, for one language; prob: (pieces + 2,)."""
    width, n, most = ids.shape
    alpha, beta = np.zeros((n + 1, width)), np.zeros((n + 1, width))
    alpha[0], beta[n] = 1, 1
    for j in range(1, n + 1):
        for k in range(min(most, j)):
            alpha[j] += alpha[j - k - 1] * prob[ids[:, j - k - 1, k]]
    for i in range(n - 1, -1, -1):
        for k in range(min(most, n - i)):
            beta[i] += prob[ids[:, i, k]] * beta[i + k + 1]
    out, total = np.zeros(len(prob)), np.maximum(alpha[n], 1e-300)
    for i in range(n):
        for k in range(min(most, n - i)):
            use = ids[:, i, k]
            out += np.bincount(use, alpha[i] * prob[use] * beta[i + k + 1] / total * weight, len(prob))
    return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


class Model:
    def __init__(self, langs: list[str], prob: np.ndarray, pieces: Pieces):
        self.langs, self.prob, self.pieces = langs, prob, pieces

    def words(self, words: list[str], step: int = 20_000) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        far = [i for i, w in enumerate(words) if len(w) > STRETCH]
        if far:
            parts = [(i, words[i][a : a + STRETCH]) for i in far for a in range(0, len(words[i]), STRETCH)]
            np.add.at(out, [i for i, _ in parts], self.words([p for _, p in parts]))
            near = [i for i, w in enumerate(words) if len(w) <= STRETCH]
            out[near] = self.words([words[i] for i in near])
            return out
        for n, at in by_length(words).items():
            for a in range(0, len(at), max(1, step * 10 // max(n, 10))):
                part = at[a : a + max(1, step * 10 // max(n, 10))]
                out[part] = forward(self.pieces.lattice([words[i] for i in part]), self.prob)
        return out


def split(text: str) -> list[str]:
    return text.lower().split()


def fit(counts: dict[str, dict[str, int]], pieces: Pieces, rounds: int = 4, prior: float = 0.02, most_chars: int = 40) -> Model:
    """counts: word counts of each language; words beyond most_chars don't count."""
    langs = sorted(counts)
    prob = np.zeros((len(pieces.pieces) + 2, len(langs)))
    for col, lang in enumerate(langs):
        words = sorted(w for w in counts[lang] if len(w) < most_chars)
        groups = [(pieces.lattice([START + words[i] for i in at]), np.array([counts[lang][words[i]] for i in at], float)) for at in by_length(words).values()]
        p = np.full(len(prob), 1 / len(prob))
        for _ in range(rounds):
            p[pieces.none] = 0
            c = sum((expected(ids, p, weight) for ids, weight in groups), np.zeros(len(prob)))
            p = (c + prior) / (c.sum() + prior * len(prob))
        p[pieces.none] = 0
        prob[:, col] = p
    # a strange character tells nothing about the language
    prob[pieces.odd] = prob[pieces.odd].min() if len(langs) else 0
    return Model(langs, prob, pieces)


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def learn(labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 600, longest: int = 10) -> Model:
    """Fits on about max_docs of the labelled documents of each language. Word counts
    are summed on the executors; the driver gets those of the bounded sample."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    share = {r.l: min(1.0, max_docs / r.n) for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    pieces = Pieces(vocabulary(path), longest)
    if not share:
        return fit({}, pieces)
    odds = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))]), F.col("l"))
    drawn = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < odds * (1 << 30))

    def count(batches):
        from collections import Counter

        total: Counter = Counter()
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.update((lang, w) for w in split(t))
        items = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["l", "w", "n"])

    words = drawn.select("t", "l").mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in share}
    for lang, w, n in zip(*(words.column(c).to_pylist() for c in range(3)), strict=True):
        counts[lang][w] = n
    return fit(counts, pieces)


class Scorer:
    """A model and the values of the words met so far."""

    def __init__(self, model: Model, room: int = 150_000, chars: int = 8 << 20):
        import regex

        self.model, self.room, self.chars, self.letter = model, room, chars, regex.compile(r"\p{L}").search
        self.at: dict[str, int] = {}
        self.held = 0
        self.value = np.zeros((0, len(model.langs)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        docs = [split(t) if t and self.letter(t) and self.model.langs else [] for t in texts]
        if len(self.at) > self.room or self.held > self.chars:
            self.at, self.value, self.held = {}, self.value[:0], 0
        new = list(dict.fromkeys(w for d in docs for w in d if w not in self.at))
        if new:
            self.held += sum(map(len, new))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.value = np.concatenate([self.value, self.model.words([START + w for w in new])])
        langs, scores = [], []
        for d in docs:
            if not d:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.value[np.fromiter(map(self.at.__getitem__, d), np.int64, len(d))].sum(0)
            p = np.exp(total - total.max())
            langs.append(self.model.langs[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


#: The last scorer of this worker, with the words it has met.
_SCORERS: dict[str, Scorer] = {}
CACHES.append(_SCORERS)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs, and lang_pred and score in place of any of these names."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score")
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((model.langs, model.prob, model.pieces))  # a vocabulary times the languages
    where = docs.columns.index(text_col)

    def run(batches):
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(Model(*sent.value))
        for b in batches:
            texts = b.column(where).to_pylist()
            langs, scores = [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 4 << 20):
                    size += len(texts[end] or "")
                    end += 1
                a, s = scorer.score(texts[at:end])
                langs += a
                scores += s
                at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(run, _SCORERS), schema)


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()), pieces_path())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Quality rules: text statistics, and ordered decision lists learned from labels.

statistics(): words are what lies between ASCII white space. A decision list is
learned by sequential covering: grow one conjunction of thresholds at a time on
two thirds of the rows by information gain, prune it on the other third, keep it
if it is precise there, go on with the rows it leaves. The list is emitted as one
conditional expression of Spark columns.

Nulls: a null text has no words; a label that is null is no label, and of several
labels of one id the least counts; a null id has no label. With no bad row among
the labels no rule is learned and only the base rules decide. Equal rows stay
separate rows; other columns are dropped."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isogon.cluster import ship, through_table

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!?"
SPACE_AND_TAILS = bytes(range(9, 14)) + b" " + bytes(range(0x80, 0xC0))
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_echoes"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # a window's number among the distinct ones, joined pair by pair, so that equal numbers mean equal words
    code, last = ids[:n], len(number)
    for k in range(1, window):
        code = code * len(number) + ids[k : k + n]
        if k < window - 1 and last * len(number) ** 2 < 1 << 62:
            last *= len(number)
            continue
        found, code = np.unique(code, return_inverse=True)
        last = len(found)
        if last == n:
            return 0
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(data: bytes | None) -> tuple[int, ...]:
    data = data or b""
    words = data.split()
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")] if words else []
    return (
        len(words),
        len(data.translate(None, SPACE_AND_TAILS)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(filled) - len(set(filled)),
        repeated_words(words),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, MARKS)),
        len(lines),
        sum(map(eq, words, words[1:])),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, COUNTS...): one row per document."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [measure(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS)))], names=["id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: The features that rules may test, as (numerator, denominator or None).
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "marks": ("n_marks", "n_words"), "line_words": ("n_words", "n_lines"), "echoes": ("n_echoes", "n_words"),
}


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.coalesce(F.col(a).cast("double") / F.when(F.col(b) != 0, F.col(b)), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.at if self.above else x[self.name] <= self.at

    def column(self) -> Column:
        return feature(self.name) > self.at if self.above else feature(self.name) <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.at:.6g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds makes a document bad, else it is good."""

    rules: list[list[Test]] = field(default_factory=list)

    def bad(self) -> Column:
        out = None
        for rule in self.rules:
            cond = rule[0].column()
            for t in rule[1:]:
                cond = cond & t.column()
            out = F.when(cond, True) if out is None else out.when(cond, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules)


def _covers(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, most_cuts: int) -> tuple[float, Test | None]:
    """The test with the highest gain over the rows given."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Test | None] = (1e-9, None)
    if not p0 or not n0:
        return best
    info = math.log2(p0 / (p0 + n0))
    for name in sorted(x):
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts) > most_cuts:
            cuts = cuts[np.linspace(0, len(cuts) - 1, most_cuts).astype(int)]
        if not len(cuts):
            continue
        p = np.cumsum(b)[cuts]
        n = cuts + 1 - p
        for above in (False, True):
            pp, nn = (p0 - p, n0 - n) if above else (p, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - info), -1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Test(name, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.9, least: int = 5, most_rules: int = 12, most_tests: int = 4, most_cuts: int = 256) -> DecisionList:
    """prune: the rows that prune and judge rules; the others grow them."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most_rules:
        g, q = left & ~prune, left & prune
        if bad[g].sum() < least:
            break
        rule: list[Test] = []
        while len(rule) < most_tests:
            inside = g & _covers(rule, x, len(bad))
            _, test = _best({k: v[inside] for k, v in x.items()}, bad[inside], most_cuts)
            if test is None:
                break
            rule.append(test)
        if not rule:
            break

        def worth(r: list[Test]) -> float:
            hit = q & _covers(r, x, len(bad))
            good = int((bad & hit).sum())
            return (2 * good - int(hit.sum())) / max(int(hit.sum()), 1)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        hit, seen = q & _covers(rule, x, len(bad)), left & _covers(rule, x, len(bad))
        if hit.sum() < 1 or (bad & hit).sum() < precision * hit.sum() or (bad & seen).sum() < max(least, precision * seen.sum()):
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return DecisionList(rules)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000, precision: float = 0.9) -> DecisionList:
    """Learns from about max_rows labelled rows that the base rules keep, drawn by a
    hash of the id; the driver gets a number for each feature."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    n = labels.count()
    spot = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1 << 30))
    rows = stats.where(~base_failed()).join(marks.where(spot < min(1.0, max_rows / max(n, 1)) * (1 << 30)), id_col)
    got = rows.select(*[feature(f).alias(f) for f in FEATURES], (F.col("_label") == 0).alias("bad"), (F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(3)) == 0).alias("prune"), F.col(id_col).alias("i")).toPandas().sort_values("i", kind="stable")
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["bad"].to_numpy(bool), got["prune"].to_numpy(bool), precision)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, COUNTS..., base_failed, kept)."""
    stats = through_table(statistics(docs, id_col, text_col), "quality")
    rules = fit(stats, labels, id_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.bad())


def op6(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

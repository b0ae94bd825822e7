"""Each operator over small tables with nulls, empty and long texts, ties, repeated
rows and clashing column names, against brute force."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isogon.cluster import scratch
from isogon.llm import bpe, embeddings, langid, linededup, mixing, packed, quality, sharding, simhash, substrings

LONG = " ".join(f"word{i % 977}x" for i in range(20_000))
EN = "the cat and the dog were in the house of the king with that which this"
DE = "der hund und die katze sind in dem haus mit nicht auch eine sich von"
TEXTS = [
    None, "", " \n\t ", "a", "one two", EN, EN, DE + "\nzweite zeile\ndritte zeile", LONG, LONG, EN + " more", "12 34 ###", "\x1c\x85 \xa0x", "aaaa aaaa aaaa",
    "l1\nl2\nl3\nl4\nl5\nl6", "p\nl1\nl2\nl3\nl4\nl5\nl6\nq", "ÀÉ ß straße 'S it's",
]
CLASHING = "_s _sig _id _gone _spans _numbers _n _shard _bucket _place _before _keep _chunks _lines".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sig long, key string, fp string, score string, epoch string, " + ", ".join(f"{c} int" for c in CLASHING)


def table(spark, rows=None):
    """Documents with every kind of oddity: repeated and null ids, names that the
    operators use inside."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, EN), (None, None), (5, EN), (5, "other text of id five")] if rows is None else rows
    data = [(i, t, ("de" if t and "der " in t else "en") if t and i != 3 else None, None if i == 4 else f"s{(i or 0) % 3 if (i or 0) % 5 else 0}", len(t or ""), 7, 8, "k", "f", "s", "e", *range(len(CLASHING))) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return table(spark, [])


def components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(ids))]


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- token files


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, 1000).astype(np.uint32)
    assert (packed.unpack(packed.pack(ids, bits), 1000, bits) == ids).all()


@pytest.mark.parametrize("vocabulary,name", [(49_408, "word_bpe_49k.json"), (50_257, "byte_bpe_50k.json")])
def test_token_files(spark, vocabulary, name):
    from tokenizers import Tokenizer

    docs = table(spark)
    path = scratch(spark, "t1")
    manifest = packed.write(docs, path, P.path(name), 2, vocabulary, shard_bytes=40_000)
    t = Tokenizer.from_file(P.path(name))
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    got = packed.read(spark, path).orderBy("start").collect()
    assert manifest.count() > 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == list(np.cumsum([0] + [len(r.ids) for r in got])[:-1])
    for r in packed.digests(spark, path).collect():
        assert (r.start, r.ids_crc32) in {(x.start, zlib.crc32(np.array(x.ids, "<u4").tobytes())) for x in got}
    one = packed.Reader(manifest.orderBy("shard").first().path)
    whole = one.ids(0, one.n)
    assert (one.ids(3, 9) == whole[3:9]).all()


def test_token_files_empty(spark):
    path = scratch(spark, "t1e")
    packed.write(empty(spark), path, P.path("word_bpe_49k.json"), 2, 49_408)
    assert packed.digests(spark, path).count() == 0


def test_tokens_of_odd_parts():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(P.path("word_bpe_49k.json")), packed.Tokens(P.path("word_bpe_49k.json"))
    r = random.Random(0)
    texts = ["a<|endoftext|>b", "<|startoftext|> x", "ΣΑΣ İI", "é é"] + ["".join(r.choice("ab'sZÉéß9 \n\t\x85\xa0#<|>.") for _ in range(40)) for _ in range(300)]
    ids, n = mine.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text


# --- line dedup


def test_line_chunks_are_shift_resistant():
    lines = [f"line {i * 7 % 61}".encode() for i in range(60)]
    a, b = linededup.chunks(b"\n".join(lines)), linededup.chunks(b"x\ny\nz\n" + b"\n".join(lines))
    assert b"\n".join(x for c in a for x in c) == b"\n".join(lines)
    assert len({tuple(c) for c in a} & {tuple(c) for c in b}) >= len(a) - 2


def test_line_dedup(spark):
    extra = [(100 + i, "\n".join(f"shared {k}" for k in range(12)) + f"\nown {i}") for i in range(5)]
    docs = table(spark, [(i, t) for i, t in enumerate(TEXTS)] + extra + [(None, extra[0][1])])
    seen, want = set(), Counter()
    for r in sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id):
        if r.text is None:
            want[r.doc_id, None] += 1
            continue
        keep = []
        for c in linededup.chunks(r.text.encode()):
            raw = b"\n".join(c)
            if len(c) > 1 and raw in seen:
                continue
            if len(c) > 1:
                seen.add(raw)
            keep.append(raw)
        want[r.doc_id, b"\n".join(keep).decode()] += 1
    got = linededup.dedup(docs)
    assert rows(got, "doc_id", "text") == want
    assert got.columns == [*docs.columns, *linededup.added_names(docs.columns)]
    assert {(r._s, r._gone, r._chunks) for r in got.collect()} == {tuple(map(CLASHING.index, ("_s", "_gone", "_chunks")))}
    assert linededup.dedup(empty(spark)).count() == 0


# --- sharding


def test_sharding(spark):
    docs = table(spark)
    names = sharding.added(docs.columns)
    assert names == ("_shard_", "_bucket_", "_place_")
    out = sharding.slots(sharding.write(docs, scratch(spark, "t3"), 4, bucket_bytes=1 << 16), names).collect()
    assert Counter((r.doc_id, r.text, r._shard, r._place) for r in out) == rows(docs, "doc_id", "text", "_shard", "_place")
    for s in range(4):
        assert sorted(r.slot for r in out if r._shard_ == s) == list(range(sum(r._shard_ == s for r in out)))
    again = sharding.slots(sharding.write(docs.repartition(5), scratch(spark, "t3"), 4, bucket_bytes=1 << 16), names)
    assert Counter((r.doc_id, r.text, r._shard_, r.slot) for r in out) == rows(again, "doc_id", "text", "_shard_", "slot")
    grown = spark.range(2000).select(sharding.highest(F.col("id"), 8, 1).alias("a"), sharding.highest(F.col("id"), 9, 1).alias("b")).collect()
    assert all(r.b in (r.a, 8) for r in grown) and 100 < sum(r.b == 8 for r in grown) < 350
    assert sharding.slots(sharding.write(empty(spark), scratch(spark, "t3"), 4), names).count() == 0


def test_sharding_is_the_definition(spark):
    """Shard, bucket and place of every row by plain Python: chained XXH64 of id, shard and
    seed, and a shuffle that swaps from the end."""
    import struct

    import xxhash

    def chained(*parts):
        h = 42
        for x in parts:
            if x is not None:
                data = x if isinstance(x, bytes) else struct.pack(*x)
                h = xxhash.xxh64_intdigest(data, h)
        return h - (1 << 64) if h >> 63 else h

    data = [(i, t) for i, t in enumerate(TEXTS)] + [(None, EN), (None, None), (5, EN), (5, EN)] + [(100 + i, f"text {i} " * 40) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    shards, seed, most = 3, 11, 8 << 10
    total = sum(len((t or "").encode()) + 1 for _, t in data)
    per = -(-total // (shards * most))
    buckets = {}
    for i, t in data:
        key = None if i is None else ("<q", i)
        s = max((chained(key, ("<i", k), ("<i", seed)), k) for k in range(shards))[1]
        b = chained(key, None if t is None else t.encode(), ("<i", seed + 1)) % per
        buckets.setdefault((s, b), []).append((i, t))
    want, slot = [], dict.fromkeys(range(shards), 0)
    for s, b in sorted(buckets):
        rows_ = sorted(buckets[s, b], key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))  # nulls last
        draws = np.random.default_rng([seed, s, b]).random(len(rows_))
        order = list(range(len(rows_)))
        for k in range(len(rows_) - 1, 0, -1):
            j = int(draws[k] * (k + 1))
            order[k], order[j] = order[j], order[k]
        for k in order:
            want.append((*rows_[k], s, slot[s]))
            slot[s] += 1
    got = sharding.slots(sharding.write(docs, scratch(spark, "t3b"), shards, bucket_bytes=most))
    assert rows(got, "doc_id", "text", "_shard", "slot") == Counter(want)


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    counts = Counter(tuple(sharding.fisher_yates(3, rng)) for _ in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1200


# --- language identification


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a"], 3)
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces.pieces) + 2, 2))
    prob[pieces.none] = 0

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for k in range(1, min(3, len(word)) + 1):
            if word[:k] in pieces.pieces:
                out += prob[pieces.pieces.index(word[:k]), lang] * total(word[k:], lang)
            elif k == 1:
                out += prob[pieces.odd, lang] * total(word[1:], lang)
        return out

    for word in ("▁aba", "▁xyab", "▁babab", "▁" + "ab" * 12):
        got = np.exp(langid.forward(pieces.lattice([word]), prob)[0])
        assert np.allclose(got, [total(word, 0), total(word, 1)])


def test_language(spark):
    train = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(train, langid.pieces_path())
    assert model.langs == ["de", "en"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(table(spark), model).collect()}
    assert got[5, EN][0] == "en" and got[7, TEXTS[7]][0] == "de"
    for t in (None, "", " \n\t ", "12 34 ###"):
        assert got[TEXTS.index(t), t] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.learn(train.where("false"), langid.pieces_path())
    assert {r.lang_pred for r in langid.predict(table(spark), none).collect()} == {"und"}


def splits(word, longest):
    if not word:
        yield []
        return
    for k in range(1, min(longest, len(word)) + 1):
        for rest in splits(word[k:], longest):
            yield [word[:k], *rest]


def test_expected_counts_by_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba", "▁", "▁a"], 3)
    p = np.random.default_rng(2).random(len(pieces.pieces) + 2)
    p[pieces.none] = 0
    at = lambda x: pieces.pieces.index(x) if x in pieces.pieces else pieces.odd if len(x) == 1 else None
    for words in (["▁abab", "▁xbab"], ["▁aba"]):
        want, weight = np.zeros(len(p)), np.arange(1, len(words) + 1) * 2.0
        for w, n in zip(words, weight, strict=True):
            ways = [[at(x) for x in s] for s in splits(w, 3)]
            ways = [(s, np.prod(p[s])) for s in ways if None not in s]
            total = sum(x for _, x in ways)
            for s, x in ways:
                np.add.at(want, s, n * x / total)
        got = langid.expected(pieces.lattice(words), p, weight)
        assert np.allclose(np.delete(got, pieces.none), np.delete(want, pieces.none))


def test_predictions_by_all_segmentations(spark):
    """The language and score of every text, from the sums over all ways to cut its words."""
    pieces = langid.Pieces(["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁c"], 3)
    model = langid.fit({"x": {"ab": 5, "abc": 2, "b": 1}, "y": {"cb": 4, "c": 3, "bca": 2}}, pieces)
    texts = ["ab ab abc", "c bca", "abc cb c", "B C", "ab\nxyz", "12", "", None, "bcbcbcb a"]
    at = lambda x: pieces.pieces.index(x) if x in pieces.pieces else pieces.odd if len(x) == 1 else None

    def score(text):
        words = ["▁" + w for w in (text or "").lower().split()] if re.search("[a-z]", (text or "").lower()) else []
        if not words:
            return "und", 0.0
        logs = np.zeros(2)
        for w in words:
            ways = [[at(x) for x in s] for s in splits(w, 3)]
            logs += np.log(sum(np.prod(model.prob[s], axis=0) for s in ways if None not in s))
        p = np.exp(logs - logs.max())
        return "xy"[p.argmax()], p.max() / p.sum()

    got = langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        lang, value = score(r.text)
        assert r.lang_pred == lang and abs(r.score - value) < 1e-9


def test_a_very_long_word():
    pieces = langid.Pieces(langid.vocabulary(langid.pieces_path()))
    model = langid.fit({"de": {"hund": 3, "katze": 2}, "en": {"dog": 3, "cat": 2}}, pieces)
    word = langid.START + "dogcat" * 20_000
    got = model.words([word, langid.START + "dog"])
    assert np.allclose(got[0], sum(model.words([word[a : a + langid.STRETCH]])[0] for a in range(0, len(word), langid.STRETCH)))
    assert np.allclose(got[1], langid.forward(pieces.lattice([langid.START + "dog"]), model.prob)[0])


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op4(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0


# --- embeddings


@pytest.mark.parametrize("region,part", [(16_384, 32_768), (20, 7)])
def test_embeddings(spark, monkeypatch, region, part):
    """Against all pairs: also in many regions cut into parts, and with vectors of several lengths."""
    monkeypatch.setattr(embeddings, "REGION", region)
    monkeypatch.setattr(embeddings, "HOME_PART", part)
    monkeypatch.setattr(embeddings, "VISIT_PART", part * 2)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    vectors = [base[i % 60] + rng.normal(size=12) * 0.12 * (i >= 60) for i in range(180)] + [base[0] * 3, base[0], base[0]]
    vectors += [v * 2 for x in base[:3, :11] for v in (x, np.append(x, 0.0))] + [base[0, :11], base[1, :5], base[1, :5] * 4, base[1, :1], -base[1, :1] * 2]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, [1.0, 2.0, 3.0]), (504, [None] * 12), (None, data[0][1]), (505, [float("inf")] + [1.0] * 11), (506, [])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")).collect()}

    def linked(i, j):
        a, b = np.array(data[i][1]), np.array(data[j][1])
        return len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    want = components(range(len(data)), linked)
    for i in range(len(data)):
        links = sum(linked(i, j) for j in range(len(data)) if j != i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, want[i], want[i] == i)
    for i, _ in odd:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_placing_vectors_in_cells():
    """Who is near enough to a home vector visits its cell; 4,000 vectors take a second or so
    (seconds more by differences of all components)."""
    rng = np.random.default_rng(4)
    v = embeddings.unit(rng.normal(size=(4000, 64)))
    v[2000:] = embeddings.unit(v[:2000] + rng.normal(size=(2000, 64)) * 0.03)
    cells = embeddings.Cells(v[rng.permutation(4000)[:1024]], embeddings.rotation(64, 3), 4, 0.1, 5)
    x = embeddings.rotated(v, cells.rot)
    began = time.process_time()
    home, homes, goes = cells.placed(x)
    assert time.process_time() - began < 3
    near = 0
    for b, dims in enumerate(cells.dims):
        y = x[:, dims]
        _, seen = cells.visits(y, b)
        for i in range(2000):
            for one, other in ((i, 2000 + i), (2000 + i, i)):
                if ((y[one] - y[other]) ** 2).sum() <= cells.share[b] and home[one, b] <= home[other, b]:
                    near += 1
                    assert seen[other, home[one, b]] and goes[other, cells.region[b][home[one, b]]]
        assert homes[np.arange(4000), cells.region[b][home[:, b]]].all()
    assert near > 1000


@pytest.mark.parametrize("threshold", [0.95, 0.3])
def test_embeddings_against_all_pairs(spark, sf_mid, threshold):
    """The whole table; it has links at the lower threshold only."""
    docs = spark.read.parquet(f"{sf_mid}/embeddings.parquet")
    rows = docs.orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= threshold
    got = (embeddings.op5(spark, sf_mid) if threshold == 0.95 else embeddings.near_duplicates(docs, threshold=threshold)).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == (near.sum(1) - 1).tolist() and (threshold == 0.95 or sum(r.n_links for r in got) > 0)
    want = components([r.vec_id for r in rows], lambda i, j: near[i, j])
    assert [r.component_id for r in got] == [rows[i].vec_id for i in want]


# --- quality rules


def brute_statistics(text):
    words, lines = re.findall("[^\x20\x09-\x0d]+", text or ""), (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_statistics(spark):
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(["a", "b", "é", "#", " ", "\n", "\t", "\x1c", "\xa0"]) for _ in range(r.randrange(80)))
        assert quality.measure(t.encode())[:5] == brute_statistics(t)
    got = rows(quality.statistics(table(spark)), "doc_id", *quality.COUNTS[:5])
    assert got == Counter((x.doc_id, *brute_statistics(x.text)) for x in table(spark).collect())


def test_decision_list_learns_a_planted_rule():
    rng = np.random.default_rng(0)
    x = {"symbols": rng.random(3000), "upper": rng.random(3000), "words": rng.random(3000)}
    bad = (x["symbols"] > 0.8) | ((x["upper"] > 0.7) & (x["words"] <= 0.4))
    rules = quality.learn(x, bad, rng.random(3000) < 0.33)
    said = np.zeros(3000, bool)
    for rule in rules.rules:
        said |= quality._covers(rule, x, 3000)
    assert (said == bad).mean() > 0.97 and len(rules.rules) <= 5


def test_quality(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (6, None), (None, 0), (11, 0)], "doc_id long, quality int")
    got = quality.judged(table(spark), labels).collect()
    assert len(got) == table(spark).count()
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(empty(spark), labels.where("false")).count() == 0


def test_verdicts_by_the_rules(spark, sf_mid, monkeypatch):
    """kept of every document of a table: base rules, then the learned list, in plain Python."""
    found = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    got = {r.doc_id: r for r in quality.op6(spark, sf_mid).collect()}
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text").collect()
    rules, bad = found[0].rules, 0
    assert rules and len(got) == len(docs)
    for d in docs:
        m = dict(zip(quality.COUNTS, quality.measure((d.text or "").encode()), strict=True))
        assert [m[c] for c in quality.COUNTS[:5]] == list(brute_statistics(d.text))
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        x = {n: float(m[a]) if b is None else (m[a] / m[b] if m[b] else 0.0) for n, (a, b) in quality.FEATURES.items()}
        verdict = any(all((x[t.name] > t.at) == t.above for t in rule) for rule in rules)
        bad += verdict and not failed
        r = got[d.doc_id]
        assert (r.base_failed, r.kept) == (failed, not failed and not verdict)
    assert bad > 0


# --- mixing


def test_mixing_weights(spark):
    totals = spark.createDataFrame([("a", 7000), ("b", 2000), ("c", 1000), (None, 0)], "source string, tokens long")
    got = {r.source: r for r in mixing.weights(totals, 0.95, None, None).collect()}
    w = np.array([got[s].weight for s in "abc"])
    assert abs(-(w * np.log(w)).sum() - 0.95 * np.log(3)) < 1e-6 and abs(w.sum() - 1) < 1e-9
    assert min(got[s].repeats for s in "abc") == pytest.approx(1) and got[None].repeats == 1
    limited = {r.source: r for r in mixing.weights(totals, None, 2.0, 10_000.0).collect()}
    assert max(r.repeats for r in limited.values()) == pytest.approx(2, abs=1e-6)


@pytest.mark.parametrize("budget", [None, 3000.0])
def test_mixing(spark, budget):
    r = random.Random(0)
    docs = table(spark, [(i, "w " * r.randrange(1, 40)) for i in range(400)] + [(None, None), (700, "")])
    got = mixing.mix(docs, 0.9, 3.0, budget, block_tokens=100).collect()
    use = Counter()
    for x in got:
        use[x.source] += x.n_tokens
        assert 0 <= x.position <= 1 + 1e-9
    weight = {x.source: x.weight for x in got}
    total = sum(use.values())
    for s, w in weight.items():
        assert abs(use[s] - w * total) <= 80 or w == 0
    if budget is None:
        assert {x.doc_id for x in got} == {x.doc_id for x in docs.collect()}
    else:
        assert abs(total - budget) < 200
    taken = mixing.take(docs, mixing.mix(docs, 0.9, 3.0, budget, block_tokens=100))
    assert rows(taken, "doc_id") == Counter((x.doc_id,) for x in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(mixing.ORACLE)
    names = [x[0] for x in cur.description]
    got = mixing.op7(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(cur.fetchall()) == rows(got, *names)


# --- SimHash


def test_simhash_is_the_definition():
    import xxhash

    for t in TEXTS + ["A b C d", "x y"]:
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        assert simhash.simhash(None if t is None else t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_references_tell_groups_apart():
    base, near, _ = simhash.references()
    masks = [{(base ^ r).bit_length() and base ^ r for r in g} for g in near]
    assert all(len(m) == 8 for m in masks) and sum(max(m, key=int.bit_count) for m in masks) == (1 << 64) - 1


@pytest.mark.parametrize("n", [3, 400, 3000])
def test_links_among(n):
    r = random.Random(n)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in r.sample(range(14), r.randrange(14))) for _ in range(n)})
    refs = np.array(simhash.references()[2], np.uint64)
    got = simhash.links_among(np.array(fps, np.uint64), refs)
    assert len(got) < len(fps) and all((fps[i] ^ fps[j]).bit_count() <= 2 for i, j in got)
    parent = list(range(len(fps)))
    for i, j in got:
        a, b = parent[i], parent[j]
        parent = [a if x == b else x for x in parent]
    bits = np.array(fps, np.uint64)
    for i in range(0, len(fps), 7):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2).tolist():
            assert parent[i] == parent[j]


def test_near_links(spark):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for f in fps for _ in range(3)]
    fps += [f ^ 1 << r.randrange(64) for f in fps[40:60]]
    fps += [fps[0] ^ r.getrandbits(64) & 0x1111111111 for _ in range(200)]  # one large group
    want = components(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    links = simhash.similar_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"))
    pairs = {(r.src, r.dst) for r in links.collect()}
    at = {simhash._signed(f): i for i, f in enumerate(fps)}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in pairs)
    linked = {(at[a], at[b]) for a, b in pairs}
    got = components(fps, lambda i, j: (i, j) in linked or (j, i) in linked or fps[i] == fps[j])
    assert [want.index(x) for x in want] == [got.index(x) for x in got]


def test_near_duplicates(spark):
    docs = table(spark)
    got = simhash.near_duplicates(docs).collect()
    data = [(r.doc_id, simhash.simhash((r.text or "").encode())) for r in docs.collect()]
    roots = components(data, lambda i, j: (data[i][1] ^ data[j][1]).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(data, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(r)) for (i, _), r in zip(data, roots, strict=True))
    assert simhash.near_duplicates(empty(spark)).count() == 0


# --- byte-level BPE


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.Encoder(ranks, P.PATTERN)
    r = random.Random(1)
    texts = [x or "" for x in TEXTS] + ["".join(r.choice(" \n\t\x1c\x85\xa0 aé日's9٣_-ªⅷ½aaaa zżx​") for _ in range(r.randrange(60))) for _ in range(1500)] + ["a" * n for n in range(40)]
    units = [enc.units(x) for x in texts]
    enc.learn(units)
    for x, u in zip(texts, units, strict=True):
        at = enc.at(u)
        assert (enc._many(np.array(at, np.int64)).tolist() if at else []) == t.encode_ordinary(x), x


def test_merge_replay_follows_the_definition_for_any_ranks():
    """Rank files where a later token's parts may come before it or not."""
    r = random.Random(4)
    for _ in range(60):
        tokens = {bytes([i]) for i in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randrange(2, 5))) for _ in range(25)}
        order = [bytes([i]) for i in range(256)] + r.sample(sorted(x for x in tokens if len(x) > 1), sum(len(x) > 1 for x in tokens))
        replay = bpe.MergeReplay({x: i for i, x in enumerate(order)})
        words = list({bytes(r.choice(b"abc") for _ in range(r.randrange(1, 14))) for _ in range(40)})
        ids, offsets = replay.encode(words)
        for i, w in enumerate(words):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == replay.one(w)


def test_one_word_follows_the_definition_and_is_fast():
    import time

    r = random.Random(5)
    replay = bpe.MergeReplay(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    ranks = {t: i for i, t in enumerate(replay.token)}
    for n in (0, 1, 2, 30, 200):
        word = bytes(r.choice(b"abcdeinst") for _ in range(n))
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert replay.one(word) == [ranks[p] for p in parts]
    word = bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    began = time.time()
    ids, _ = replay.encode([word, b"other"])
    assert time.time() - began < 60 and b"".join(replay.token[i] for i in ids.tolist()) == word + b"other"


def test_bpe_round_trip(spark):
    import hashlib

    docs = table(spark)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, P.PATTERN)
    back = Counter((r.doc_id, bytes(r.data)) for r in bpe.decode_ids(encoded, path).collect())
    assert back == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = Counter((r.doc_id, len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in encoded.collect())
    assert rows(bpe.production(docs), "doc_id", "n_tokens", "ids_sha256") == want
    assert rows(bpe.production(docs), "doc_id", "decoded_sha256") == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert bpe.production(empty(spark)).count() == 0


def test_bpe_bounds_what_a_worker_holds():
    """Of a batch of 8 MB of rare words only some MB are laid out at a time (the whole batch at once: 174 MB)."""
    import tracemalloc

    r, path = random.Random(5), P.path("byte_bpe_multi_50k.tiktoken")
    words = ["".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(150_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(450)), pa.array([" ".join(r.choices(words, k=2000)) for _ in range(449)] + [None])], names=["id", "t"])
    enc, sizes = bpe.encoder(path, P.PATTERN), []
    enc.clear()
    tracemalloc.start()
    for ids, at, _ in bpe._encoded(iter([batch]), path, P.PATTERN):
        sizes.append(len(ids))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    enc.clear()
    assert sum(sizes) == 450 and peak < 135 and len(sizes) > 1, (sizes, peak)


# --- substring dedup


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edits():
    r = random.Random(0)
    for _ in range(800):
        a = [r.randrange(3) for _ in range(r.randrange(14))]
        b = [r.randrange(3) for _ in range(r.randrange(14))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8]
        most = r.randrange(1, 8)
        assert substrings.edits(a, b, most) == min(levenshtein(a, b), most + 1)
        assert substrings.greedy_edits(a, b, most) >= min(levenshtein(a, b), most + 1)


def test_minima_of_windows():
    rng = np.random.default_rng(0)
    for n in (0, 3, 4, 5, 60):
        for width in (1, 2, 4, 7, 16):
            code = rng.permutation(n).astype(np.uint64) + np.uint64(5)
            want = sorted({a + int(code[a : a + width].argmin()) for a in range(n - width + 1)})
            assert substrings._minima(code, width).tolist() == want


def test_chains_are_optimal():
    from itertools import combinations

    r = random.Random(0)
    for _ in range(200):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 7))})
        best = max(8 * len(c) - substrings.GAP * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(c, c[1:], strict=False)) for k in range(1, len(pts) + 1) for c in combinations(pts, k) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False)))
        c = substrings.chains([p[0] for p in pts], [p[1] for p in pts], 8)[0]
        assert abs(8 * c[4] - substrings.GAP * (c[1] - 8 - c[0] + c[3] - 8 - c[2]) - best) < 1e-9


def test_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(70)]
    fuzzy = [w if i % 24 else word() for i, w in enumerate(shared * 2)]
    docs = [[word() for _ in range(r.randrange(60, 200))] for _ in range(30)]
    for i in (4, 9, 17, 25):
        docs[i][30:30] = shared
    docs[20][10:10] = fuzzy
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(100, " ".join(docs[3])), (101, None), (102, ""), (103, "of of " * 100), (104, "x " + "of of " * 90), (None, " ".join(docs[5]))]
    found = substrings.passages(table(spark, texts)).collect()
    hit = {(f.id, f.other_id) for f in found}
    assert {(9, 4), (17, 4), (25, 4), (20, 4), (100, 3), (104, 103), (5, None)} <= hit
    assert {f.id for f in found} == {9, 17, 25, 20, 100, 104, 5}
    for f in found:
        assert f.end - f.start >= 50 and f.share >= 0.8
    exact = next(f for f in found if (f.id, f.other_id) == (17, 4))
    assert (exact.start, exact.end) == (30, 100)
    spans = substrings.passages(table(spark, texts))
    left = {r.doc_id: r.text for r in substrings.cut_out(table(spark, texts), spans).collect()}
    assert left[4] == texts[4][1] and left[17].split() == docs[17][:30] + docs[17][100:] and left[100] == ""
    assert substrings.passages(empty(spark)).count() == 0


@pytest.mark.parametrize("length,apart", [(60, 40), (100, 300)])
def test_passages_with_an_unlike_middle(spark, length, apart):
    r = random.Random(6)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    head, foot = words(length), words(length)
    docs = [(i, " ".join(words(30) + head + words(apart) + foot + words(30))) for i in range(3)]
    found = substrings.passages(table(spark, docs)).collect()
    at = 30 + length + apart
    assert {(f.id, f.start, f.end, f.other_start, f.share) for f in found} == {(i, a, a + length, a, 1.0) for i in (1, 2) for a in (30, at)}


def test_one_chunk_in_most_rows(spark, monkeypatch):
    """A common chunk is dealt to several tasks; all but the first go."""
    common = "\n".join(f"common {k}" for k in range(6))
    data = [(i, f"own {i}\nmine {i}\n{common}\n" + "\n".join(f"after {i} {k}" for k in range(4))) for i in range(600)] + [(i, None) for i in range(600, 610)]
    docs = table(spark, data)
    plain = rows(linededup.dedup(docs, runs=True), "doc_id", "text")
    real = linededup.repeats
    monkeypatch.setattr(linededup, "repeats", lambda *a, **k: real(*a, **k, deal=50))
    got = linededup.dedup(docs, runs=True)
    assert rows(got, "doc_id", "text") == plain
    want = Counter((i, t if t is None or i == 0 else t.replace(common + "\n", "")) for i, t in data)
    assert plain == want


def test_line_runs_across_cuts(spark):
    """Every run of two lines or more that stands earlier goes whole, wherever cuts fall."""
    r = random.Random(8)
    blocks = [[f"block {b} line {i}" for i in range(n)] for b, n in enumerate([2, 2, 2, 3, 3, 4, 5])]
    data = []
    for i in range(40):
        text = [f"own {i} {k}" for k in range(3)]
        for b in r.sample(range(len(blocks)), 3):
            text += [*blocks[b], f"own {i} after {b}"]
        data.append((i, "\n".join(text)))
    data += [(100, "a\na\na\na\na"), (101, "x\nlone"), (102, "lone\ny"), (103, None), (104, data[3][1]), (None, data[4][1])]
    seen, want = {}, Counter()
    for i, t in sorted(data, key=lambda d: -1 if d[0] is None else d[0]):
        if t is None:
            want[i, t] += 1
            continue
        lines = t.split("\n")
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            doc, at = seen.setdefault(pair, (i, k))
            if doc != i or k >= at + 2:
                gone |= {k, k + 1}
        want[i, "\n".join(x for k, x in enumerate(lines) if k not in gone)] += 1
    got = linededup.dedup(table(spark, data), runs=True)
    assert rows(got, "doc_id", "text") == want
    assert {x.doc_id: x._removed_lines for x in got.collect()}[104] == len(data[3][1].split("\n"))


def test_passage_with_one_seed_left(spark):
    """60 words of which seven differ: only in their run of 23 equal words a seed is sure, one."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for i in range(40):
        shared = words(60)
        other = [w if k % 6 or k in (24, 30, 36) else words(1)[0] for k, w in enumerate(shared)]
        docs += [(2 * i, " ".join(words(40) + shared + words(40))), (2 * i + 1, " ".join(words(40) + other + words(40)))]
    found = substrings.passages(table(spark, docs)).collect()
    assert all(f.id == f.other_id + 1 and f.share >= 0.8 and f.end - f.start >= 50 for f in found)
    assert {f.id for f in found} == set(range(1, 80, 2))


def edited(r, words, share, regular):
    """words with a share of them replaced: every n-th, or at random."""
    n = len(words)
    at = range(round(1 / share) - 1, n, round(1 / share)) if regular else r.sample(range(n), int(share * n))
    out = list(words)
    for i in at:
        out[i] = "".join(r.choice("abcdefghij") for _ in range(6))
    return out


@pytest.mark.parametrize("regular", [False, True])
def test_recall_of_edited_passages(spark, regular):
    """Passages of 120 words, 5 to 20 in 100 of them replaced, in 40 pairs of documents each:
    at least nine in ten are found at each rate, and nothing between unlike documents."""
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs, rate = [], {}
    for share in (0.05, 0.1, 1 / 8, 0.15, 1 / 6, 0.2):
        for _ in range(40):
            passage = words(120)
            i = len(docs)
            docs += [(i, " ".join(words(80) + passage + words(80))), (i + 1, " ".join(words(50) + edited(r, passage, share, regular) + words(90)))]
            rate[i + 1] = share
    found = {f.id: f for f in substrings.passages(table(spark, docs)).collect()}
    assert all(f.id == f.other_id + 1 and f.end - f.start >= 50 and f.share >= 0.8 - 1e-9 for f in found.values())
    hits = Counter(rate[i] for i in found)
    assert all(hits[s] >= 36 for s in set(rate.values())), hits


def test_longest_part():
    r = random.Random(3)
    for _ in range(300):
        mark = [int(r.random() < 0.75) for _ in range(r.randrange(30))]
        spans = [(z - a, -a) for a in range(len(mark)) for z in range(a + 1, len(mark) + 1) if sum(mark[a:z]) >= 0.8 * (z - a) - 1e-9]
        a, z = substrings.longest_part(mark, 0.8)
        assert z - a == max(spans, default=(0, 0))[0] and (z == a or sum(mark[a:z]) >= 0.8 * (z - a) - 1e-9)


def test_a_passage_runs_on_beyond_the_margin(spark):
    """With few words fetched at first, the whole passage is found all the same."""
    r = random.Random(12)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared = words(400)
    docs = table(spark, [(0, " ".join(words(300) + shared + words(20))), (1, " ".join(words(10) + shared + words(500))), (2, " ".join(shared))])
    got = {(f.id, f.other_id, f.start, f.end, f.other_start) for f in substrings.passages(docs, margin=1, rate=40).collect()}
    assert got == {(1, 0, 10, 410, 300), (2, 0, 0, 400, 300)}


def test_one_seed_in_most_rows(spark, monkeypatch):
    """A passage in every document, its seeds and the first document's words dealt to several tasks."""
    real = substrings._aligned
    monkeypatch.setattr(substrings, "_aligned", lambda *a: real(*a, most=9))
    r = random.Random(13)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared = words(60)
    docs = table(spark, [(i, " ".join(words(20) + shared + words(20))) for i in range(120)])
    got = {(f.id, f.other_id, f.start, f.end) for f in substrings.passages(docs, deal=10).collect()}
    assert got == {(i, 0, 20, 80) for i in range(1, 120)}


@pytest.mark.parametrize("regular", [False, True])
def test_no_passage_at_the_threshold_is_lost(spark, regular):
    """Passages of 50 words of which ten differ, and of 90 of which 18 do, in 40 pairs each: all are found."""
    r = random.Random(14)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs = []
    for size in [50] * 40 + [90] * 40:
        passage = words(size)
        at = range(2, size, 5) if regular else r.sample(range(1, size - 1), size // 5)
        other = [words(1)[0] if i in at else w for i, w in enumerate(passage)]
        i = len(docs)
        docs += [(i, " ".join(words(60) + passage + words(70))), (i + 1, " ".join(words(30) + other + words(40)))]
    found = substrings.passages(table(spark, docs)).collect()
    assert all(f.id == f.other_id + 1 and f.share >= 0.8 - 1e-9 and f.end - f.start >= 50 for f in found)
    assert {f.id for f in found} == set(range(1, 160, 2))


def test_a_first_occurrence_hides_no_passage(spark):
    """Document 0 has each four words in a row of every passage, and in documents 1 and 2 each 40, but
    no passage; the others share passages, equal and edited, and are linked all the same."""
    r = random.Random(15)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    pieces, longer, docs = [], [[], []], []
    for i in range(10):
        passage = words(60)
        for a in range(57):
            pieces += passage[a : a + 4] + words(1)
        for a in (0, 20):
            longer[a > 0] += passage[a : a + 40] + words(30)
        other = [words(1)[0] if i % 2 and a % 6 == 5 and a < 59 else w for a, w in enumerate(passage)]
        docs += [(10 + 2 * i, " ".join(words(30) + passage + words(30))), (11 + 2 * i, " ".join(words(20) + other + words(50)))]
    docs += [(0, " ".join(pieces)), (1, " ".join(longer[0])), (2, " ".join(longer[1]))]
    found = {(f.id, f.other_id) for f in substrings.passages(table(spark, docs)).collect()}
    assert found == {(11 + 2 * i, 10 + 2 * i) for i in range(10)}


def test_equal_runs_in_many_documents(spark):
    """Seeds of more documents than are compared in pairs: runs of 50 equal words are found though
    the first documents have 49 of them at most."""
    r = random.Random(16)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    shared = words(98)
    docs = [(i, " ".join(words(20) + shared[49 * (i % 2) :][:49] + words(20))) for i in range(40)]
    docs += [(100 + i, " ".join(words(20) + shared[24:74] + words(20))) for i in range(3)] + [(200, " ".join(shared[24:74])), (300, " ".join(shared[24:74]))]
    found = {(f.id, f.start, f.end) for f in substrings.passages(table(spark, docs), full=4).collect()}
    assert found == {(101, 20, 70), (102, 20, 70), (200, 0, 50), (300, 0, 50)}


def test_seeds_of_blocks_are_those_of_texts():
    """Many texts at once have the seeds that the definition gives for each of them."""
    r = random.Random(17)
    seps = [" ", "\n", "\t\x0b", "  ", "\r\x0c"]
    texts = ["", " ", "A b", "of " * 70, "\xa0 é " * 45, "x" * 700 + " " + "of the " * 50]
    texts += ["".join(r.choice("abAB") + r.choice(seps) for _ in range(r.randrange(30, 90))) + r.choice(["", " ", "end"]) for _ in range(60)]
    find = substrings.Seeds(4, 1, 16, 50, 0.8)
    known = {}
    for most in (1, 300, 1 << 19):
        at = 0
        for i, data, bounds in substrings._blocks(pa.array([t.encode() for t in ["cut off", *texts]], pa.binary())[1:], most):
            assert i == at
            at += len(bounds) - 1
            hashes, place, code, text, start, end = find.codes(data, bounds)
            words = [t.encode().lower().split() for t in texts[i:at]]
            assert len(hashes) == sum(map(len, words))
            assert all(known.setdefault(w, h) == h for w, h in zip((w for t in words for w in t), hashes.tolist(), strict=True))
            want = [(j, tuple(t[a : a + 4])) for j, t in enumerate(words) if len(t) >= 40 for a in range(len(t) - 3)]
            assert text.tolist() == [j for j, _ in want]
            assert all(known.setdefault(w, c) == c for (_, w), c in zip(want, code.tolist(), strict=True))
            assert all((text[a:z] == text[a]).all() and (z == len(text) or text[z] != text[a]) for a, z in zip(start.tolist(), end.tolist(), strict=True))
        assert at == len(texts)
    assert len(set(known.values())) == len(known)


def test_common_seeds_near_a_match_count_where_both_have_them(spark):
    """Seeds of many documents beside one of two: they make up for missing ones only in a pair that has
    the same ones. Passages are found that have common phrases in them, and pairs with unlike ones not aligned."""
    r = random.Random(18)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    phrases = [words(10) for _ in range(4)]
    docs = [(1000 * p + i, " ".join(words(30) + phrases[p] + words(30))) for p in range(4) for i in range(30)]
    asked = []
    for i in range(20):
        passage = [w for p in phrases for w in [*p, *words(4)]][:-4]
        docs += [(9000 + 4 * i, " ".join(words(20) + passage + words(20))), (9001 + 4 * i, " ".join(words(9) + passage + words(60)))]
        own = words(5)
        docs += [(9002 + 4 * i, " ".join(words(20) + phrases[0] + own + words(40))), (9003 + 4 * i, " ".join(words(20) + phrases[2] + own + words(40)))]
    real = substrings._aligned
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substrings, "_aligned", lambda rows, found, *a: asked.extend((c.sig, c.osig) for c in found.collect()) or real(rows, found, *a))
        found = {(f.id, f.other_id) for f in substrings.passages(table(spark, docs)).collect()}
    assert {(9001 + 4 * i, 9000 + 4 * i) for i in range(20)} <= found
    sig = {s.doc_id: s.s for s in table(spark, docs).selectExpr("doc_id", "xxhash64(doc_id, text) AS s").collect()}
    assert not {(sig[9003 + 4 * i], sig[9002 + 4 * i]) for i in range(20)} & set(asked)


def test_the_bit_map_grows_with_the_hashes(spark):
    """At 6 GB some 160 million hashes repeat, of which a map of 2 ** 28 bits tells little: most of it is set."""
    assert all(2 ** substrings._bits(n) >= 8 * n for n in (0, 1000, 7_588_330, 33_000_000, 160_000_000, 2_000_000_000))
    assert 2 ** substrings._bits(7_588_330) == 1 << 28


def test_what_all_tasks_get_may_be_a_file(spark, monkeypatch):
    """Bit maps and numbers of documents sent as files give the same passages, with null ids and equal ones too."""
    r = random.Random(19)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passages = [words(60) for _ in range(5)]
    docs = table(spark, [(None if i == 3 else i // 2, " ".join(words(20) + passages[i % 5] + words(20))) for i in range(40)])
    want = sorted(substrings.passages(docs).collect(), key=str)
    asked = []
    real = substrings.SparkFiles
    monkeypatch.setattr(substrings, "LARGE", 0)
    monkeypatch.setattr(substrings._Sent, "send", lambda self, f=substrings._Sent.send: asked.append(self.name) or f(self))
    got = sorted(substrings.passages(docs).collect(), key=str)
    assert got == want and len(got) == 5 * 28
    assert len(asked) == 2 and all(real.get(n) for n in asked)

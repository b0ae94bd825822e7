import random

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "byte_bpe"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == COLUMNS
            assert docs.select("doc_id").exceptAll(before.select("doc_id").distinct()).count() == 0 or i == 3
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_and_odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, "the same words here", "en", "s", 19), (3, "the same words here", "en", "s", 19)]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == (1 if data else 0)


def test_mixing_keeps_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.mixture(spark, docs, sf).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and max(r.n for r in got) <= 2


def test_simhash_stage_reaches_jaccard(spark):
    """Edited copies at 0.8 or more go, also from a group too large for pairs; at less they stay."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    data = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(60, 300))]
        data.append(base)
        for _ in range(3):
            copy = list(base)
            for i in r.sample(range(len(copy)), max(1, len(copy) * r.randrange(1, 7) // 200)):
                copy[i] = word()
            data.append(copy)
    base = [word() for _ in range(200)]
    data += [[*base[:i], word(), *base[i + 1 :]] for i in range(100)]
    sets = [shingles(t) for t in data]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(root) and 25 < len(got) < 100


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", None, "s", 19), (2, None, None, "s", 0), (3, "12 34 ###", None, "s", 9), (4, "été", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {1, 4}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    """One row of each group stays: rows with one id and unlike texts are two groups, and a
    null id doesn't keep a copy."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    data = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " x", "en", "s", 1), (None, a, "en", "s", 1), (None, "only here", "en", "s", 1), (1, a, "en", "t", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "only here"), (1, a), (1, b)]


def test_workers_keep_one_stage_only():
    """A stage's words go when another stage's function begins in the same worker, not its own."""
    from isogon import cluster
    from isogon.llm import bpe, langid

    bpe._ENCODERS["a", "b"], langid._SCORERS["c"] = "encoder", "scorer"
    assert list(cluster.tidy(lambda batches: batches, bpe._ENCODERS)([1, 2])) == [1, 2]
    assert bpe._ENCODERS and not langid._SCORERS
    assert list(cluster.tidy(iter)([3])) == [3]
    assert not bpe._ENCODERS

"""From documents to token counts and digests, in five stages.

language ID      texts without a language (null, or no letter) go
line dedup       runs of two lines or more that were seen before are taken out of the texts
SimHash          of each group of near-duplicates (five-word shingles, Jaccard similarity
                 0.8 or more; candidates also by MinHash bands) the least id stays
mixing           sources are repeated by temperature weights, at most twice; at the
                 least budget that uses every document, so that none goes
byte-level BPE   encodes and decodes what is left: a row for each use of a document
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isogon.cluster import through_table
from isogon.llm import bpe, langid, linededup, mixing, shingles


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, langid.pieces_path())
    if not model.langs:  # no labels to learn from say nothing against a text
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model).where(F.col("lang_pred") != "und").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup(docs, runs=True).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.mix(docs, target_entropy=0.95, repetition_limit=2.0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.production(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("mixing", mixture), ("byte_bpe", tokens)]

#: Learned models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

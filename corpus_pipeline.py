"""A corpus pipeline from the training-data operators, as (name, function) stages.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage as Parquet in the shared folder and reads it back as the next input, so
a lost executor costs at most one stage. The tables that a stage makes on its way are
deleted once it is written, its result once the next stage is; other tables are not
touched, so results of other runs and queries stay readable.

1. language ID: documents without a language (null, empty or letterless text), or
   whose best language has less than ``MIN_LANGUAGE_SCORE`` of the weight, go
2. SimHash near-dedup: one document of each group stays, the smallest doc_id. Texts
   whose fingerprints (of distinct words, or of distinct pairs of words) differ in at
   most ``NEAR_BITS`` bits are candidates; two link if the Jaccard similarity of their five-word sets is
   ``NEAR_SIMILARITY`` or more
3. suffix-array dedup: strings of 200 bytes or more that occur twice are cut out
4. benchmark decontamination: documents that hold a benchmark item go
5. SentencePiece: of each kept document its id, language and source, the piece ids, the
   text that they decode to, and their number and digests
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, pieces, simhash, storage, suffix
from tidemark.llm.queries import tokenizer_path

MIN_LANGUAGE_SCORE = 0.5
NEAR_BITS = 7
NEAR_SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where("lang is not null").select("doc_id", "text", "lang"))
    lang, score = storage.unused(docs, "lang_pred", "score")
    judged = langid.predict(docs, model, *docs.columns, names=(lang, score))
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).drop(lang, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, threshold=NEAR_BITS, similarity=NEAR_SIMILARITY)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs, tokenizer_path(), *[c for c in ("doc_id", "lang", "source") if c in docs.columns], whole=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with storage.scope(spark):
            docs = storage.keep(storage.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            storage.drop(before)
        before = docs
    return docs

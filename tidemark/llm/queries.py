"""The numbered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontaminate, katz, langid, pieces, sharding, simhash, storage, suffix, topk, urls, variants, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("op1_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
    + length(text) - length(replace(text, '#', '')) AS body, length(role) + 5 + 8 AS frame FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + frame)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.lit("\\### Assistant: </turn> ok")
    record = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(
        F.struct(F.lit("user").alias("role"), told.alias("content")),
        F.struct(F.lit("assistant").alias("role"), told.alias("content"))).alias("messages"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.table_to_turns(rows).unionByName(chat.table_to_turns(record))
    return chat.digests(chat.format_turns(turns))


def held_out(parts: int, part: int) -> Column:
    """crc32 of the document's id as text, mod ``parts``, is ``part``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % parts == part


@_query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


@_query("op3_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@_query("op4_langid")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = langid.train(docs.where("lang is not null and not held_out").select("doc_id", "text", "lang"))
    return langid.predict(docs, model, "doc_id", "held_out")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The public vocabulary file named in the contract."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), "doc_id")


@_query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_read(spark, sf_dir, "documents"))


ARRIVALS = 5


@_query("op7_sharding", f"""
SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256,
  {ARRIVALS}::BIGINT AS arrivals, true AS merges_committed, true AS fewer_shards, (SELECT count(*) FROM documents) AS rows_listed FROM documents
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ``ARRIVALS`` parts by a hash of their id, more than the fan-out, so tiers fill up and merge."""
    store, docs = sharding.ShardStore(spark, storage.new_path(spark, "shards"), fanout=4), _read(spark, sf_dir, "documents")
    appended = 0
    for k in range(ARRIVALS):
        version = store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        appended = len(store.shards(version))
    version = store.compact()
    store.vacuum()
    live = store.shards(version)
    return store.read(version).select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"),
        F.lit(ARRIVALS).cast("long").alias("arrivals"), F.lit(version > ARRIVALS).alias("merges_committed"), F.lit(len(live) < appended).alias("fewer_shards"), F.lit(sum(x.rows for x in live)).cast("long").alias("rows_listed"))


@_query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: The contract's rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@_query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality").eqNullSafe(0) | F.col("toxic").eqNullSafe(1)).alias("blocked"))
    return urls.judge(_read(spark, sf_dir, "pages"), labels, URL_RULES)


@_query("op5_katz")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"), held_out(7, 2))


@_query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), 8)


def misspelt(ids: list[str], runs: list[str]) -> list[str]:
    """The contract's damage: a run loses one code point where 97 divides the checksum of ``id:run``."""
    begun = {d: zlib.crc32(f"{d}:".encode()) for d in set(ids)}
    out = list(runs)
    for i, (d, run) in enumerate(zip(ids, runs)):
        h = zlib.crc32(run.encode(), begun[d])
        if not h % 97:
            out[i] = run[: h % len(run)] + run[h % len(run) + 1 :]
    return out


@_query("op12_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.count_words(_read(spark, sf_dir, "documents"), change=misspelt))


@_query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), "doc_id")

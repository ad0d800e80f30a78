import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tidemark.llm import langid, storage
from tidemark.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `__th` int"


def test_every_stage_takes_effect(spark, tmp_path):
    r = random.Random(4)
    vocab = {"en": [f"{a}{b}" for a in ("th", "wh", "st", "ing") for b in ("e", "at", "on", "er", "is")], "fr": [f"{a}{b}" for a in ("lé", "qu", "eau") for b in ("ai", "oi", "ux", "es")]}
    text = lambda lang, n: " ".join(r.choice(vocab[lang]) + r.choice(["", "s", "ly", "ra"]) for _ in range(n))
    docs = {i: text(lang, 80) for i, lang in enumerate(["en", "fr"] * 12)}
    passage, item = text("en", 60), text("en", 20)
    clean = dict(docs)
    docs |= {30: docs[3], 31: docs[4] + " added", 32: None, 33: "", 34: "123 456 ...", 35: passage, 36: text("fr", 50)}
    docs[36] += " " + passage
    docs[5] = docs[5] + " " + item
    docs[40] = docs[6]
    docs[None] = text("en", 70)
    rows = [(i, t, ("fr" if i % 2 else "en") if i is not None and i < 24 else None, "s", 1, 0.5, 7) for i, t in docs.items()] + [(6, docs[6], "en", "s", 1, 0.5, 7)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = spark.read.parquet(str(tmp_path / "documents.parquet")).columns
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, table, str(tmp_path)).columns == columns
        assert stage(spark, table.limit(0), str(tmp_path)).collect() == []
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {x["doc_id"]: (x["n_tokens"], x["decoded_sha256"]) for x in rows}
    assert all(len(x["ids"]) == x["n_tokens"] and hashlib.sha256(x["decoded"].encode()).hexdigest() == x["decoded_sha256"] for x in rows)
    want = {i: t for i, t in clean.items() if i != 5} | {36: docs[36][: -len(passage) - 1], None: docs[None], 35: ""}
    assert set(got) == set(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for i in [0, 1, 3, 4, 6, None, 23]:
        assert got[i] == (len(sp.encode(want[i])) + 1, hashlib.sha256(want[i].encode()).hexdigest())
    assert got[35][0] < 20 and got[36][0] < len(sp.encode(docs[36])) / 1.5


def small_corpus(spark, folder):
    r = random.Random(8)
    vocab = {"en": ["the", "and", "thing", "wheat", "stone", "under"], "fr": ["les", "quai", "léger", "eaux", "fois", "sous"]}
    rows = [(i, " ".join(r.choice(vocab[k]) + r.choice(["", "s", "ly"]) for _ in range(60)), k, "s", 1) for i, k in enumerate(["en", "fr"] * 15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "no such passage anywhere in here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_results_of_other_runs_stay_readable(spark, tmp_path):
    small_corpus(spark, str(tmp_path))
    other = QUERIES["op2_simhash"](spark, str(tmp_path))  # built, not yet read
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    rows = lambda df: sorted((x["doc_id"], x["ids_sha256"]) for x in df.collect())
    assert rows(first) == rows(second) and len(rows(first)) == 30 and other.count() == 30


def test_scopes_delete_their_own_tables(spark):
    outside = storage.materialize(spark.range(3), "outside")
    with storage.scope(spark):
        inner = storage.materialize(spark.range(5), "inner")
        kept = storage.keep(storage.materialize(inner, "kept"))
        gone = storage.materialize(spark.range(2), "gone")
        storage.drop(gone)
    assert kept.count() == 5 and outside.count() == 3
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        spark.read.parquet(inner.tidemark_path).count()
    storage.drop(kept)


def test_hot_keys_are_joined_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1 if i < 700 else i, i) for i in range(900)] + [(None, 5)], "k long, v long")
    told = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.col("k") * 2)
    for hot in (1_000, 50):  # none is hot, one is
        monkeypatch.setattr(storage, "HOT", hot)
        got = storage.join_counted(rows, told, "k", "n")
        assert sorted(got.columns) == ["k", "name", "v"] and got.count() == 900 and got.where("name = 2").count() == 700
    assert storage.join_counted(rows.limit(0), told.limit(0), "k", "n").count() == 0


def test_tasks_work_on_small_parts_of_a_batch(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), b.column(0).slice(0, 1)], names=["n", "first"])

    rows = spark.range(1_203).coalesce(1).select(F.col("id").alias("a.b"))  # one Arrow batch
    got = storage.mapped(rows, sizes, T.StructType.fromDDL("n long, first long")).collect()
    assert [(r["n"], r["first"]) for r in got] == [(500, 0), (500, 500), (203, 1_000)]
    assert storage.mapped(rows.limit(0), sizes, T.StructType.fromDDL("n long, first long")).collect() == []


def test_ngrams_are_counted_in_parts(monkeypatch):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(20)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 20), pa.array(texts)], names=["lang", "text"])
    made = []

    def grams(words, n, counted=langid.grams):
        made.append(len(words))
        return counted(words, n)

    def counts():
        out = Counter()
        for b in langid._count(iter([batch])):
            for row in b.to_pylist():
                out[row["lang"], row["n"], row["word"], row["gram"]] += row["c"]
        return out

    monkeypatch.setattr(langid, "grams", grams)
    whole = counts()
    made.clear()
    monkeypatch.setattr(langid, "WORDS", 7, raising=False)
    assert counts() == whole and max(made) <= 7

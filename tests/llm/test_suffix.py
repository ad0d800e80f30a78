import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, alphabet, n, passages):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(15, 60)) for _ in range(passages)]
    rows = [(i, "".join(r.choice([word(r.randint(0, 40)), r.choice(shared), r.choice(shared)[r.randint(0, 9):]]) for _ in range(r.randint(0, 7)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 90), (n + 3, "ab" * 70), (3, rows[3][1]), (None, rows[4][1]), (None, None), (5, "ñ" * 31 + shared[0]), (5, "other " + shared[0])]
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "length"), [(1, "abcdefghij", 20), (2, "ab", 20), (3, "añb€", 21), (4, "abcdef", 33)])
@pytest.mark.parametrize(("held", "split"), [(100_000, 2_000), (5, 0), (30, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, alphabet, length, held, split):
    monkeypatch.setattr(suffix, "HELD", held)
    if split < 2_000:  # split q-grams whatever their number
        monkeypatch.setattr(suffix, "SPLIT", split)
        monkeypatch.setattr(suffix, "SAMPLE", 1)
    rows = made(seed, alphabet, 30, 4)
    df = spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in suffix.digests(df, length).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_table_and_production_length(spark):
    assert suffix.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(260))
    rows = [(1, "x" + passage + "left"), (2, passage), (3, passage[:199] + "#"), (4, "unique text")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in suffix.digests(df).collect()) == brute(rows, 200)
    kept = {r["doc_id"]: r["text"] for r in suffix.without_repeats(df).collect()}
    assert kept == {1: "xleft", 2: "", 3: rows[2][1], 4: "unique text"}
    assert suffix.without_repeats(df).columns == df.columns


def test_rows_with_equal_short_hashes_and_no_id_stay_apart(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcdefgh") for _ in range(256))
    by_hash, pair = {}, None
    while pair is None:  # two texts whose 32-bit hashes agree
        batch = [text() for _ in range(40_000)]
        for x in spark.createDataFrame([(t,) for t in batch], "t string").selectExpr("t", "hash(t) as h").collect():
            if by_hash.setdefault(x["h"], x["t"]) != x["t"]:
                pair = by_hash[x["h"]], x["t"]
    rows = [(None, pair[0]), (None, pair[1]), (1, pair[1]), (None, None)]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    assert sorted((tuple(x) for x in suffix.digests(df).collect()), key=str) == brute(rows, 200)


def test_clashing_names_and_repetitive_text(spark):
    names = ["doc_id", "text", "k1", "K2_", "at", "ats", "__th", "a`b.c"]
    rows = [(1, "ab" * 3_000 + "x", *"123456"), (2, "q" + "ab" * 150, *"654321"), (3, None, *"111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names[2:]))
    out = suffix.without_repeats(df)
    assert out.columns == names
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {1: (1, "x", *"123456"), 2: (2, "q", *"654321"), 3: rows[2]}
    assert sorted((tuple(x) for x in suffix.digests(df).collect()), key=str) == brute([r[:2] for r in rows], 200)


def test_refine_against_slices():
    r = random.Random(2)
    for length in (3, 8, 9, 20, 64, 100):
        data = "".join(r.choice("ab" if length > 8 else "abcd") * r.randint(1, 30) for _ in range(120)).encode()
        own = np.arange(len(data) - length + 1)
        n = Counter(data[i : i + length] for i in own)
        assert suffix.refine(np.frombuffer(data, np.uint8), own, length).tolist() == [n[data[i : i + length]] > 1 for i in own]

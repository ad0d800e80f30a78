"""Whitening, spelling variants and BPE against plain computations and the library."""

import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from tidemark.llm import bpe, variants, whitening
from tidemark.llm.queries import QUERIES, misspelt, tokenizer_path

SCHEMA = "doc_id long, text string, ids int, word string, n string"
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


# BPE ------------------------------------------------------------------------------------

@pytest.fixture(scope="module", params=[WORD, BYTE])
def tokenizer(request):
    path = tokenizer_path(request.param)
    return bpe.Encoder(bpe.Vocabulary(path)), Tokenizer.from_file(path)


def odd_texts():
    r = random.Random(5)
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "a" * 5_000, "ab" * 2_500, "don't 'S they'LL 'tis", "ΑΣ ΑΣ İ", "é é ́a", "퟿😀👩‍👩‍👧", "a\x1cb\x1fc d\x85e\xa0f g　h᠎i", "12 3.5e7 ½ ①"]
    marks = [0x1C, 0x1D, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x130, 0x3A3, 0x301, 0x308, 0xFEFF]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x2100), r.randrange(0x3000, 0x3100), r.randrange(0x1F600, 0x1F650), r.choice(marks)])) for _ in range(r.randrange(60))) for _ in range(300)]
    out += ["".join(r.choice("aehinstr ") for _ in range(150)) for _ in range(200)]
    return out


def test_bpe_equals_the_library(tokenizer, monkeypatch):
    enc, lib = tokenizer
    monkeypatch.setattr(bpe, "TABLE", 40)  # starts afresh again and again
    monkeypatch.setattr(bpe, "PAIRS", 50)
    texts = odd_texts()
    want = lib.encode_batch(texts, add_special_tokens=False)
    for text, w in zip(texts, want):
        assert enc.encode(text) == w.ids and enc.decode(w.ids) == lib.decode(w.ids, skip_special_tokens=False)
    for at in range(0, len(texts), 50):
        for w, got in zip(want[at : at + 50], enc.round_trips(texts[at : at + 50])):
            assert got == (len(w.ids), " ".join(map(str, w.ids)), lib.decode(w.ids, skip_special_tokens=False))


def test_every_prefix_has_its_own_encoding(tokenizer):
    """The stored last token of each prefix is the last token of the prefix's own merges."""
    enc, _ = tokenizer
    ids = {i: t for t, i in bpe.Vocabulary(tokenizer_path(WORD if enc.mark else BYTE)).ids.items()}
    rank = {(ids[a], ids[b]): n for (a, b), n in enc.rank.items()}
    r = random.Random(2)
    for _ in range(40):
        word = "".join(r.choice("abeinorst") for _ in range(12))
        merged, _ = bpe.run_merges([*word[:-1], word[-1] + (bpe.END if enc.mark else "")], rank)
        assert [ids[i] for i in enc.of_word(word)] == merged


def test_bpe_query_forms(spark, monkeypatch):
    rows = [(1, "The  café, 3 naïve\tCATS!", 5, "w", "n"), (2, None, None, None, None), (2, None, None, None, None), (None, "", 1, "", ""), (3, "x" * 20_000 + " y", 0, "", ""), (1, "The  café, 3 naïve\tCATS!", 5, "w", "n")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lib, path = Tokenizer.from_file(tokenizer_path(WORD)), tokenizer_path(WORD)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(df, path, "doc_id").collect()), key=str) == sorted(want, key=str)
    coded = bpe.encode(df, path, "doc_id", "n")
    assert coded.columns == ["doc_id", "n", "ids"] and sorted(len(x["ids"]) for x in coded.collect()) == sorted(w[1] for w in want)
    assert sorted(sha(x["text"]) for x in bpe.decode(coded, path, "doc_id").collect()) == sorted(w[3] for w in want)
    assert bpe.round_trip(df.limit(0), path, "doc_id").collect() == []


def test_bpe_refuses_other_models(tmp_path):
    model = {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]], "dropout": 0.1}
    (tmp_path / "t.json").write_text(json.dumps({"model": model}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "t.json"))


# Variants -------------------------------------------------------------------------------

def brute_words(rows):
    out = Counter()
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            out[word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute_groups(words):
    letters = sorted(set("".join(words)))
    form, near = {}, {}
    for w, n in words.items():
        made = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in ["", *letters] for k in (0, 1)} - {w}
        made = {x for x in made if x in words and abs(len(x) - len(w)) <= 1}
        near[w] = len(made)
        best = min(made, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], form[w] and words[form[w]]) for w, n in words.items())


def told(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=lambda r: r[0])


def test_words_are_counted_as_the_contract_says(spark, monkeypatch):
    monkeypatch.setattr(variants, "TEXTS", 7)
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdeéÀz") for _ in range(r.randrange(3, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(200)) + "!x×÷ŒŁabc") for i in range(40)]
    rows += [(None, "Straße straße STRASSE " * 200), (7, None), (8, ""), (9, "..."), (10, "q" * 30_000), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1, "w", "n") for d, t in rows], SCHEMA).repartition(3)
    got = {x["word"]: x["n"] for x in variants.count_words(df, change=misspelt).collect()}
    assert got == brute_words(rows) and any(n == 3 or n == 4 for n in got.values())
    plain = {x["word"]: x["n"] for x in variants.count_words(df, min_chars=1, min_count=1).collect()}
    assert sum(plain.values()) == sum(len(regex.findall("[A-Za-zÀ-ÿ]+", t or "")) for _, t in rows)
    assert variants.group(variants.count_words(df.limit(0))).collect() == []


@pytest.mark.parametrize("most", [2_000, 3])
def test_variants_equal_brute_force(spark, most, monkeypatch):
    """With small nodes the trie grows over all its families before tasks search it."""
    monkeypatch.setattr(variants, "LEAF", 2 if most == 3 else 16)
    monkeypatch.setattr(variants, "QUERIES", 5 if most == 3 else 16_384)
    monkeypatch.setattr(variants, "STEP", 16)
    r = random.Random(3)
    words = {}
    for _ in range(60):
        base = "".join(r.choice("aeinrst") for _ in range(r.randrange(5, 10)))
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(3)):
                i = r.randrange(len(w))
                w[i : i + r.randrange(2)] = r.choice(["", "a", "é", "zz", "e"])
            words["".join(w)] = r.choice([3, 4, 6, 7, 12, 30, 100])
    words |= {"".join(r.sample("abcdefgh", 8)): 3 for _ in range(80)}  # anagrams
    words |= {w: n for w, n in [("a" * 150, 3), ("a" * 151, 9), ("a" * 152, 20), ("b" + "a" * 150, 4), ("èèèèè", 5), ("éèèèè", 5), ("êèèèè", 5), ("aaaaa", 3), ("aaaab", 6), ("aaabb", 12)]}
    words |= {"abcdefgh" + "".join(p): 3 + i % 9 for end in ("rstu", "rsta") for i, p in enumerate(itertools.permutations(end))}  # alike at all levels
    words = {w: n for w, n in words.items() if len(w) >= 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert told(variants.group(df, most=most)) == brute_groups(words)


def test_variant_parts():
    assert variants.one_edit("abc", "abd") and variants.one_edit("abc", "abcd") and variants.one_edit("bc", "abc") and not variants.one_edit("abc", "abc") and not variants.one_edit("abc", "bca") and not variants.one_edit("a", "abc")
    assert variants.counts(["", "e" * 150]).max() == variants.MOST and variants.counts([""]).sum() == 0
    with pytest.raises(ValueError):
        variants.group(None, factor=1)


# Whitening ------------------------------------------------------------------------------

def brute_whitening(vectors, count=8):
    """Exact sums as fractions, then a library's eigenvectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    v = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return n, deviation, e[::-1][:count], u[:, ::-1][:, :count], np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x]), np.trace(v)


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(4)
    vec = [(i, [float(np.float32(c)) for c in r.normal(0, [3, 2, 1, 0.7, 0.5, 0.1, 0.1, 0.05, 0.01, 0.01], 10)]) for i in range(150)]
    vec += [(150, vec[0][1]), (150, vec[0][1]), (None, vec[3][1])]
    odd = [(200, None), (201, [1.0, None] * 5), (202, [float("nan")] * 10), (203, [float("-inf")] * 10)]
    df = spark.createDataFrame([(i, v, 1.5) for i, v in vec + odd], "vec_id long, embedding array<float>, n double").repartition(4)
    n, deviation, e, u, centred, trace = brute_whitening([v for _, v in vec])
    rows = whitening.whiten(df).collect()
    assert len(rows) == len(vec) * 8 and {x["n"] for x in rows} == {n} and rows[0]["identity_error"] < 1e-9
    for k in range(8):
        mine = [x for x in rows if x["component"] == k + 1]
        assert all(math.isclose(x["explained"], e[k] / trace, rel_tol=1e-9) for x in mine)
        want = centred @ u[:, k] / math.sqrt(e[k])
        by = sorted(((str(i), dev, w) for (i, _), dev, w in zip(vec, deviation, want)))
        got = sorted((str(x["vec_id"]), x["deviation"], x["whitened"]) for x in mine)
        sign = 1 if sum(a[2] * b[2] for a, b in zip(by, got)) > 0 else -1
        assert all(a[:2] == b[:2] for a, b in zip(by, got))
        assert np.allclose(sorted(sign * b[2] for b in got), sorted(a[2] for a in by), atol=1e-7)


def test_whitening_of_few_and_flat_vectors(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert of([]) == [] and of([(1, [1.0, 2.0])]) == [] and of([(1, [1.0]), (2, [1.0])]) == [] and of([(1, []), (2, [])]) == []
    two = sorted((x["vec_id"], x["component"], x["deviation"], round(abs(x["whitened"]), 9)) for x in of([(1, [0.0, 5.0]), (2, [1.0, 5.0])]))
    assert two == [(1, 1, 1024**2, 1.0), (2, 1, 1024**2, 1.0)]
    short = of([(1, [1.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])])  # a missing entry counts as zero
    assert len(short) == 4
    equal = of([(i, [float(i >> k & 1) for k in range(3)]) for i in range(8)])  # three equal eigenvalues
    assert len(equal) == 24 and equal[0]["identity_error"] < 1e-9 and all(math.isclose(x["explained"], 1 / 3) for x in equal)
    rows = [(1, [2.0**29 - 1, 0.0]), (2, [-(2.0**29), 1.0]), (3, [0.0, 0.5])]  # deviations beyond 64 bits are null
    far = {x["vec_id"]: x["deviation"] for x in of(rows)}
    n, deviation, *_ = brute_whitening([v for _, v in rows])
    assert far == {i: d if d < 2**63 else None for (i, _), d in zip(rows, deviation)} and None in far.values() and far[3] is not None
    with pytest.raises(Exception, match="exceeds"):
        of([(1, [1e300]), (2, [0.0])])


def test_counts_and_leading_eigenvalues():
    r = np.random.default_rng(6)
    for d in (1, 2, 5, 40):
        for values in (r.uniform(0.1, 9, d), np.repeat(3.0, d), np.r_[r.uniform(1, 1.0001, d - 1), 5.0], 10.0 ** -np.arange(d)):
            q, _ = np.linalg.qr(r.normal(size=(d, d)))
            m = q @ np.diag(values) @ q.T
            m = (m + m.T) / 2
            exact = np.linalg.eigvalsh(m)
            for shift in (0.0, 1.00005, 2.5, 4.0, exact.mean() * 1.01):
                if np.abs(exact - shift).min() > 1e-9:
                    assert whitening.below(m, shift) == (exact < shift).sum()
            found = whitening.leading(m, 8)
            big = [e for e in exact[::-1][:8] if e > d * np.abs(m).sum(1).max() * 2.0**-49]
            assert len(found) >= len(big) and np.allclose([e for e, _ in found][: len(big)], big, rtol=1e-9, atol=1e-13)
            u = np.stack([v for _, v in found])
            assert np.allclose(u @ u.T, np.eye(len(u)), atol=1e-9)
    assert whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.leading(np.zeros((3, 3)), 8) == []


def test_all_thirteen_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13

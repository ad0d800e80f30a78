import hashlib
import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, langid, pieces, sharding, simhash, topk, urls
from tidemark.llm.queries import URL_RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# Chat ------------------------------------------------------------------------

TOLD = "\\### Assistant: </turn> ok"


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 2, "assistant", "b\\l<#>\n"), (1, 1, "user", None), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, None, ""), (None, None, "assistant", TOLD), (3, 5, "x\ny: #", "é€😀" * 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    back = chat.read_back(chat.format_turns(chat.rows_to_turns(df))).collect()
    got = sorted(((r["conv_id"], r["n"], r["role"], r["text"], r["loss_text"]) for r in back), key=str)
    want = [(1, 0, "user", "", ""), (1, 1, "user", "a", ""), (1, 2, "user", "a", ""), (1, 3, "assistant", rows[0][3], rows[0][3]), (2, 0, "", "", ""), (None, 0, "assistant", TOLD, TOLD), (3, 0, rows[6][2], rows[6][3], "")]
    assert got == sorted(want, key=str)
    d = {r["conv_id"]: r for r in chat.digests(chat.format_turns(chat.rows_to_turns(df))).collect()}
    assert d[None]["loss_sha256"] == hashlib.sha256(TOLD.encode()).hexdigest() and d[None]["loss_chars"] == len(TOLD)
    assert d[3]["formatted_chars"] == len("### x\\ny: \\h\n") + 900 + len("</turn>\n")
    assert chat.format_turns(chat.rows_to_turns(df.limit(0))).collect() == []


def test_layouts_by_fingerprint(spark):
    records = [{"prompt": "p", "response": "r"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "x", "output": "o"}, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"what": 1}, {"prompt": "p", "completion": "c"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, "not json"), (9, None)], "conv_id long, payload string")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.records_to_turns(df).collect())
    assert [(c, r, t) for c, _, r, t in got] == [(0, "user", "p"), (0, "assistant", "r"), (1, "user", "i"), (1, "assistant", "o"), (2, "user", "i\nx"), (2, "assistant", "o"), (3, "user", "hi"), (3, "assistant", None), (4, "user", "q"), (4, "assistant", "a"), (6, "user", "p"), (6, "assistant", "c")]
    assert sorted(r["conv_id"] for r in chat.unmapped(df).collect()) == [5, 8, 9]
    typed = spark.createDataFrame([(1, "p", "r")], "conv_id long, prompt string, response string")
    assert [(r["role"], r["text"]) for r in chat.table_to_turns(typed).collect()] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.table_to_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


# SimHash ------------------------------------------------------------------------

def brute_fingerprint(text, size, of=list):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in of(grams)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("threshold", [3, 7])
def test_simhash_components(spark, threshold):
    r = random.Random(7)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randrange(40)) for _ in range(120)) for _ in range(25)]
    texts = []
    for b in base:
        w = b.split()
        for _ in range(4):
            w = list(w)
            w[r.randrange(len(w))] = "edited%d" % r.randrange(9)
            texts.append(" ".join(w))
    rows = list(enumerate(base + texts)) + [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "a\x0bb\x1cc"), (None, base[0]), (3, base[3]), (505, " \t")]
    df = spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], SCHEMA).repartition(3)
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                parent[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    want = sorted(((d, f"{fps[i]:016x}", min(x for x in members[root(i)] if x is not None)) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted((tuple(x) for x in simhash.near_duplicates(df, threshold=threshold).collect()), key=str) == want
    kept = sorted(x["doc_id"] for x in simhash.keep_first(df, threshold=threshold).collect())
    assert kept == sorted({c for _, _, c in want})


def test_simhash_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == [] and simhash.keep_first(df).columns == df.columns


# Top k -----------------------------------------------------------------------------

def test_topk_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    r = np.random.default_rng(2)
    vec = [(i, [float(x) for x in r.normal(0, r.choice([0.1, 1, 5]), 6)]) for i in range(300)]
    vec += [(300, vec[0][1]), (301, vec[0][1]), (302, [0.0] * 6), (303, None), (304, [1.0, None] * 3), (305, [float("nan")] * 6), (306, [float("inf")] * 6), (310, [9.0, 8.0]), (315, [3.0] * 9), (320, []), (None, vec[1][1]), (5, vec[5][1]), (7, vec[8][1])]
    df = spark.createDataFrame([(i, v, "score") for i, v in vec], "vec_id long, embedding array<double>, score string")
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in vec if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want, asked = [], set()
    for q, a in sorted(clean):
        if q % 5 == 0 and q not in asked:
            asked.add(q)
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in clean if c != q)[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]


# Language ID ---------------------------------------------------------------------------

def test_language_id(spark):
    r = random.Random(1)
    vocab = {"en": ["the", "house", "with", "thing"], "fr": ["le", "été", "maison", "avec"], "de": ["der", "straße", "mit", "haus"]}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(20)), lang, None, 1) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df.select("doc_id", "text", "lang"))
    probe = spark.createDataFrame([(1, "THE houses", "lang_pred"), (2, "maisons", ""), (3, None, ""), (4, "12 345 !?", ""), (5, "", ""), (None, "straßen " * 5000, ""), (7, "²", "")], "doc_id long, text string, score string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(probe, model, "doc_id").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und", None: "de", 7: "und"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    none = langid.train(df.limit(0).select("doc_id", "text", "lang"))
    assert [x["lang_pred"] for x in langid.predict(probe, none, "doc_id").collect()] == ["und"] * 7


def test_language_scores_equal_a_direct_count(spark):
    r = random.Random(5)
    letters = {"en": "theraind", "fr": "léoupaçx", "xx": "qz😀ß"}
    make = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7)))
    vocab = {lang: [make(lang) for _ in range(12)] for lang in letters}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(15)), lang) for i, lang in enumerate(list(letters) * 9)]
    units = lambda w: [u.decode("utf-16-le", "surrogatepass") for u in (w.encode("utf-16-le")[i : i + 2] for i in range(0, len(w.encode("utf-16-le")), 2))]
    counts = {n: {lang: {} for lang in letters} for n in range(5)}
    for _, text, lang in rows:
        for w in langid.words_of(text):
            counts[0][lang][w] = counts[0][lang].get(w, 0) + 1
            padded = ["^", *units(w), "$"]
            for n in range(1, 5):
                for i in range(len(padded) - n + 1):
                    g = tuple(padded[i : i + n])
                    counts[n][lang][g] = counts[n][lang].get(g, 0) + 1

    def log(n, lang, g):
        total = sum(counts[n][lang].values())
        return math.log((counts[n][lang].get(g) or 0.5) / (total + 1))

    def word(w):
        if any(w in counts[0][lang] for lang in letters):
            return [log(0, lang, w) for lang in sorted(letters)]
        padded, found = ["^", *units(w), "$"], []
        for i in range(len(padded) - 1):
            for n in (4, 3, 2, 1):
                g = tuple(padded[i : i + n])
                if len(g) == n and any(g in counts[n][lang] for lang in letters):
                    found.append([log(n, lang, g) for lang in sorted(letters)])
                    break
        return [sum(x) / len(found) for x in zip(*found)] if found else [0.0] * len(letters)

    texts = [" ".join(r.choice(vocab[lang]) + r.choice(["", "th", "é", "qq"]) for _ in range(r.randint(1, 12))) for lang in list(letters) * 8] + ["жж", "😀😀 th", "a"]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    probe = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, `a``b.c` int")
    got = {x["doc_id"]: x for x in langid.predict(probe, model, "doc_id", "a`b.c").collect()}
    for i, t in enumerate(texts):
        words = langid.words_of(t)
        sums = [sum(x) for x in zip(*map(word, words))]
        top = max(sums)
        assert got[i]["lang_pred"] == sorted(letters)[sums.index(top)] or sorted(sums)[-1] - sorted(sums)[-2] < 1e-9
        assert math.isclose(got[i]["score"], 1 / sum(math.exp((s - top) / len(words)) for s in sums), rel_tol=1e-9)


# SentencePiece ---------------------------------------------------------------------------

def test_pieces_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 50)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    r = random.Random(0)
    parts = ["a", " ", "  ", "▁", "é", "\n", "\t", "漢", "😀", " the", "\x00", " ", "ﬁ", "</s>", "<unk>", "<0x0A>", "123", "word", "x" * 300]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(400)] + [(500, None), (501, ""), (502, " "), (None, "a" * 20000), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(d, t, "ids") for d, t in rows], "doc_id long, text string, ids string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted((tuple(x) for x in pieces.round_trip(df, tokenizer_path(), "doc_id").collect()), key=str) == sorted(want, key=str)
    coded = pieces.encode(df.drop("ids"), tokenizer_path(), "doc_id")
    told = {x["doc_id"]: x for x in pieces.round_trip(df, tokenizer_path(), "doc_id", whole=True).where("doc_id < 400").collect()}
    assert all(told[d]["ids"] == [*sp.encode(t or ""), sp.eos_id()] and told[d]["decoded"] == sp.decode(sp.encode(t or "")) for d, t in rows[:400] if d != 1)
    back = {x["doc_id"]: x["text"] for x in pieces.decode(coded, tokenizer_path(), "doc_id").collect()}
    assert back[1] == "again" and back[500] == ""
    assert pieces.round_trip(df.limit(0), tokenizer_path(), "doc_id").collect() == []


# Sharding ------------------------------------------------------------------------------------

def test_size_tiered_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fanout=3, smallest=1_000)
    rows = [(i, None if i % 7 == 0 else hashlib.sha256(str(i).encode()).hexdigest() * 3) for i in range(600)] + [(None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(5):
        store.append(df.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == k).coalesce(2))
    assert store.versions() == [1, 2, 3, 4, 5] and len(store.shards()) == 10
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    before = key(store.read(3))
    version = store.compact()
    assert version > 5 and len(store.shards()) < 10 and not store.runs_to_merge(store.shards())
    assert key(store.read()) == sorted(rows, key=str) and key(store.read(3)) == before
    with pytest.raises(sharding.CommitConflict):
        store.commit(version - 1, [])
    assert store.vacuum() > 0 and key(store.read()) == sorted(rows, key=str) and store.versions() == [version]
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/empty")
    empty.append(df.limit(0))
    assert empty.read().collect() == [] and empty.compact() == 1


def test_shards_keep_added_columns_and_other_writers_files(spark, tmp_path):
    open_ = lambda: sharding.ShardStore(spark, f"file://{tmp_path}/store", fanout=2)
    one, two = open_(), open_()
    one.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    one.append(spark.createDataFrame([(2, "b", 0.5)], "doc_id long, text string, extra double"))
    one.append(spark.createDataFrame([(3,)], "doc_id long"))
    want = [(1, "a", None), (2, "b", 0.5), (3, None, None)]
    one.compact()
    one.vacuum()
    assert sorted(tuple(r) for r in open_().read().collect()) == want and len(one.shards()) == 1
    with pytest.raises(ValueError):
        two.append(spark.createDataFrame([("x",)], "DOC_ID string"))
    name, shards = two._write(spark.createDataFrame([(4, "d")], "doc_id long, text string").coalesce(1))  # written, not yet committed
    assert one.vacuum() == 0
    two.commit(two._newest(), two.shards() + shards)
    two._done(name)
    assert one.vacuum() == 0 and sorted(r["doc_id"] for r in one.read().collect()) == [1, 2, 3, 4]
    two._write(spark.createDataFrame([(9, "lost")], "doc_id long, text string").coalesce(1))
    assert one.vacuum() == 0 and one.vacuum(grace=-60) == 1 and one.read().count() == 4


def test_shards_take_up_a_lost_race(spark, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/store", fanout=2) for _ in range(2))
    row = lambda i: spark.createDataFrame([(i,)], "doc_id long")
    store.append(row(0))
    store.append(row(1))
    write, raced = store._write, []

    def slow(df):
        out = write(df)
        if not raced:
            raced.append(other.append(row(2)))
        return out

    monkeypatch.setattr(store, "_write", slow)
    store.append(row(3))
    raced.clear()
    store.compact()
    assert raced and sorted(r["doc_id"] for r in store.read().collect()) == [0, 1, 2, 2, 3]
    assert not store.runs_to_merge(store.shards())


# URLs ----------------------------------------------------------------------------------------

def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def test_url_rules(spark):
    good = [f"https://site{i % 3}.example.org/en/{i}?q" for i in range(40)]
    bad = [f"http://ads.track{i % 4}.biz/x/{i}?q" for i in range(40)]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/EN/", "https://www.Example.com/en/1#x", "https://a.www.example.com/en/", "http://example.com/en/2", "http://example.com", "http://net/es/", "http://x.net/fr/a?b", "http://xnet/fr/", "http://É.NET/fr/", "a://b.com?x/y", "x://y://z.com/", "http://com/\nq"]
    rows = list(enumerate(good + bad + odd)) + [(None, bad[0]), (3, good[3])]
    pages = spark.createDataFrame([(i, u, "t") for i, u in rows], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(i, i >= 40) for i in range(0, 80, 2)] + [(42, False), (None, True)], "page_id long, blocked boolean")
    got = sorted((tuple(r) for r in urls.judge(pages, labels, URL_RULES, 0.05, 0.8).collect()), key=str)
    want = []
    for i, u in rows:
        host, path = split(u)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, "block" if (u or "").startswith("http://ads.") else "allow")
        want.append((i, host, path, *rule))
    assert got == sorted(want, key=str)
    assert urls.judge(pages.limit(0), labels, URL_RULES).collect() == []
    assert {r["verdict"] for r in urls.judge(pages.where("page_id < 80"), labels.limit(0), URL_RULES).collect()} == {"allow"}


# Verified near-duplicates --------------------------------------------------------------------

def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("lines, pairs, block", [(256, 8, 4096), (5, 0, 4096), (5, 0, 7)])
def test_near_duplicates_are_verified(spark, monkeypatch, lines, pairs, block):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    monkeypatch.setattr(simhash, "LINES", lines)
    monkeypatch.setattr(simhash, "PAIRS", pairs, raising=False)
    r = random.Random(11)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randrange(40)) for _ in range(120)) for _ in range(8)]
    texts = list(base)
    for b in base:
        for edits in (1, 1, 2, 2, 3, 4, 5):
            w = b.split()
            for k in r.sample(range(120), edits):
                w[k] = "edited%d" % r.randrange(99)
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "one"), (503, "ONE"), (None, base[0]), (3, base[3])]
    fps, sets = [[brute_fingerprint(t, size, set) for size in (1, 2)] for _, t in rows], [five(t) for _, t in rows]
    label, near, far, wide = list(range(len(rows))), 0, 0, 0
    for i in range(len(rows)):
        for j in range(i):
            bits, both = min((x ^ y).bit_count() for x, y in zip(fps[i], fps[j])), sets[i] | sets[j]
            alike = not both or len(sets[i] & sets[j]) / len(both) >= 0.8
            near, far, wide = near + (alike and bits <= 7), far + (not alike and bits <= 7), wide + (alike and 3 < bits <= 7)
            if alike and bits <= 7:
                label = [label[j] if x == label[i] else x for x in label]
    assert near and far and wide
    want = sorted(min(d for (d, _), x in zip(rows, label) if x == k and d is not None) for k in set(label))
    df = spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == want and kept.columns == df.columns
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").collect() == []


@pytest.mark.parametrize("lines, pairs", [(256, 8), (4, 1), (4, 0), (30, 2)])
def test_candidates_of_an_anchor_keep_every_link(monkeypatch, lines, pairs):
    """Against all pairs: pairs listed are links, few a text, and what is listed connects what all links connect."""
    monkeypatch.setattr(simhash, "LINES", lines)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    r = np.random.default_rng(5)
    rows = []
    for anchor, size in enumerate([1, 2, 40, 9, 25]):
        centre = r.integers(0, 1 << 62, 3)
        for k in range(size):  # anchor 2 has a dense group, the others sparse ones
            fp = int(centre[0 if anchor == 2 and k < 30 else k % 3]) ^ sum(1 << int(b) for b in set(r.integers(0, 62, 3 if anchor == 2 else 5)))
            rows.append((anchor, 1000 * anchor + k, fp, int(r.integers(80, 110)), bool(r.random() < 0.7)))
    rows.sort(key=lambda x: (x[0], x[3]))
    kinds = (np.int64, np.int64, np.int64, np.int32, bool)
    a, b, dense = simhash._candidates(*(np.array(c, t) for c, t in zip(zip(*rows), kinds)), 7, 0.8)
    of = {t: (anchor, fp, n, home) for anchor, t, fp, n, home in rows}

    def linked(x, y):
        (g, p, n, h), (k, q, m, i) = of[x], of[y]
        return x != y and g == k and (h or i) and (p ^ q).bit_count() <= 7 and min(n, m) >= 0.8 * max(n, m)

    def sets(links):
        label = {t: t for t in of}
        for x, y in links:
            old, new = label[y], label[x]
            label = {t: new if v == old else v for t, v in label.items()}
        return {frozenset(t for t in label if label[t] == v) for v in label.values()}

    every = [(x, y) for x in of for y in of if x < y and linked(x, y)]
    listed = [(int(x), int(y)) for x, y, d in zip(a, b, dense) if not d]
    assert every and all(linked(x, y) for x, y in listed) and len(listed) == len({frozenset(p) for p in listed})
    assert max(Counter(t for p in listed for t in p).values(), default=0) <= pairs
    assert sets(every) == sets(zip(a.tolist(), b.tolist())) and int(dense.sum()) < len(of)
    inside = sets([(int(x), int(y)) for x, y, d in zip(a, b, dense) if d])  # a pair that is not listed is in one of these
    assert all((x, y) in listed or (y, x) in listed or any({x, y} <= g for g in inside) for x, y in every)


def test_url_rules_see_every_label_and_segment(spark):
    rows = [(i, f"https://{'w' if i % 2 else 'm'}.{'spam-farm' if i < 12 else 'site%d' % (i % 5)}.example.org/a{i % 6}/x/b{i % 4}") for i in range(60)]
    rows += [(i, f"https://s{i % 7}.example.org/a{i % 6}/{'offers' if i < 72 else 'notes'}/b{i % 4}") for i in range(60, 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 12 or 60 <= i < 72) for i, _ in rows if i % 3], "page_id long, blocked boolean")
    got = {r["page_id"] for r in urls.judge(pages, labels, [("allow", "nowhere.test", "/")], 0.1, 0.9).where("verdict = 'block'").collect()}
    assert got == {*range(12), *range(60, 72)}


def test_mined_rules_equal_a_brute_force_miner(spark):
    r = random.Random(9)
    rows = [(i, f"https://{r.choice('ab')}.{r.choice(['x', 'y', 'z'])}.org/{r.choice('pq')}/{r.choice('st')}") for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string").select("page_id", urls.tokens(F.col("url")).alias("tokens"))
    labelled = df.withColumn("blocked", F.array_contains("tokens", "inner=x") & (F.col("page_id") % 7 != 0) | (F.col("page_id") % 11 == 0))
    baskets = [(frozenset(x["tokens"]), x["blocked"]) for x in labelled.collect()]
    rules = {}
    for size in range(1, 13):
        found = 0
        for c in {frozenset(s) for b, _ in baskets for s in itertools.combinations(sorted(b), size)} if size < 4 else ():
            n, hit = sum(c <= b for b, _ in baskets), sum(c <= b and k for b, k in baskets)
            if hit / len(baskets) >= 0.1:
                found += 1
                rules[c] = hit / n
    kept = {c: s for c, s in rules.items() if s >= 0.7}
    want = {c: s for c, s in kept.items() if not any(p < c and t >= s for p, t in kept.items())}
    got = {frozenset(x["items"]): x["confidence"] for x in urls.mine(labelled, 0.1, 0.7).collect()}
    short = {c: s for c, s in got.items() if len(c) < 4}
    assert short.keys() == want.keys() and all(math.isclose(short[c], want[c]) for c in want) and want
    best = {x["tokens"] and frozenset(x["tokens"]): x["confidence"] for x in urls.match(df, urls.mine(labelled, 0.1, 0.7)).collect()}
    for b, _ in baskets:
        fits = [s for c, s in got.items() if c <= b]
        assert best.get(b) == (max(fits) if fits else None)


def test_long_urls_are_not_power_sets(spark):
    """Parts that come together are one class: URLs of 40 segments, shared by five pages or by one."""
    part = lambda i: "/".join(f"p{i}s{k}" for k in range(40))
    rows = [(i, f"https://h{i // 5 % 3}.example.org/{part(i // 5)}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i // 5 % 8 == 0) for i, _ in rows if i % 5], "page_id long, blocked boolean")
    got = {r["page_id"] for r in urls.judge(pages, labels, [("allow", "nowhere.test", "/")]).where("verdict = 'block'").collect()}
    assert got == {i for i, _ in rows if i // 5 % 8 == 0}
    labelled = pages.join(labels, "page_id").select("page_id", urls.tokens(F.col("url")).alias("tokens"), "blocked")
    classed = urls.classes(labelled)
    assert classed.where("token like 'segment=p3s%'").select("cls").distinct().count() == 1
    single = urls.mine(labelled).where(F.size("items") == 1)
    assert single.where("items[0] like 'segment=p0s%'").count() == 38


def test_shards_of_several_arrivals_are_merged(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(50)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op7_sharding"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(50)) and {(r["arrivals"], r["merges_committed"], r["fewer_shards"], r["rows_listed"]) for r in rows} == {(5, True, True, 50)}


def test_many_languages_take_sparse_rows(spark):
    name = lambda k: "abcdefgh"[k // 8] + "klmnopqr"[k % 8]
    rows = [(i, f"word{name(i % 60)}x common{name(i % 7)} zz{name(i % 60)}", f"l{i % 60:02}") for i in range(240)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 60 and len(model.known.more) < len(model.known) * 4
    said = model.predict([f"word{name(3)}x zz{name(3)}", f"common{name(1)}", "", f"unseenword{name(3)}x"])
    assert said[0][0] == "l03" and said[2] == ("und", 0.0) and all(0 < s <= 1 for _, s in (said[0], said[1], said[3]))

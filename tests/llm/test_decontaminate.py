import random
import time

from tidemark.llm import decontaminate as D


def brute(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    chars = list(text)
    for _ in range(n):
        i = r.randrange(len(chars))
        chars[i : i + 1] = r.choice([[], [r.choice("xyzé")], [chars[i], r.choice("xyz€")]])
    return "".join(chars)


def test_finds_exactly_what_the_edit_budget_allows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(4, 25))) for i in range(20)] + [(97, "abab " * 12), (98, "q-q"), (99, "exactly8"), (96, "-" * 40)]
    index = D.Index(items)
    found = 0
    for _ in range(60):
        i, item = r.choice(items[:20])
        k = D.budget(len(D.normal(item)))
        if r.random() < 0.2:
            i, item = r.choice(items[20:])
            k = D.budget(len(D.normal(item))) if len(item) >= D.Q else -3
        doc = text(r.randint(0, 40)) + " " + edited(r, item, r.randint(0, k + 3)) + " " + text(r.randint(0, 40))
        got = {m[0]: m[1] for m in index.matches(doc)}
        want = {}
        for j, other in items:
            norm = D.normal(other)
            if len(norm) < D.Q:
                if f" {norm} " in f" {D.normal(doc)} ":
                    want[j] = 0
            elif (edits := brute(norm, D.normal(doc))) <= D.budget(len(norm)):
                want[j] = edits
        assert got == want
        found += len(got)
    assert found > 30


def test_tables(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, "tiny"), (5, "The quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    leak = "x " * 50 + "THE quick\nbrown fox jumped over the lazy dog again and again" + " y" * 50
    docs = spark.createDataFrame([(1, leak, "a"), (2, "clean text", "b"), (3, None, None), (None, leak, None), (1, leak, "a"), (4, "", "c")], "doc_id long, text string, item_id string")
    rows = sorted((tuple(r) for r in D.find(docs, bench, chunk_chars=60).collect()), key=str)
    assert rows == sorted([(i, j, 2) for i in (1, 1, None) for j in (1, 5)], key=str)
    assert sorted(r["doc_id"] for r in D.clean(docs, bench).collect()) == [2, 3, 4]
    assert D.clean(docs, bench).columns == docs.columns
    assert D.find(docs.limit(0), bench).collect() == [] and D.find(docs, bench.limit(0)).collect() == []


def test_clean_judges_each_row_by_its_own_text(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "pack my box with five dozen liquor jugs before the evening")], "item_id long, text string")
    leak, other = "x THE quick brown fox jumped over the lazy dog again and again", "pack my box with five dozen liquor jugs before the evening y"
    rows = [(None, leak), (None, "clean one"), (None, "clean two"), (7, other), (7, "clean three"), (7, None), (8, "kept"), (8, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (D.CHUNK_CHARS, 60):
        assert sorted((tuple(r) for r in D.clean(docs, bench, chunk_chars=chars).collect()), key=str) == sorted([x for x in rows if x[1] not in (leak, other)], key=str)


def test_part_of_a_long_item_and_repetitive_texts():
    r = random.Random(8)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(150))
    index = D.Index([(1, item), (2, "-" * 400), (3, "=-" * 90), (1, item)])
    size = len(D.normal(item))
    for at in range(0, size - 3 * D.WINDOW // 2, 97):
        quote = D.normal(item)[at : at + 3 * D.WINDOW // 2]
        assert [m[:2] for m in index.matches("x" * 50 + edited(r, quote, 3) + "y" * 99)][0][0] == 1
    assert index.matches(D.normal(item)[: D.WINDOW // 2] + " and something else") == []
    began = time.time()
    assert [m[:2] for m in index.matches("-" * 1_000_000)] == [(2, 0)]
    index.matches("-=-" * 300_000)
    assert time.time() - began < 60
    long = "z " * 90_000 + item + " z" * 90_000  # the match lies across two parts
    assert [m[:2] for m in index.matches(long)] == [(1, 0), (1, 0)]

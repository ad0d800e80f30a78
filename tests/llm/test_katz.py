import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import katz


def good_turing(counts):
    """count -> discount factor, from the textbook formula; nothing of the module under test."""
    n = Counter(counts)
    for k in (5, 4, 3, 2, 1):
        if any(n[r] == 0 for r in range(1, k + 2)):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        factor = {r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)}
        if all(0 < f < 1 for f in factor.values()):
            return lambda c, factor=factor: factor.get(c, 1.0)
    return lambda c: (c - 0.5) / c if c <= 5 else 1.0


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def model(train, order):
    """words, their total, and P(last of gram | the rest) by the definition's recursion."""
    words, counts, after = Counter(), {k: Counter() for k in range(2, order + 1)}, {}
    for t in train:
        code = tokens(t) + ["</s>"]
        words.update(code)
        for k in counts:
            padded = ["<s>"] * (k - 1) + code
            counts[k].update(tuple(padded[i : i + k]) for i in range(len(code)))
    for k in counts:
        for g, n in counts[k].items():
            after.setdefault(g[:-1], {})[g[-1]] = n
    total, factor = sum(words.values()), {k: good_turing(counts[k].values()) for k in counts}
    uni = good_turing(words.values())
    known = {w: c * uni(c) / total for w, c in words.items()}
    unseen = 1 - sum(known.values())
    if unseen < 1e-12:  # nothing taken off: one more token
        known, unseen = {w: c / (total + 1) for w, c in words.items()}, 1 / (total + 1)

    def p(gram):
        context, w = gram[:-1], gram[-1]
        if not context:
            return known.get(w, unseen)
        if context not in after:
            return p(gram[1:])
        n, seen = sum(after[context].values()), {x: c * factor[len(gram)](c) for x, c in after[context].items()}
        share = sum(seen.values()) / n
        if share > 1 - 1e-9:  # as above, for this context
            seen = {x: c * n / (n + 1) for x, c in seen.items()}
            share = n / (n + 1)
        return seen[w] / n if w in seen else (1 - share) * p(gram[1:]) / (1 - sum(p((*context[1:], x)) for x in seen))

    return words, total, p


@pytest.mark.parametrize("order, hot", [(2, True), (2, False), (3, True), (4, True), (4, False)])
def test_equals_direct_evaluation_and_sums_to_one(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 150)
    monkeypatch.setattr(katz, "PART_BYTES", 90)
    if hot:
        monkeypatch.setattr(katz, "MAX_HOT", 12)
    texts = [f"the cat {a} sat on the {b}\tmat and the dog {a * 2}" for a in ("x", "y", "z", "Über", "q") for b in ("red", "BLUE", "old")]
    texts += ["same same same same same same same same", "", None, "the the the", "only in held out", "the cat sat", None]
    rows = [(i, t, i % 4 == 3) for i, t in enumerate(texts)] + [(None, "the cat", False), (2, texts[2], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean").withColumn("ids", F.lit("clash"))
    got = sorted((tuple(r) for r in katz.score(df, F.col("out"), order).collect()), key=str)
    words, total, p = model([t for _, t, out in rows if not out], order)
    for v in [["<s>"], ["unseen"], *[[w] for w in words], ["the", "cat"], ["<s>", "the"], ["on", "the"], ["sat", "on", "the"]]:
        context = (["<s>"] * order + v)[-(order - 1) :]
        assert math.isclose(sum(p((*context, w)) for w in [*words, "never seen"]), 1, rel_tol=1e-9), context
    want = []
    for i, t, out in rows:
        code = ["<s>"] * (order - 1) + tokens(t) + ["</s>"]
        said = code[order - 1 :]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in said)
        want.append((i, out, len(said), sum(words[w] > 0 for w in said), total, base, sum(math.log10(p(tuple(code[j : j + order]))) for j in range(len(said)))))
    want.sort(key=str)
    key = lambda r: (str(r[:5]), round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_the_order_is_at_least_two(spark):
    with pytest.raises(ValueError):
        katz.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), F.lit(False), 1)


def test_empty_tables_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(empty, F.lit(False)).collect() == []
    held = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in katz.score(held, F.lit(True)).collect()}
    assert rows[1]["n_tokens"] == 3 and rows[1]["n_known"] == 0 and rows[1]["train_tokens"] == 0 and rows[1]["score"] == 0.0 and rows[2]["base_score"] == 0.0


def test_discounts():
    assert np.allclose(katz.discounts([0] * 6), [1, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9])
    n = [1000, 400, 220, 140, 95, 70]
    d = katz.discounts(n)
    assert ((0 < d[1:]) & (d[1:] < 1)).all()  # the mass taken off is that of the types seen once
    assert math.isclose(sum(r * n[r - 1] * (1 - d[r]) for r in range(1, 6)), n[0])

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    whole, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * whole) // length
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as n", "2 as terms", "3 as rank", "4 as t")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as item", "3 as of", "4 as place", "5 as held")
    return sorted(map(tuple, lexical.rank_documents(docs, items, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{n}" for n in range(120)] + ["Straße", "naïve", "x1", "ÉTÉ", "a b", "the", "The", "THE"]
    texts = [" ".join(rng.choices(words, weights=[1 / (n + 1) for n in range(len(words))], k=rng.randrange(1, 80))) for _ in range(300)]
    docs = list(enumerate(texts)) + [(400, None), (401, ""), (402, " .,;\x00\x7f "), (None, texts[3]), (403, "w1 " * 40_000), (404, "y" * 300_000)]
    docs += [(405 + n, texts[5]) for n in range(30)] + [docs[8]] * 3
    shared = " ".join(words[3:20])
    items = [(n, shared[: 10 + 3 * n] + " " + " ".join(rng.choices(words, k=8))) for n in range(25)]
    items += [(30, None), (31, "..."), (32, "nowhere"), (33, "W1,w2;w1"), (33, "naïve"), (None, "w7 w8"), (34, "été ÉTÉ the"), (35, "y" * 300_000)]
    return docs, items


def test_agrees_with_plain_scores(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_bytes=700) == want
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_sides(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None), (2, "!")], items) == [] and found(spark, docs, [(1, None)]) == []


def test_plan_sums_each_item_once():
    rng = np.random.default_rng(2)
    held = rng.random((40, 60)) < 0.3
    held[:20, :15] = True
    item, term = np.nonzero(held)
    plan = lexical.SharingPlan(item, term, 40, 60)
    worth = rng.integers(0, 10**9, (60, 7))
    t, d = np.indices(worth.shape)
    assert (plan.scores(d.ravel(), t.ravel(), worth.ravel(), 7) == held.astype(np.int64) @ worth).all()
    assert plan.levels and len(plan.parts) + sum(map(len, plan.levels)) < held.sum() * 0.75


def test_shared_sets_are_summed_once():
    items = np.repeat(np.arange(50), 30)
    plan = lexical.SharingPlan(items, np.tile(np.arange(30), 50), 50, 30)
    assert plan.n_nodes == 1 and len(plan.parts) == 50

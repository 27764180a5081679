from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import near_dup


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 29), st.integers(0, 5)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_banded_alignment_is_exact_from_the_threshold_on(a, edits):
    b = list(a)
    for kind, at, value in edits:
        at %= len(b) + 1
        if kind == 0:
            b.insert(at, value)
        elif at < len(b) and len(b) > 1:
            b[at : at + 1] = [value] * (kind == 1)
    least = near_dup._least(len(a), len(b))
    want, got = lcs(a, b), near_dup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == want if want >= least else got < least


def brute(rows):
    """Class of each row by comparing all texts that share a shingle; the alignment itself is tested above."""
    words = [re.findall(r"[^\W_]+", t.lower()) if t is not None else None for _, t in rows]
    grams = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    number = {g: k for k, g in enumerate({g for some in grams for g in some})}
    coded = [np.array([number[g] for g in some], np.uint64) for some in grams]
    holders, spelled, tried = defaultdict(set), {}, set()
    for i, (g, (_, t)) in enumerate(zip(grams, rows, strict=True)):
        for s in g:
            holders[s].add(i)
        if t is not None and not words[i]:
            parent[find(i)] = find(spelled.setdefault(t, i))
    for members in holders.values():
        for x in members:
            for y in members:
                if x < y and find(x) != find(y) and (x, y) not in tried:
                    tried.add((x, y))
                    least = near_dup._least(len(grams[x]), len(grams[y])) - 1e-9
                    if near_dup.aligned(coded[x], coded[y], least) >= least:
                        parent[find(x)] = find(y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, d if t is None else least.get(find(i))) for i, (d, t) in enumerate(rows))


def family(rng, vocabulary, copies, longest):
    base = [rng.choice(vocabulary) for _ in range(longest)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text))
            text[at : at + 1] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1, 2])
        yield " ".join(text)


def test_agrees_with_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [t for _ in range(6) for t in family(rng, vocabulary, 25, rng.randrange(20, 160))]
    texts += [f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 60)))}" for _ in range(60)]
    texts += list(family(rng, vocabulary, 40, 6)) + ["A, b! c", "a b c", "a b d", "", "", " ", "!!!", "!!!", None, None] + texts[:5] * 3
    # A chain: each link is similar, its ends are not.
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(8):
        chain = chain[: k * 9] + [f"n{k}a", f"n{k}b"] + chain[k * 9 + 2 :]
        texts.append(" ".join(chain))
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in near_dup.labelled(df).collect()) == brute(rows)


def test_awkward_rows_and_one_each(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(tuple(r) for r in near_dup.labelled(awkward).collect()) == brute(rows)
    kept = near_dup.one_each(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(None) == sum(t is None for _, t in rows)
    classes = {c for (_, c), _ in brute([r for r in rows if r[1] is not None]).items()}
    left = near_dup.labelled(kept.where("text is not null"))
    assert left.count() == len(texts) - texts.count(None) >= len(classes)
    assert left.groupBy("class_id").count().where("count > 1").join(kept, F.col("class_id") == F.col("doc_id"), "left").where("doc_id is not null and doc_id <> 3").count() == 0
    assert near_dup.labelled(nothing).count() == 0 and near_dup.one_each(nothing).count() == 0


def test_a_hot_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(300):
        text = list(base)
        for at in sorted(rng.sample(range(150), rng.randrange(1, 9)), reverse=True):
            text[at : at + 1] = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
        texts.append(" ".join(text))
    made, real = [], near_dup._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dup, "_verified", counted)
    rows = list(enumerate(texts))
    got = Counter(tuple(r) for r in near_dup.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert sum(made) < 10 * len(texts), made


def template(rng, n):
    """Texts of 120 words of which six are replaced: none is similar to another, all share most of their shingles."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in range(10, 120, 20):
            text[at + rng.randrange(5)] = f"v{rng.randrange(40)}"
        out.append(near_dup.shingles(np.array([hash(w) & 0xFFFFFFFF for w in text], np.uint32), np.array([120]))[0])
    return out


def test_template_texts_test_few_pairs():
    tried = {}
    for n in (150, 600):
        texts = template(random.Random(1), n)
        links, tried[n] = near_dup.meet(texts, np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64))
        want = {(x, y) for x in range(n) for y in range(x + 1, n) if near_dup.aligned(texts[x], texts[y], 0) >= near_dup._least(116, 116)} if n == 150 else None
        if want is not None:
            assert set(links) <= want and len({x for link in links for x in link}) == len({x for link in want for x in link})
    assert tried[150] < 10 * 150 and tried[600] < 20 * 600, tried


def test_sets_in_parts_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(3) for t in family(rng, vocabulary, 40, 90)]
    chain = list(texts[0].split())
    for k in range(8):
        chain = chain[: k * 9] + [f"n{k}a", f"n{k}b"] + chain[k * 9 + 2 :]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "PART_WORDS", 700)
    assert Counter(tuple(r) for r in near_dup.labelled(df).collect()) == brute(rows)


def test_very_long_near_copies_end():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 40, 60_000).astype(np.uint64)
    b = a.copy()
    b[rng.choice(60_000, 3_000, replace=False)] = 7
    assert near_dup.aligned(a, b, near_dup._least(60_000, 60_000)) == 57_000
    assert near_dup.aligned(a, np.concatenate([a[1_000:], b[:1_000]]), near_dup._least(60_000, 60_000)) >= 59_000

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or "", text or "")))
    convs = {c: [t for _, _, t in sorted(ts, key=lambda x: x[:2])] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + ts[h:])
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in ids if convs[c] == p)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], sum(children[q] == 0 for q in under),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as turns", "2 as one", "3 as h", "4 as head", "5 as base", "6 as key", "7 as path")
    convs = prefix_trie.with_heads(prefix_trie.conversations_of(df))
    return sorted(map(tuple, prefix_trie.trie(convs, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(200, 245), 310, 311, -3, -100, 7_000_000_000]:
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é😀", "", None])) for t in range(rng.randrange(1, 8))]
    rows += [(400, t, "user", "x") for t in range(90)] + [(401, t, "user", "x") for t in range(90)] + [(402, t, "user", "x") for t in range(70)]
    rows += [(500, None, "user", "first"), (500, 1, "user", "second"), (None, 1, "user", "nobody"), (501, 0, None, None), (502, 0, "user", "y" * 50_000)]
    return rows


def test_agrees_with_prefixes(spark, talk):
    want = brute(rebuilt(talk))
    assert found(spark, talk) == want
    assert found(spark, talk, shard_turns=40) == want


def test_copies_over_several_ranges(spark):
    rows = [(c, t, "user", f"{t}") for c in range(1, 90) for t in range(6)] + [(c, t, "user", f"{t}") for c in range(100, 120) for t in range(3)]
    want = brute(rebuilt(rows))
    assert found(spark, rows, shard_turns=50) == want and found(spark, rows) == want


def test_empty_and_turnless(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "a")]) == []
    gone = [c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "user", "a") for c in gone]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert found(spark, rows)[0][3] == 5


def test_repeated_rows_are_turns(spark):
    rows = [(601, 0, "user", "a"), (601, 0, "user", "a"), (601, 0, "user", "a")] * 3 + [(600, 2, "user", "b")] * 4
    assert found(spark, rows) == brute(rebuilt(rows))


@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_order_and_common_prefixes(rows):
    size = np.array([len(r) for r in rows])
    codes, conv = np.array([c for r in rows for c in r], np.int64), np.arange(len(rows))[::-1].copy()
    order = prefix_trie.sorted_rows(codes, size, conv)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
    begin = (np.cumsum(size) - size)[order]
    shared = prefix_trie.common_prefixes(codes, begin, size[order])
    for k in range(1, len(rows)):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert shared[k] == same

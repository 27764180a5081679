from __future__ import annotations

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, step=50):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for q, a in whole:
        for i, b in whole:
            if q % step == 0 and i != q and len(a) == len(b):
                score = sum(x * y for x, y in zip(a, b, strict=True))
                best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, score))
    return sorted((q, r + 1, i, s) for q, found in best.items()
                  for r, (s, i) in enumerate((-n, i) for n, i in sorted((-s, i) for i, s in found.items())[:k]))


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as rank", "2 as score", "3 as v", "4 as members")
    return sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5, **options).collect())


def test_agrees_with_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(400)]
    rows += [(i, [round(rng.random()) / 1.0 for _ in range(24)]) for i in range(400, 500)]  # many ties
    rows += [(500, None), (None, rows[0][1]), (501, [None] * 24), (502, [float("nan")] * 24), (550, [float("inf")] + [0.0] * 23), (600, [1.0, 2.0]), (601, [1.5, -2.0]), (650, []), (651, [])]
    rows += [rows[7]] * 3 + [(50, [rng.gauss(0, 1) for _ in range(24)])] + [(700 + i, rows[1][1]) for i in range(9)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, block_bytes=8 * 24 * 3) == want
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == [] and found(spark, [(0, [1.0])]) == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [30_000_000.0 / 256] * 20 + [1.0 / 256]), (1, [29_999_999.0 / 256] * 20 + [3.0 / 256]), (2, [29_999_999.0 / 256] * 20 + [2.0 / 256])]
    assert found(spark, rows) == brute(rows)


@given(st.integers(0, 10_000), st.integers(1, 70))
@settings(max_examples=60, deadline=None)
def test_statistics_bound_the_product(seed, width):
    rng = np.random.default_rng(seed)
    a, b = np.floor(rng.normal(size=(5, width)) * 100), np.floor(rng.normal(size=(6, width)) * 100)
    true, last = a @ b.T, None
    for segments in topk.LEVELS:
        bound = topk.statistics(a, segments) @ topk.statistics(b, segments).T
        assert (bound >= true - 1e-6).all()
        assert last is None or width % 16 or (bound <= last + 1e-6).all()
        last = bound


def test_structured_vectors_are_pruned():
    rng = np.random.default_rng(1)
    steps = np.floor(np.repeat(rng.normal(size=(4000, 4)) * 200, 16, axis=1) + rng.normal(size=(4000, 64)) * 5)
    block = topk.Block(np.arange(20), steps[:20], 5)
    q, r = block.survivors(steps, np.sort(steps[:20] @ steps.T, axis=1)[:, -6])
    assert len(q) < 0.02 * 20 * 4000


def test_queries_from_another_table(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(300)]
    asked = [(1000 + i, [rng.gauss(3, 1) for _ in range(24)]) for i in range(30)] + [(5, [rng.gauss(3, 1) for _ in range(24)])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(asked, SCHEMA), 5).collect()
    whole = lambda v: [math.floor(256 * x) for x in v]
    want = []
    for q, a in asked:
        scores = sorted((-sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), i) for i, b in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_full_block_takes_bounded_memory():
    import resource

    rng = np.random.default_rng(3)
    queries = np.floor(rng.normal(size=(65_536, 64)) * 256)
    rows = np.floor(rng.normal(size=(2_048, 64)) * 256)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    held = topk.searches({64: (np.arange(65_536), queries)}, 5)
    for tile in held[64]:
        tile.meet(np.arange(100_000, 102_048), rows)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kilobytes
    q = 40_000
    want = sorted(zip((-(rows @ queries[q])).astype(int).tolist(), range(100_000, 102_048), strict=True))[:5]
    tile = held[64][q // topk._CHUNK]
    mine = tile.q == q % topk._CHUNK
    assert [(-s, r) for s, r in zip(tile.s[mine].tolist(), tile.r[mine].tolist(), strict=True)] == want

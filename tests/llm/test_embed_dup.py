from __future__ import annotations

import math
import random

import numpy as np
import pytest

from codestrata.llm import embed_dup

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.93):
    whole = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for label, width in {(rows[i][2], len(rows[i][1])) for i in whole}:
        places = [i for i in whole if rows[i][2] == label and len(rows[i][1]) == width]
        m = np.array([rows[i][1] for i in places])
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        for a, hits in zip(places, m @ m.T >= cosine, strict=True):
            near[a] = [places[j] for j in np.flatnonzero(hits) if places[j] != a]
    comp = {}
    for i in range(len(rows)):
        if i not in comp:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            comp.update(dict.fromkeys(seen, min(ids) if ids else None))
    return sorted(((r[0], len(near[i]), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)), key=repr)


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(4).selectExpr("*", "1 as node", "2 as v", "3 as key", "4 as core", "5 as rows", "6 as weight")
    return sorted(map(tuple, embed_dup.links(df, **options).collect()), key=repr)


def moved(rng, v, by):
    return [x + rng.gauss(0, by) for x in v]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(2)
    rows = []
    for label in (0, 1):
        for _ in range(120):
            v = [rng.gauss(0, 1) for _ in range(32)]
            rows += [(moved(rng, v, 0.05), label) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    center = [rng.gauss(0, 1) for _ in range(32)]
    rows += [(moved(rng, center, 0.1), 0) for _ in range(150)]
    far = [x + 0.3 * rng.choice([-1, 1]) for x in center]
    rows += [(moved(rng, far, 0.03), 0) for _ in range(40)]
    rows += [(rows[4][0], 0)] * 30 + [(rows[4][0], 1)] * 3 + [([2 * x for x in rows[4][0]], 0)]
    rng.shuffle(rows)
    rows = [(i, v, label) for i, (v, label) in enumerate(rows)]
    v = rows[9][1]
    rows += [(900, None, 0), (901, v, None), (902, [0.0] * 32, 0), (903, [float("nan")] * 32, 0), (904, [None] + v[1:], 0), (905, [float("inf")] + v[1:], 0),
             (906, [], 0), (907, [1.0, 2.0], 0), (908, [1.0, 2.01], 0), (None, v, rows[9][2]), (None, [5.0] * 3, 7), rows[9], (909, [1e300, 1e300], 0),
             (910, [1e-300, 2e-300], 0), (911, [0.0, -0.0, 1.0], 4), (912, [-0.0, 0.0, 1.0], 4)]
    return rows


def test_agrees_with_all_pairs(spark, vectors):
    want = brute(vectors)
    assert found(spark, vectors) == want


def test_small_cells_cores_and_parts(spark, vectors):
    # 24 rows a block: several tables, cells in parts, and a core of the large group.
    assert embed_dup.tables(400, 24, 0.93, 0.0005)[0] >= 2
    assert found(spark, vectors, block_bytes=24 * 8 * 32, recall=0.99999) == brute(vectors)


def test_single_precision_and_empty(spark, vectors):
    rows = [r for r in vectors if r[0] is not None and r[0] < 200]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert found(spark, rows, "vec_id long, embedding array<float>, label int") == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_pairs_at_the_threshold_are_found():
    """Half of the pairs just above the threshold, half just below: no false links, and misses within what is calibrated."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = np.where(np.arange(3000) % 2, 0.9301, 0.9299)[:, None]
    rows = np.vstack([a, cos * a + np.sqrt(1 - cos * cos) * side])
    n = len(rows)
    zeros = np.zeros(n, np.int64)
    found, _, verified = embed_dup.linked(rows, zeros + 1, zeros, np.zeros((n, 1), np.int64), zeros - 1, 0, 0.93, 0.0005)
    assert found[:3000][0::2].sum() == 0 and found[:3000][1::2].mean() > 0.997
    assert verified < 0.03 * n * n / 2


def test_tables_keep_the_recall():
    depth, count = embed_dup.tables(100_000, 500, 0.93, 0.01)
    assert depth >= 4
    rng = np.random.default_rng(6)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * side
    gap = embed_dup.distance(0.93)
    shared = (embed_dup._cells(a, depth, count, gap) == embed_dup._cells(b, depth, count, gap)).any(axis=1)
    assert shared.mean() > 0.98
    apart = (embed_dup._cells(a, depth, count, gap) == embed_dup._cells(np.roll(a, 1, axis=0), depth, count, gap)).mean()
    assert apart < 0.02

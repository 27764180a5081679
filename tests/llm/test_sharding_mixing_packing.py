from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codestrata.llm import mixing, ordering, packing, sharding


def test_ranked_agrees_with_a_sort(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, i % 5) for i in range(400)] + [(None, 1, 2), (None, 0, 4)]
    df = spark.createDataFrame(rows, "k string, v long, w long").repartition(7)
    out = ordering.ranked(df, ["k", "v", "w"], group="k", value="w").collect()
    by = defaultdict(list)
    for r in out:
        by[r.k].append(r)
    assert len(out) == len(rows)
    for k, group in by.items():
        group.sort(key=lambda r: r["rank"])
        want = sorted((v, w) for key, v, w in rows if key == k)
        assert [(r.v, r.w) for r in group] == want
        assert [r["rank"] for r in group] == list(range(len(want))) and {r.members for r in group} == {len(want)}
        assert [r.before for r in group] == list(itertools.accumulate([0] + [w for _, w in want]))[:-1]
        assert {r.total for r in group} == {sum(w for _, w in want)}
    assert ordering.ranked(df.where("false"), ["v"]).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 40, 200])
def test_every_shard_holds_the_mixture(awkward, shards):
    rows = sharding.interleaved(awkward, shards).collect()
    docs = awkward.collect()
    want = Counter((d.doc_id, d.source, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in rows) == want
    by, sources = defaultdict(list), Counter(d.source for d in docs)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s, members in by.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        for source, n in sources.items():
            share = sum(r.source == source for r in members)
            assert abs(share - n * len(members) / len(docs)) <= len(sources) + 1
    again = sharding.interleaved(awkward.repartition(5), shards).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard) for r in rows)


def test_sharding_moves_no_text_and_takes_an_empty_table(nothing):
    assert sharding.interleaved(nothing, 40).count() == 0


def poured(sizes, share=1.5, most=2.0):
    """Targets by the rule as it is said: by weight, cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = share * sum(sizes.values()), set(names)
    while free and left > 1e-9:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        over = {s for s in free if target[s] > most * sizes[s]}
        left = sum(target[s] - most * sizes[s] for s in over)
        for s in over:
            target[s] = most * sizes[s]
        free -= over
    return target


def test_targets_are_poured_by_weight(spark):
    for sizes in ({"a": 10, "b": 400, "c": 90, None: 50}, {f"s{i:02d}": 3 + i * i for i in range(20)}, {"é": 0, "z": 5}, {"only": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = poured(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)


def test_taken_words_come_near_the_targets(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, awkward):
        rows = mixing.sampled(df).collect()
        assert len(rows) == df.count()
        sizes, taken, target, biggest = Counter(), Counter(), {}, Counter()
        for r in rows:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
            assert r.size == n and r.taken == r.copies * n and 0 <= r.copies <= 2
            sizes[r.source] += n
            taken[r.source] += r.taken
            biggest[r.source] = max(biggest[r.source], n)
            target[r.source] = r.target
            assert r.source_size is not None
        want = poured(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            # Rows equal in all that decides go together, so the last step may be as large as those.
            assert abs(taken[s] - want[s]) <= biggest[s] * 6
        again = mixing.sampled(df.repartition(7)).collect()
        assert Counter((r.doc_id, r.row.text, r.copies) for r in again) == Counter((r.doc_id, r.row.text, r.copies) for r in rows)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing).count() == 0


def test_weights_make_unequal_odds(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("s").alias("source"),
                                  F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    rows = mixing.sampled(df, weight="w", share=0.4).collect()
    heavy, light = (sum(r.copies for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert sum(r.taken for r in rows) == pytest.approx(0.4 * 16_000, abs=4)
    assert heavy / light == pytest.approx(3.0, rel=0.15)


def test_odds_of_the_query_grow_with_the_size(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, awkward):
        rows = mixing.sampled(df, weight=mixing.log_size).collect()
        assert len(rows) == df.count() and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
        taken, target, biggest = Counter(), {}, Counter()
        for r in rows:
            taken[r.source] += r.taken
            target[r.source] = r.target
            biggest[r.source] = max(biggest[r.source], r.size)
        for s in target:
            assert abs(taken[s] - target[s]) <= biggest[s] * 6


def test_longer_texts_come_more_often(spark):
    from pyspark.sql import functions as F

    long = F.col("id") % 2 == 0
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(long, F.repeat(F.lit("word "), 200)).otherwise("word word").alias("text"), F.lit("s").alias("source"))
    rows = mixing.sampled(df, weight=mixing.log_size, share=0.4).collect()
    heavy, light = (sum(r.copies for r in rows if r.doc_id % 2 == k) for k in (0, 1))
    assert sum(r.taken for r in rows) == pytest.approx(0.4 * 2000 * 202, abs=200)
    assert heavy / light == pytest.approx((math.log1p(200) + 1) / (math.log1p(2) + 1), rel=0.15)


def test_best_bounds_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        m = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(np.arange(40), m, replace=False))
        counts = rng.integers(1, 9, m)
        for buckets in range(1, 5):
            def padding(bounds):
                return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
            best = min(padding({*some, lengths[-1]}) for k in range(min(buckets, m)) for some in itertools.combinations(lengths.tolist(), k))
            got = packing.best_bounds(lengths, counts, buckets)
            assert len(got) <= buckets and padding(got) == best
    assert packing.best_bounds(np.array([], np.int64), np.array([], np.int64), 4) == []


def test_batches_keep_the_budget(spark, nothing):
    rows = [(i, (i * i) % 300) for i in range(500)] + [(None, None), (7, 7), (7, 7), (900, 5000), (901, 0)] + [(1000 + i, 12) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(5).selectExpr("*", "1 as bucket", "2 as batch", "3 as rank", "4 as length")
    out = packing.packed(df, "n", buckets=6, budget=600).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter((i, n or 0) for i, n in rows)
    batches = defaultdict(list)
    for r in out:
        batches[r.bucket, r.batch].append(r)
    for (bucket, _), members in batches.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        padded = {r.padded for r in members}
        assert len(padded) == 1 and all(r.length <= r.padded for r in members)
        if bucket < 0:
            assert len(members) == 1 and members[0].length > 600
        else:
            assert len(members) * padded.pop() <= 600 or len(members) == 1
    room = {b: 600 // max(1, m[0].padded) for (b, _), m in batches.items() if b >= 0}
    for b, most in room.items():
        sizes = [len(m) for (k, _), m in sorted(batches.items()) if k == b]
        assert all(s == most for s in sizes[:-1])
    assert packing.packed(nothing, "n_words").count() == 0

from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def measures(df):
    return [(r.row.text, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.judged(df).collect()]


def test_measures_agree_with_a_direct_count(spark, awkward):
    rng = random.Random(2)
    texts = [None, "", "a b c d e a b c d e", "a\n\na\n b\x0b#<é😀"]
    texts += ["".join(rng.choice("ab  \n#é") for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for text, got in measures(df) + measures(awkward):
        assert got == brute(text)


def test_verdict_is_the_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.judged(docs).collect()
    for r in rows:
        assert r.kept == (not r.failed) and (not r.base_failed or not r.kept)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.row.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.row.doc_id) == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rows_stay_whole(awkward, nothing):
    assert quality.judged(awkward).count() == awkward.count()
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert quality.keep_good(nothing).count() == 0


def test_one_projection_without_shuffle_or_user_functions(awkward):
    plan = quality.judged(awkward.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@given(st.floats(0, 10), st.floats(0, 10))
@settings(max_examples=5, deadline=None)
def test_open_bounds_pass(low, high):
    assert quality.Rule("r", "m").low is None and quality.Rule("r", "m", low=low, high=high).high == high

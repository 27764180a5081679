from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codestrata.functions import records
from codestrata.sources import landed


def bodies(spark, *documents):
    texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(texts, "id int, body string")


FULL = {"sha": "s", "commit": {"message": "m", "author": {"name": "n", "email": "e", "date": "d"}}}


def changed(**author):
    return {"sha": "s", "commit": {"message": "m", "author": {**FULL["commit"]["author"], **author}}}


def test_malformed_commits_are_set_aside(spark):
    df = bodies(
        spark,
        FULL,
        changed(email=None),
        {"sha": "s"},
        {"sha": "s", "commit": None},
        {"sha": "s", "commit": {"message": "m", "author": None}},
        {"sha": "s", "commit": "text"},
        {"sha": "s", "commit": {"message": None, "author": FULL["commit"]["author"]}},
        "{broken",
        "[]",
        "null",
    )
    kept, rejected = landed.flatten(df, "body", records.COMMIT_PATHS, keep=("id",))
    assert {r.id: (r.message, r.email) for r in kept.collect()} == {0: ("m", "e"), 1: ("m", None), 6: (None, "e")}
    assert {r.id for r in rejected.collect()} == {2, 3, 4, 5, 7, 8, 9}


def test_flat_pull_requests(spark):
    df = bodies(spark, {"number": 7, "title": "t", "state": "open", "user": {"login": "u"}, "created_at": "c"}, {"number": 8, "title": "t", "state": "open", "user": None, "created_at": "c"})
    kept, rejected = landed.flatten(df, "body", records.PR_PATHS, records.PR_TYPES)
    assert [tuple(r) for r in kept.collect()] == [(7, "t", "open", "u", "c")]
    assert rejected.count() == 1


def test_metadata_default_is_for_absent_keys_only(spark):
    df = bodies(spark, {}, {"description": None, "stargazers_count": None, "name": "x", "forks_count": 3})
    got = [tuple(r) for r in df.orderBy("id").select(*landed.repo_metadata("body")).collect()]
    assert got == [("", "", "", 0, 0), ("x", None, "", None, 3)]


@pytest.mark.parametrize("files, want", [
    (None, ""),
    ([], ""),
    ([("a", "+1"), ("b", None), ("c", ""), ("d", "-2\n+3")], "--- a\n+1\n--- d\n-2\n+3"),
    ([("b", None)], ""),
])
def test_commit_diff(spark, files, want):
    df = spark.createDataFrame([(files,)], "files array<struct<filename string, patch string>>")
    assert df.select(records.commit_diff(F.col("files"))).first()[0] == want


@pytest.mark.parametrize("url, status, text, want", [
    ("/p", 200, "diff", "diff"), ("/p", 404, "diff", ""), ("", 200, "diff", ""), (None, 200, "diff", ""), ("/p", None, "diff", ""), ("/p", 200, None, ""),
])
def test_patch_fallback(spark, url, status, text, want):
    df = spark.createDataFrame([(url, status, text)], "u string, s int, t string")
    assert df.select(records.patch_or_empty(F.col("u"), F.col("s"), F.col("t"))).first()[0] == want


def test_snippets_are_line_slices(spark):
    contents = ["a\nb\nc", "", "one", "é\n\n😀x\n", "\n\n\n", "x\r\ny"]
    cases = [(c, s, e) for c in contents for s in range(1, 6) for e in range(s - 1, 7)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, s int, e int")
    got = [r[0] for r in df.orderBy("i").select(records.snippet(F.split("c", "\n"), F.col("s"), F.col("e"))).collect()]
    assert got == ["\n".join(c.split("\n")[s - 1 : e]) for c, s, e in cases]

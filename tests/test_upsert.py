from __future__ import annotations

import random
import sqlite3

from pyspark.sql import functions as F

from codestrata.operators import constraints, upsert

SCHEMA = "repo string, commit_sha string, message string, at int"


def test_insert_or_ignore_agrees_with_sqlite(spark, rows):
    rng = random.Random(5)
    # One key takes a third of the rows, and null keys never conflict.
    keys = [rng.choice(["hot", None, *"abcdefgh"]) if rng.random() < 0.7 else "hot" for _ in range(300)]
    incoming = [("r", k, f"m{i}", i) for i, k in enumerate(keys)]
    existing = [("r", "a", "old a", -2), ("r", "z", "old z", -1)]
    con = sqlite3.connect(":memory:")
    con.execute("create table t (repo text, commit_sha text primary key, message text, at int)")
    con.executemany("insert or ignore into t values (?, ?, ?, ?)", existing + incoming)
    want = sorted(con.execute("select * from t").fetchall(), key=repr)
    rng.shuffle(incoming)
    for small in (False, True):
        table = spark.createDataFrame(existing, SCHEMA)
        new = spark.createDataFrame(incoming, SCHEMA).repartition(5)
        fresh = upsert.new_rows(table, new, ["repo", "commit_sha"], ["at"], small_batch=small)
        assert rows(table.unionByName(fresh)) == want
    again = upsert.insert_or_ignore(spark.createDataFrame(want, SCHEMA).filter("commit_sha is not null"), spark.createDataFrame(incoming, SCHEMA).filter("commit_sha is not null"), ["repo", "commit_sha"], ["at"])
    assert rows(again) == [r for r in want if r[1] is not None]


def test_file_ids_are_stable_and_null_paths_ignored(spark, rows):
    paths = spark.createDataFrame([("r", "a"), ("r", "A"), ("r", "a"), ("q", "a"), ("r", None)], "repo string, current_path string")
    first = upsert.file_dictionary(paths)
    assert [r[::2] for r in rows(first)] == [("q", "a"), ("r", "A"), ("r", "a")] or first.count() == 3
    more = upsert.file_dictionary(paths.unionByName(spark.createDataFrame([("r", "b")], paths.schema)), first)
    ids = {(r.repo, r.current_path): r.file_id for r in first.collect()}
    grown = {(r.repo, r.current_path): r.file_id for r in more.collect()}
    assert len(grown) == 4 and all(grown[k] == v for k, v in ids.items())
    given = spark.createDataFrame([("r", 7, "a")], "repo string, file_id bigint, current_path string")
    kept = {(r.repo, r.current_path): r.file_id for r in upsert.file_dictionary(paths, given).collect()}
    assert kept["r", "a"] == 7 and len(kept) == 3


def test_indexing_again_replaces(spark, rows):
    schema = "repo string, commit_sha string, name string"
    table = spark.createDataFrame([("r", "1", "a"), ("r", "1", "a"), ("r", "2", "b"), ("q", "1", "c")], schema)
    again = spark.createDataFrame([("r", "1", "x")], schema)
    want = [("q", "1", "c"), ("r", "1", "x"), ("r", "2", "b")]
    once = upsert.replace_symbols(table, again)
    assert rows(once) == want
    assert rows(upsert.replace_symbols(once, again)) == want


def test_constraints(spark):
    schema = "repo string, file_id bigint, commit_sha string, kind string, name string"
    symbols = spark.createDataFrame([
        ("r", 1, "c", "function", "ok"), ("r", 1, "c", None, "null kind passes"), ("r", None, "c", "class", "n"),
        ("r", 1, None, "class", "n"), ("r", 1, "c", "method", "n"), ("r", 1, "c", "class", None), ("r", None, None, "x", None),
    ], schema)
    good, bad = constraints.split_valid(symbols)
    assert {r.name for r in good.collect()} == {"ok", "null kind passes"}
    assert sorted(r.violation for r in bad.collect()) == [
        "commit_sha is null", "file_id is null", "file_id is null", "kind not allowed", "name is null",
    ]


def test_orphans(spark):
    symbols = spark.createDataFrame([("r", 1, "c"), ("r", 2, "c"), ("q", 1, "d")], "repo string, file_id bigint, commit_sha string")
    files = spark.createDataFrame([("r", 1)], "repo string, file_id bigint")
    commits = spark.createDataFrame([("r", "c")], "repo string, commit_sha string")
    found = constraints.orphans(symbols, files, commits)
    assert {(r.repo, r.file_id, r.missing) for r in found.collect()} == {("r", 2, "files"), ("q", 1, "files"), ("q", 1, "commits")}


def test_first_write_is_pre_aggregated(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    plan = upsert.first_write(df, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan

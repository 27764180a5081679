from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from codestrata.operators import lookups, ranking
from codestrata.plans import index

RNG = random.Random(11)
FILES = [("r", i, f"src/{RNG.choice('abAé_')}{i}.py") for i in range(1, 41)]
SYMBOLS = [
    ("r", i, RNG.choice([1, *range(2, 38)]) if i % 3 else 1, f"c{i % 4}", RNG.choice(["function", "class", None]), RNG.choice(["load", "Load_x", "Ünload", "run%"]), RNG.randrange(1, 99), i)
    for i in range(600)
]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(FILES, "repo string, file_id bigint, current_path string")
    symbols = spark.createDataFrame(
        SYMBOLS, "repo string, symbol_id bigint, file_id bigint, commit_sha string, kind string, name string, start_line int, end_line int"
    )
    return symbols.repartition(4), files


@pytest.fixture(scope="module")
def lite():
    con = sqlite3.connect(":memory:")
    con.execute("create table files (repo, file_id integer, current_path text)")
    con.execute("create table symbols (repo, symbol_id, file_id, commit_sha, kind, name, start_line, end_line)")
    con.executemany("insert into files values (?, ?, ?)", FILES)
    con.executemany("insert into symbols values (?, ?, ?, ?, ?, ?, ?, ?)", SYMBOLS)
    return con


def test_all_symbols(tables, lite):
    got = [tuple(r)[1:] for r in lookups.all_symbols(*tables).collect()]
    want = lite.execute(
        "select current_path, kind, name, start_line, end_line from symbols join files using (file_id)"
        " order by current_path, start_line, name, kind, end_line, commit_sha"
    ).fetchall()
    assert got == want


@pytest.mark.parametrize("pattern", ["load", "LOAD_", "ü", "n%", "zzz"])
def test_search(tables, lite, pattern):
    got = sorted((tuple(r)[1:] for r in lookups.symbol_search(*tables, pattern).collect()), key=repr)
    want = lite.execute(
        "select current_path, kind, name, start_line, end_line from symbols join files using (file_id) where name like ?", (f"%{pattern}%",)
    ).fetchall()
    assert got == sorted(want, key=repr)


def test_file_statistics(tables, lite):
    got = [tuple(r)[1:] for r in lookups.file_statistics(*tables).collect()]
    want = lite.execute(
        "select current_path, count(case when kind = 'function' then 1 end) f, count(case when kind = 'class' then 1 end) c"
        " from files left join symbols using (file_id) group by current_path order by f + c desc, current_path"
    ).fetchall()
    assert got == want and any(r[1:] == (0, 0) for r in got)


def test_top_function_files(tables, lite):
    got = [tuple(r)[1:] for r in lookups.top_function_files(*tables, 7).collect()]
    want = lite.execute(
        "select current_path, count(*) n from symbols join files using (file_id) where kind = 'function'"
        " group by current_path order by n desc, current_path limit 7"
    ).fetchall()
    assert got == want


@pytest.mark.parametrize("cap", [1, 5, 200, 900])
def test_report_symbols_are_the_first_of_all(tables, cap):
    every = [tuple(r)[1:] for r in lookups.all_symbols(*tables).collect()]
    listed = lookups.report_symbols(*tables, cap).orderBy("rank")
    assert [tuple(r) for r in listed.select("current_path", "kind", "name", "start_line", "end_line").collect()] == every[:cap]


def test_names_by_file(spark):
    ranked = spark.createDataFrame(
        [("r", 1, "a", "function", "f1"), ("r", 2, "a", "class", "C"), ("r", 3, "a", "function", "f2"), ("r", 4, "b", None, "n"), ("r", 5, "c", "class", "D"), ("r", 6, "d", "class", "late")],
        "repo string, rank int, current_path string, kind string, name string",
    )
    got = lookups.names_by_file(ranked, symbols=5, files=3, names=1).orderBy("file_rank")
    assert [tuple(r)[1:] for r in got.collect()] == [(1, "a", "f1", "C"), (2, "b", "", ""), (3, "c", "", "D")]


def test_caps_keep_the_newest_of_a_hot_repository(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("repo"),
        F.timestamp_seconds((F.col("id") * 7919 % 5003).cast("bigint")).alias("committed_at"),
        F.md5(F.col("id").cast("string")).alias("commit_sha"),
    )
    pdf = df.toPandas().sort_values(["committed_at", "commit_sha"], ascending=[False, True])
    got = ranking.recent_commits(df.repartition(7), 10).toPandas()
    for repo, group in pdf.groupby("repo"):
        assert got[got.repo == repo].sort_values("rank").commit_sha.tolist() == group.commit_sha.head(10).tolist()


def test_repo_stats(spark, tables):
    symbols, files = tables
    repos = spark.createDataFrame([("r",), ("empty",)], "repo string")
    commits = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, commit_sha string")
    prs = spark.createDataFrame([], "repo string, number bigint")
    used = len({s[2] for s in SYMBOLS})
    kinds = [s[4] for s in SYMBOLS]
    for empty_too, stored in ((False, used), (True, len(FILES))):
        got = {r.repo: tuple(r)[1:] for r in lookups.repo_stats(repos, commits, prs, files, symbols, empty_too).collect()}
        assert got == {"r": (2, 0, kinds.count("function"), kinds.count("class"), stored), "empty": (0, 0, 0, 0, 0)}


def test_head_fallback(spark):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    commits = spark.sql("select * from values ('a', 'a1', timestamp'2024-01-01'), ('a', 'a2', timestamp'2024-01-02'), ('b', 'b1', timestamp'2024-01-01') as t(repo, commit_sha, committed_at)")
    heads = spark.createDataFrame([("a", "tree")], "repo string, head_sha string")
    assert dict(index.head_commits(repos, commits, heads).collect()) == {"a": "tree", "b": "b1", "c": "unknown"}
    assert dict(index.head_commits(repos, commits).collect()) == {"a": "a2", "b": "b1", "c": "unknown"}

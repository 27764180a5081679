"""Indexing into tables that stay: blobs are parsed once, old rows keep their ids, and dead runs leave nothing."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codestrata import schemas, session
from codestrata.operators import ranking, upsert
from codestrata.plans import index
from codestrata.session import stage
from codestrata.sources import tables

A, B, C = "def a():\n    pass\nclass K:\n    def m(self): pass\n", "def b():\n    pass\n", "def broken(:\n"
TREE = "repo string, path string, content string"


def tree_of(spark, rows):
    return spark.createDataFrame(rows, TREE).repartition(3)


def commits_of(spark, *rows):
    return spark.createDataFrame([(r, sha, "n", "e", "m", None) for r, sha in rows], schemas.COMMITS).withColumn("committed_at", F.lit("2024-01-01").cast("timestamp"))


def heads_of(spark, **heads):
    return spark.createDataFrame(list(heads.items()), "repo string, head_sha string")


@pytest.fixture
def indexing(spark, tmp_path):
    root = str(tmp_path / "index")

    def run(rows, heads, **options):
        counter = spark.sparkContext.accumulator(0)
        done = index.index_into(root, tree_of(spark, rows), commits_of(spark, *heads.items()), heads_of(spark, **heads), parses=counter, **options)
        return counter.value, sorted(tuple(r) for r in done.repos.collect())

    def listed():
        found = index.read_index(spark, root)
        paths = {r.file_id: (r.repo, r.current_path) for r in found.files.collect()}
        return sorted((paths[r.file_id][0], r.commit_sha, paths[r.file_id][1], r.kind, r.name, r.start_line, r.end_line) for r in found.symbols.collect())

    run.listed, run.root = listed, root
    return run


def symbols(repo, sha, path, *which):
    spans = {"a": ("function", "a", 1, 2), "K": ("class", "K", 3, 4), "m": ("function", "m", 4, 4), "b": ("function", "b", 1, 2)}
    return [(repo, sha, path, *spans[w]) for w in which]


def test_a_blob_is_parsed_once_over_repositories_and_runs(spark, indexing):
    rows = [("r", "x.py", A), ("r", "copy/x.py", A), ("q", "y.py", A), ("q", "z.py", B), ("q", "bad.py", C), ("q", "c.js", A), ("q", "venv/d.py", B + "#"), ("q", "e.py", None)]
    heads = {"r": "r1", "q": "q1"}
    want = sorted(symbols("r", "r1", "x.py", *"aKm") + symbols("r", "r1", "copy/x.py", *"aKm") + symbols("q", "q1", "y.py", *"aKm") + symbols("q", "q1", "z.py", "b"))
    assert indexing(rows, heads) == (3, [("q", "q1"), ("r", "r1")])
    assert indexing.listed() == want
    # The same again parses and writes nothing.
    assert indexing(rows, heads) == (0, [])
    assert indexing.listed() == want and len(tables.lineage_tables(spark, indexing.root).runs()) == 1
    errors = index.blob_table(spark, indexing.root).read("parsed").where("error is not null").collect()
    assert len(errors) == 1 and "SyntaxError" in errors[0].error
    # Options are part of what a blob was parsed with.
    assert indexing(rows, heads, include_decorators=True)[0] == 3


def test_one_changed_file_parses_one_blob_and_keeps_the_past(spark, indexing):
    rows = [("r", "x.py", A), ("r", "y.py", B), ("q", "y.py", B)]
    indexing(rows, {"r": "r1", "q": "q1"})
    ids = {(r.repo, r.current_path): r.file_id for r in index.read_index(spark, indexing.root).files.collect()}
    changed = [("r", "x.py", A), ("r", "y.py", B + "def c():\n    pass\n"), ("r", "new.py", A), ("q", "y.py", B)]
    assert indexing(changed, {"r": "r2", "q": "q1"}) == (1, [("r", "r2")])
    new = [("r", "r2", "y.py", "function", "c", 3, 4)]
    want = sorted(symbols("r", "r1", "x.py", *"aKm") + symbols("r", "r1", "y.py", "b") + symbols("q", "q1", "y.py", "b")
                  + symbols("r", "r2", "x.py", *"aKm") + symbols("r", "r2", "new.py", *"aKm") + symbols("r", "r2", "y.py", "b") + new)
    assert indexing.listed() == want
    grown = {(r.repo, r.current_path): r.file_id for r in index.read_index(spark, indexing.root).files.collect()}
    assert len(set(grown.values())) == 4 and all(grown[k] == v for k, v in ids.items())
    # The same commit from another tree replaces its symbols and no others'.
    assert indexing([("r", "x.py", B)], {"r": "r2"}) == (0, [("r", "r2")])
    replaced = sorted([s for s in want if s[1] != "r2"] + symbols("r", "r2", "x.py", "b"))
    assert indexing.listed() == replaced
    index.compact_index(spark, indexing.root)
    assert indexing.listed() == replaced and len(tables.lineage_tables(spark, indexing.root).runs()) == 1
    assert tables.lineage_tables(spark, indexing.root).read("symbols").count() == len(replaced)
    assert indexing([("r", "x.py", B)], {"r": "r2"}) == (0, [])


def test_a_run_that_dies_is_not_read_and_starts_again(spark, indexing, monkeypatch):
    rows, heads = [("r", "x.py", A)], {"r": "r1"}

    class Killed(Exception):
        pass

    def dying(self, *args, **kwargs):
        if "symbols" in kwargs:
            kwargs["symbols"].select(*self.schemas["symbols"].fieldNames()).write.parquet(f"{self.root}/symbols/half")
            raise Killed
        return append(self, *args, **kwargs)

    append = index.RunTables.append
    monkeypatch.setattr(index.RunTables, "append", dying)
    with pytest.raises(Killed):
        indexing(rows, heads)
    monkeypatch.setattr(index.RunTables, "append", append)
    assert indexing.listed() == []
    assert indexing(rows, heads) == (0, [("r", "r1")])  # what was parsed before stays known
    assert indexing.listed() == sorted(symbols("r", "r1", "x.py", *"aKm"))


def test_empty_files_repeated_paths_and_empty_trees(spark, indexing):
    assert indexing([], {"r": "r1"}) == (0, [])
    rows = [("r", "x.py", A), ("r", "x.py", A), ("r", "empty.py", ""), ("r", "notes.js", "let a"), ("hot", "__init__.py", "")] + [("hot", f"p{n}/__init__.py", "") for n in range(200)]
    parsed, _ = indexing(rows, {"r": "r1"}, store_empty_files=True)
    assert parsed == 3
    found = index.read_index(spark, indexing.root)
    assert found.files.count() == 204 and indexing.listed() == sorted(symbols("r", "r1", "x.py", *"aKm"))
    assert {(r.repo, r.commit_sha) for r in tables.lineage_tables(spark, indexing.root).read("indexed").collect()} == {("r", "r1"), ("hot", "unknown")}


def test_numbers_are_dense_whatever_the_parts(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "x")
    got = ranking.numbered(df, "n", 41).collect()
    assert sorted(r.n for r in got) == list(range(42, 1042)) and len({r.x for r in got}) == 1000
    assert ranking.numbered(df.limit(0), "n").count() == 0


def test_files_whose_hashes_collide_keep_their_own_ids(spark, monkeypatch):
    # Whatever a 64-bit hash gives, ids are counted.
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    paths = spark.createDataFrame([("r", f"f{n}.py") for n in range(50)] + [("q", "f1.py")], "repo string, current_path string").repartition(5)
    first = upsert.file_dictionary(paths.limit(20)).collect()
    grown = upsert.file_dictionary(paths, spark.createDataFrame(first)).collect()
    assert len({r.file_id for r in grown}) == len(grown) == 51
    assert {tuple(r) for r in first} <= {tuple(r) for r in grown}


@pytest.mark.parametrize("order", [1, -1])
def test_rows_without_an_arrival_come_last(spark, order):
    rows = [(1, None, "undated"), (1, "2024-01-02", "late"), (1, "2024-01-01", "early"), (2, None, "only")][::order]
    df = spark.createDataFrame(rows, "k int, at string, m string").repartition(2)
    got = {r.k: r.m for r in upsert.first_write(df, ["k"], ["at"]).collect()}
    assert got == {1: "early", 2: "only"}
    again = upsert.insert_or_ignore(df.limit(0), df, ["k"], ["at", "m"])
    assert {r.k: r.m for r in again.collect()} == got


@pytest.mark.parametrize("run", ["index_repositories", "index_into"])
def test_files_are_dealt_before_they_are_parsed(spark, monkeypatch, tmp_path, run):
    """A stored tree in one split is parsed by as many tasks as a shuffle has, each with its share."""
    parser, shares = {"index_repositories": "python_entities", "index_into": "parse_python"}[run], []
    parse = getattr(index, parser)

    def counted(files, *args, **options):
        shares.extend(files.filter("path like '%.py'").rdd.glom().map(len).collect())
        return parse(files, *args, **options)

    monkeypatch.setattr(index, parser, counted)
    rows = [("r", f"f{n}.{kind}", f"def f{n}():\n    pass\n") for kind in ("js", "py") for n in range(400)]
    tree = spark.createDataFrame(rows, TREE).coalesce(1)
    if run == "index_repositories":
        found = index.index_repositories(tree, commits_of(spark, ("r", "c"))).symbols
    else:
        index.index_into(str(tmp_path / "dealt"), tree, commits_of(spark, ("r", "c")))
        found = index.read_index(spark, str(tmp_path / "dealt")).symbols
    assert found.count() == 400
    assert len(shares) == 4 and min(shares) > 60


def test_what_a_run_staged_goes_with_it(spark, indexing):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "codestrata"
    before = {f for f in shared.rglob("*") if f.is_file()}
    rows = [("r", f"x{n}.py", f"{A}# {n}") for n in range(50)] + [("r", "empty.py", ""), ("q", "bad.py", C)]
    run = index.index_into(indexing.root, tree_of(spark, rows), commits_of(spark, ("r", "r1")))
    assert {f for f in shared.rglob("*") if f.is_file()} == before
    # What it tells can still be read, files without a symbol among it.
    assert run.parsed.count() == 52 and run.parsed.filter("size(symbols) = 0").count() == 2 and run.parsed.filter("error is not null").count() == 1
    assert sorted(map(tuple, run.repos.collect())) == [("q", "unknown"), ("r", "r1")]
    assert len(indexing.listed()) == 150


def test_staged_results_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for folder in manager.localDirs() for f in Path(folder.getPath()).rglob("shuffle_*.data")}

    before = files()
    counted = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and counted.count() == 100
    assert spark.conf.get(session.SHUFFLE_CLEANUP_SETTING, None) in (None, "false")


def test_many_unseen_files_are_dealt_once(spark, indexing, monkeypatch):
    """Beyond a broadcast, one shuffle of the contents serves the join and the parse, which have even shares."""
    shares, parse = [], index.parse_python

    def counted(files, *args, **options):
        shares.extend(files.rdd.glom().map(len).collect())
        return parse(files, *args, **options)

    rows = [("r", f"f{n}.py", f"def f{n}():\n    pass\n") for n in range(400)] + [("r", "twice.py", A), ("r", "twice.py", A)]
    heads = {"r": "c"}
    with monkeypatch.context() as patched:
        patched.setattr(index, "broadcast_if_small", lambda df: df)
        patched.setattr(index, "parse_python", counted)
        indexing(rows, heads)
    assert len(shares) == 4 and min(shares) > 60 and sum(shares) == 402
    want = [("r", "c", f"f{n}.py", "function", f"f{n}", 1, 2) for n in range(400)]
    assert indexing.listed() == sorted(want + symbols("r", "c", "twice.py", *"aKm"))

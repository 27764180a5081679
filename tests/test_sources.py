from __future__ import annotations

import json

import pytest

from codestrata import schemas
from codestrata.operators import vectors
from codestrata.sources import landed, tables, tree


def test_tree_scan(spark, tmp_path):
    root = tmp_path / "co"
    for path, raw in {
        "one/src/__init__.py": b"x = 1\r\ny = 2\rz", "one/_lib/b.js": "é".encode(), "one/bad.py": b"a\xffb\xc3", "two/c.txt": b"", "one/.x/d.py": "�".encode(), "two/venv/e.py": b"",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    found = {
        ("one", "src/__init__.py"): ("x = 1\ny = 2\nz", True), ("one", "_lib/b.js"): ("é", True), ("one", "bad.py"): ("ab", False),
        ("two", "c.txt"): ("", True),
    }
    got = {(r.repo, r.path): (r.content, r.valid_utf8) for r in tree.read_tree(spark, str(root)).collect()}
    assert got == found
    everything = {(r.repo, r.path): (r.content, r.valid_utf8) for r in tree.read_tree(spark, str(root), prune=False, tasks=3).collect()}
    assert everything == {**found, ("one", ".x/d.py"): ("�", True), ("two", "venv/e.py"): ("", True)}
    uri = (root / "one").as_uri()
    single = tree.read_tree(spark, uri, repo="me", wanted=lambda path: path.endswith(".py"))
    assert {(r.repo, r.path) for r in single.collect()} == {("me", "src/__init__.py"), ("me", "bad.py")}


def test_one_large_repository_is_listed_by_many_tasks(spark, tmp_path):
    root = tmp_path / "co"
    for n in range(60):
        folder = root / "giant" / f"d{n % 6}" / f"e{n}" / "deep" / "deeper"
        folder.mkdir(parents=True)
        (folder / "__init__.py").write_text(str(n))
    (root / "empty").mkdir()
    listed = tree.list_tree(spark, str(root), tasks=16).collect()
    assert sorted(r.path for r in listed) == sorted(f"d{n % 6}/e{n}/deep/deeper/__init__.py" for n in range(60))
    assert {r.repo for r in listed} == {"giant"} and len({r.task for r in listed}) > 8
    assert tree.list_tree(spark, str(root / "empty"), repo="empty").count() == 0
    with pytest.raises(Exception, match="absent"):
        tree.list_tree(spark, str(root / "absent"))


def test_metadata_that_is_no_json_is_set_aside(spark):
    bodies = [('{"name": "a", "stargazers_count": 3}',), ("{}",), ("not json",), ("[1]",), (None,), ('{"description": null}',)]
    df = spark.createDataFrame(bodies, "body string")
    found, quarantine = landed.read_metadata(df, "body")
    assert sorted((r.name, r.stars) for r in found.collect()) == [("", 0), ("", 0), ("a", 3)]
    assert sorted(str(r.body) for r in quarantine.collect()) == ["None", "[1]", "not json"]


COMMIT = {
    "sha": "s", "message": "m", "author": {"name": "n", "email": "e", "date": "2024-01-02T03:04:05Z"},
    "committer": {"name": "c", "email": "e", "date": "2024-01-02T03:04:06Z"}, "url": "u", "code_diff": "",
}


def test_commit_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([COMMIT, {**COMMIT, "sha": "t", "author": None}], indent=2))
    (tmp_path / "broken.json").write_text('[{"sha": "x", ')
    (tmp_path / "empty.json").write_text("[]")
    good, quarantine = landed.read_json(spark, str(tmp_path), schemas.COMMIT_DOCUMENT)
    flat = {r.sha: r for r in landed.flatten_commits(good).collect()}
    assert set(flat) == {"s", "t"}
    assert str(flat["s"].committed_at) == "2024-01-02 03:04:06" and flat["s"].author_name == "n"
    assert flat["t"].author_name is None
    assert [r.file.rsplit("/", 1)[1] for r in quarantine.collect()] == ["broken.json"]
    none, nothing = landed.read_json(spark, str(tmp_path / "absent"), schemas.COMMIT_DOCUMENT)
    assert quarantine.count() == 1 and none.count() == 0 and nothing.count() == 0 and none.schema == schemas.COMMIT_DOCUMENT


def test_json_of_any_size_and_odd_records(spark, tmp_path):
    long = "x" * 21_000_000
    texts = {
        "long.json": json.dumps([{**COMMIT, "sha": "long", "message": long}]), "twice.json": '[{"sha": "first", "sha": "twice"}]',
        "kinds.json": '[{"sha": "k", "author": "nobody"}, {"author": 3}]', "number.json": "7", "nothing.json": "", "cut.json": '[{"sha": "c"}, {"sha"',
    }
    for name, content in texts.items():
        (tmp_path / name).write_text(content)
    with (tmp_path / "wide.json").open("w") as out:
        out.write("[" + ",".join(json.dumps({"sha": f"w{i}", "message": "m" * 100_000}) for i in range(1400)) + "]")
    good, quarantine = landed.read_json(spark, str(tmp_path), schemas.COMMIT_DOCUMENT)
    assert {r.sha for r in good.select("sha").collect()} == {"long", "twice", "k", *(f"w{i}" for i in range(1400))}
    assert good.where("length(message) = 21000000").count() == 1
    assert sorted(r.file.rsplit("/", 1)[1] for r in quarantine.collect()) == ["cut.json", "kinds.json", "number.json"]


def test_links_are_not_followed_and_unreadable_files_flagged(spark, tmp_path, monkeypatch):
    root = tmp_path / "co"
    (root / "one").mkdir(parents=True)
    (root / "one" / "a.py").write_text("x")
    (root / "one" / "loop").symlink_to(root / "one")
    (root / "one" / "out").symlink_to("/etc")
    (root / "one" / "gone.py").symlink_to(root / "missing.py")
    assert [(r.path, r.content) for r in tree.read_tree(spark, str(root)).collect()] in ([("a.py", "x")], [("a.py", "x"), ("gone.py", None)], [("gone.py", None), ("a.py", "x")])


def test_pull_request_documents(spark, tmp_path):
    ref = {"ref": "main", "sha": "f"}
    document = {
        "number": 3, "title": "t", "body": None, "state": "closed", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z",
        "closed_at": "2024-01-02T00:00:00Z", "merged_at": None, "user": {"login": "u", "avatar_url": "a"}, "head": ref, "base": ref,
        "url": "u", "diff_url": "d", "patch_url": "p", "code_diff": "",
    }
    (tmp_path / "prs.json").write_text(json.dumps([document]))
    good, _ = landed.read_json(spark, str(tmp_path / "prs.json"), schemas.PR_DOCUMENT)
    row = landed.flatten_prs(good).first()
    assert (row.number, row.body, row.merged_at, row.user_login, row.head_ref, str(row.closed_at)) == (3, "", None, "u", "main", "2024-01-02 00:00:00")


def test_pages_stop_at_the_first_short_one(spark):
    sizes = {
        "all full": {1: 3, 2: 3, 3: 3}, "short last": {1: 3, 2: 1}, "short first": {1: 2, 2: 3}, "gap": {1: 3, 3: 3}, "no first": {2: 3},
        "hot": {p: 3 for p in range(1, 200)},
    }
    data = [(s, p, i) for s, pages in sizes.items() for p, n in pages.items() for i in range(n)]
    df = spark.createDataFrame(data, "source string, page int, item int")
    got = {}
    for r in landed.read_pages(df, page_size=3).collect():
        got.setdefault(r.source, []).append(r.page)
    assert {s: (max(p), len(p)) for s, p in got.items()} == {
        "all full": (3, 9), "short last": (2, 4), "short first": (1, 2), "gap": (1, 3), "hot": (199, 597),
    }


def test_lineage_tables(spark, tmp_path, rows):
    root = str(tmp_path / "lineage")
    assert tables.read_lineage(spark, root, "files").count() == 0
    files = spark.createDataFrame([("r", 1, "a"), ("q", 2, "b")], schemas.FILES)
    tables.write_lineage(root, files=files)
    assert rows(tables.read_lineage(spark, root, "files")) == [("q", 2, "b"), ("r", 1, "a")]
    # Paths that are there keep their ids.
    tables.write_lineage(root, files=spark.createDataFrame([("r", 9, "z"), ("r", 7, "a")], schemas.FILES))
    read = tables.read_lineage(spark, root, "files")
    assert rows(read) == [("q", 2, "b"), ("r", 1, "a"), ("r", 9, "z")]
    plan = read.filter("repo = 'r'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(repo), EqualTo(repo,r)" in plan


def test_symbols_of_earlier_commits_stay(spark, tmp_path):
    root = str(tmp_path / "lineage")

    def written(*symbols):
        tables.write_lineage(root, symbols=spark.createDataFrame([("r", n, 1, sha, "function", name, 1, 2) for n, (sha, name) in enumerate(symbols)], schemas.SYMBOLS))
        return sorted((r.commit_sha or "", r.name) for r in tables.read_lineage(spark, root, "symbols").collect())

    assert written(("c1", "a"), ("c1", "b"), (None, "n")) == [("", "n"), ("c1", "a"), ("c1", "b")]
    assert written(("c2", "a")) == [("", "n"), ("c1", "a"), ("c1", "b"), ("c2", "a")]
    assert written(("c1", "x"), (None, "m")) == [("", "m"), ("c1", "x"), ("c2", "a")]
    # One folder a run, whatever the number of repositories.
    many = spark.range(500).selectExpr("concat('r', id) as repo", "id as file_id", "'p' as current_path")
    tables.write_lineage(root, files=many)
    assert len(list((tmp_path / "lineage" / "files").iterdir())) == 4


def test_entity_sink(spark, tmp_path):
    entities = spark.createDataFrame([("r", "class", "A", "python", "a.py", None, "", "class A: pass", 1, 1, "class_definition")], schemas.ENTITIES)
    tables.write_entities(entities, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.schema(schemas.ENTITIES).json(str(tmp_path / "out")).collect()] == [tuple(r) for r in entities.collect()]


def test_stored_entities_are_compressed_in_files_of_bounded_rows(spark, tmp_path):
    code = "class A:\n" + "    def m(self):\n        return 'é'\n" * 20
    entities = spark.createDataFrame([("r", "class", f"A{n}", "python", f"{n}.py", None, "", code, n, n + 40, "class_definition") for n in range(1000)], schemas.ENTITIES)
    tables.write_entities(entities.coalesce(1), str(tmp_path / "out"), file_rows=300)
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 4 and sum(f.stat().st_size for f in files) < 1000 * len(code) / 10
    stored = spark.read.schema(schemas.ENTITIES).json(str(tmp_path / "out"))
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, entities.collect()), key=repr)


def test_index_is_built_when_absent(spark, tmp_path):
    paths = str(tmp_path / "index"), str(tmp_path / "vectors")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_index(spark, *paths, 2)
    data = spark.createDataFrame([("a", "1", [3.0, 4.0]), ("b", "2", [0.0, 1.0])], schemas.VECTORS)
    tables.write_vectors(data, paths[1])
    for _ in range(2):
        got = {r.item_id: r.squared_norm for r in tables.load_index(spark, *paths, 2).collect()}
        assert got == {"1": 25.0, "2": 1.0}
    wrong = spark.createDataFrame([("a", "1", [1.0])], schemas.VECTORS)
    with pytest.raises(Exception, match="width 1"):
        vectors.build_index(wrong, 2).collect()

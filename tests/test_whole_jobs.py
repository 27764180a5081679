from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from workload import queries
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the smallest tables, in which a test puts its own in place of some."""
    def build(**own):
        root = tmp_path / "sf"
        root.mkdir()
        for name in os.listdir(SF):
            if name.removesuffix(".parquet") not in own:
                (root / name).symlink_to(f"{SF}/{name}")
        for name, columns in own.items():
            pq.write_table(pa.table(columns), root / f"{name}.parquet")
        return str(root)
    return build


def test_tolerant_load_sets_every_text_aside(spark, tables):
    ids = [*range(40), 7, 7, -3, None]
    texts = [None if i == 5 else f"text {i}\nof two lines" for i in ids]
    sf = tables(benchmark={"item_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    found = QUERIES["tolerant_load"](spark, sf).filter("kind = 'quarantine'").collect()
    assert sorted(r.name or "" for r in found) == sorted("" if i is None else str(i) for i in ids)


def test_tree_scan_keeps_a_part_of_the_files_checked_out(spark, monkeypatch):
    whole = sorted(map(tuple, QUERIES["tree_scan"](spark, SF).collect()))
    seen, check_out = [], queries.check_out

    def watched(sources, folder):
        check_out(sources, folder)
        seen.append((folder, sum(len(files) for _, _, files in os.walk(folder))))
        assert sum(os.path.exists(f) for f, _ in seen) == 1

    monkeypatch.setattr(queries, "CHECKED_OUT", 400)
    monkeypatch.setattr(queries, "check_out", watched)
    parts = sorted(map(tuple, QUERIES["tree_scan"](spark, SF).collect()))
    assert parts == whole and len(whole) > 1000
    assert len(seen) > 2 and max(n for _, n in seen) < len(whole) / 2 and sum(n for _, n in seen) == len(whole)
    assert not any(os.path.exists(folder) for folder, _ in seen)


def test_files_of_the_next_part_take_the_places_of_those_read(spark, monkeypatch):
    """Making a file after removing many takes a file system many times as long as writing over one."""
    whole = sorted(map(tuple, QUERIES["tree_scan"](spark, SF).collect()))
    seen, check_out = [], queries.check_out

    def watched(sources, folder):
        check_out(sources, folder)
        files = {os.path.join(at, name) for at, _, names in os.walk(folder) for name in names}
        seen.append({os.stat(f).st_ino for f in files})

    monkeypatch.setattr(queries, "CHECKED_OUT", 400)
    monkeypatch.setattr(queries, "check_out", watched)
    assert sorted(map(tuple, QUERIES["tree_scan"](spark, SF).collect())) == whole
    assert len(seen) > 2
    for before, now in zip(seen, seen[1:]):
        assert len(before & now) > 0.8 * min(len(before), len(now))


def test_written_over_files_hold_the_new_content_alone(spark, tmp_path):
    def written(rows):
        queries.check_out(rows, str(tmp_path / "b"))
        return {str(f.relative_to(tmp_path / "b")): f.read_text() for f in (tmp_path / "b").rglob("*") if f.is_file()}

    kinds = "repo string, path string, content string"
    old = [("r", f"x/{n}.py", "a long old text" * 9) for n in range(20)] + [("r", "y/same.py", "old")]
    queries.check_out(spark.createDataFrame(old, kinds), str(tmp_path / "a"))
    new = [("r", "x/new.py", "short"), ("r", "y/same.py", "é" * 30), ("q", "z/deep/empty.py", ""), ("q", "z/b.py", "b")]
    spent = str(tmp_path / "a"), spark.createDataFrame(old, kinds).select("repo", "path").unionByName(spark.createDataFrame([("r", "x/gone.py")], "repo string, path string"))
    rows = queries.in_place_of(spent, spark.createDataFrame(new, kinds), str(tmp_path / "b"))
    want = {f"{repo}/{path}": content for repo, path, content in new}
    assert written(rows) == want and not (tmp_path / "a").exists()
    # A task that runs again finds the spent files gone.
    assert written(rows) == want

from __future__ import annotations

import json
import random

from codestrata import schemas
from codestrata.sources import arrays, landed

COMMIT = {"sha": "s", "message": "m", "author": {"name": "n", "email": "e", "date": "d"}, "committer": {"name": "c", "email": "e", "date": "d"}, "url": "u", "code_diff": ""}


def documents(rng, n):
    odd = ['"', "\\", "\\\\", "[", "]", "{", "}", ",", "é😀", "\n", '\\"', '\\\\"', " ", "x"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(0, 30)))
    return [{**COMMIT, "sha": f"s{i}", "message": text(), "author": {"name": text(), "email": None, "date": text()}, "more": [[{"a": [text()]}], {}]} for i in range(n)]


def test_equals_the_one_task_reader_on_odd_texts(spark, tmp_path, rows):
    rng = random.Random(3)
    for k, (indent, escape) in enumerate(((None, True), (2, False), (None, False))):
        (tmp_path / f"{k}.json").write_text(json.dumps(documents(rng, 40), indent=indent, ensure_ascii=escape))
    (tmp_path / "empty.json").write_text(" [ ] ")
    want, _ = landed.read_json(spark, str(tmp_path), schemas.COMMIT_DOCUMENT)
    want = rows(want)
    assert len(want) == 120
    for split in (61, 1_000, 10_000_000):
        got, quarantine = arrays.read_array(spark, str(tmp_path), schemas.COMMIT_DOCUMENT, split)
        assert rows(got) == want and quarantine.count() == 0


def test_broken_files_and_elements(spark, tmp_path):
    texts = {"cut.json": '[{"sha": "c"}, {"sha"', "quote.json": '[{"sha": "c]', "number.json": "7", "object.json": '{"sha": "o"}', "blank.json": "  ",
             "some.json": '[{"sha": "good"}, {"sha": }, 5, {"sha": "too"}]'}
    for name, content in texts.items():
        (tmp_path / name).write_text(content)
    good, quarantine = arrays.read_array(spark, str(tmp_path), schemas.COMMIT_DOCUMENT, 8)
    assert sorted(r.sha for r in good.collect()) == ["good", "too"]
    bad = sorted((r.file.rsplit("/", 1)[1], r.value) for r in quarantine.collect() if r.value is None)
    assert bad == [(n, None) for n in ("cut.json", "number.json", "object.json", "quote.json")]
    assert sorted(r.value for r in quarantine.collect() if r.value) == ["5", '{"sha": }']


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large.json").write_text(json.dumps([{**COMMIT, "sha": f"s{i}", "message": "m" * 1000} for i in range(3000)]))
    good, _ = arrays.read_array(spark, str(tmp_path / "large.json"), schemas.COMMIT_DOCUMENT, 256 * 1024)
    from pyspark.sql import functions as F

    assert good.count() == 3000 and good.select(F.count_distinct("sha")).first()[0] == 3000
    long = "x" * 3_000_000
    (tmp_path / "long.json").write_text(json.dumps([{**COMMIT, "message": long}, {**COMMIT, "sha": "t"}]))
    good, _ = arrays.read_array(spark, str(tmp_path / "long.json"), schemas.COMMIT_DOCUMENT, 100_000)
    assert sorted((r.sha, len(r.message)) for r in good.collect()) == [("s", 3_000_000), ("t", 1)]

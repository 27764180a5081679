from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text

SPACED = ["", " ", "\t\n", " a b ", " x ", "\x1cx\x1f", "a\n\nb\n", "​x​", "　", "\x85y\x85", "é  "]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("r")).collect()]


def test_strip_and_blank_follow_python(spark):
    assert column(spark, SPACED, text.strip) == [v.strip() for v in SPACED]
    assert column(spark, [*SPACED, None], text.is_blank) == [not v.strip() for v in SPACED] + [True]


def test_every_python_space_is_stripped(spark):
    spaces = [chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000 and chr(n).isspace()]
    assert column(spark, spaces, text.strip) == [""] * len(spaces)
    near = [chr(n) for n in (0, 0x1B, 0x21, 0x84, 0x86, 0x180E, 0x200B, 0x2060, 0xFEFF)]
    assert column(spark, near, text.strip) == near


def test_preview_counts_code_points(spark):
    long = "é😀" * 60
    assert column(spark, [long, "short", None], text.preview) == [long[:80], "short", None]
    assert column(spark, ["0123456789abcdef"], text.short_sha) == ["01234567"]


NAMES = ["load_1", "Load%x", "LOAD", "ÉCOLE", "école", "a\\b", "under_score", "underXscore", "100%", ""]


@pytest.mark.parametrize("pattern", ["load", "LO_D", "é", "É", "a\\b", "r_s", "%", "0%", "", "\x01", "x%"])
def test_like_agrees_with_sqlite(spark, pattern):
    con = sqlite3.connect(":memory:")
    want = [bool(con.execute("select ? like ?", (n, f"%{pattern}%")).fetchone()[0]) for n in NAMES]
    assert column(spark, NAMES, lambda c: text.contains_like(c, pattern)) == want


def test_language_by_suffix(spark):
    paths = ["a.py", "b.ts", "c.tsx", "d.js", "e.jsx", "f.PY", "g.go", "h.pyi", "py", ".py"]
    want = ["python", "typescript", "typescript", "javascript", "javascript", None, None, None, None, "python"]
    assert column(spark, paths, text.language_of) == want


def test_suffix_lists(spark):
    paths = ["a.java", "a.jsx", "a.cpp", "a.c", "a.h", "a.py"]
    assert column(spark, paths, lambda c: text.has_suffix(c, text.SERVICE_SUFFIXES)) == [True, True, True, True, False, True]
    assert column(spark, paths, lambda c: text.has_suffix(c, text.HEAD_SUFFIXES)) == [True, False, True, True, False, True]
    assert column(spark, paths, lambda c: text.has_suffix(c, text.ENTITY_SUFFIXES)) == [False, True, False, False, False, True]


def test_directory_rules_differ(spark):
    paths = ["a.py", ".hidden.py", "src/.x/a.py", "node_modules/a.js", "my_node_modules/a.js", "rebuild/a.py", "build.py", ".github/a.py", "lib/venv/b.py", "environment/c.py", "src/.git.py"]
    segment = [False, False, True, True, False, False, False, True, True, False, False]
    word = [False, False, False, True, True, True, False, True, True, False, False]
    prefix = [False] * 7 + [True] + [False] * 3
    assert column(spark, paths, text.excluded_by_segment) == segment
    assert column(spark, paths, text.excluded_by_word) == word
    assert column(spark, paths, text.excluded_by_prefix) == prefix


@pytest.mark.parametrize("url, lenient, strict", [
    ("https://host.example/o/r", "o/r", "o/r"),
    ("https://host.example/o/r/", "o/r", "o/r"),
    ("https://host.example/o/r.git", "o/r.git", "o/r.git"),
    ("https://host.example/o/r/tree/main", "o/r", None),
    ("https://host.example/o", None, None),
    ("git@host.example:o/r.git", None, "o/r"),
    ("git@host.example:o.git/r.git.git", None, "o/r"),
    ("http://host.example/o/r", None, None),
    ("https://other.example/o/r", None, None),
    (None, None, None),
])
def test_repo_urls(spark, url, lenient, strict):
    for want, is_strict in ((lenient, False), (strict, True)):
        found = column(spark, [url], lambda c: text.repo_url(c, "host.example", strict=is_strict))[0]
        assert found["full_name"] == want
        assert (found["error"] is None) == (want is not None)
        if want:
            assert f"{found['owner']}/{found['repo']}" == want


def test_strip_is_linear(spark):
    import time

    long = spark.createDataFrame([("a" + " " * 300_000 + "b\u2003\x1c",)], "c string")
    began = time.time()
    assert long.select(F.length(text.strip(F.col("c"))).alias("n")).first().n == 300_002
    assert time.time() - began < 10

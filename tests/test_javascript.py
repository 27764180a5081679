from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codestrata.functions import code
from codestrata.functions.text import NON_SPACE, SPACE
from codestrata.operators import entities, javascript
from codestrata.operators.entities import extract_entities


def lines_of(spark, *lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string").orderBy("i")


@pytest.mark.parametrize("line, name", [
    ("function load(a) {", "load"),
    ("async function  läd_1 (x)", "läd_1"),
    ("  load: function (a) {", "load"),
    ("exports.load = function(a) {", "load"),
    ("const x = (a, b) => a", "x"),
    ("const x = async (a) => {", "async"),
    ("items.map((x) => x)", "map"),
    ("if (x) => y", None),
    ("while(a) => for(b) => c", None),
    ("const f = function named(a) {", "named"),
    ("const x = a => a", None),
    ("method(a) {", None),
    ("function (a) {", None),
    ("function wide(a)", "wide"),
    ("ét(x) =>", "t"),
    ("x²(a) =>", "x²"),
    ("if (a) => function g(", "g"),
])
def test_function_names(spark, line, name):
    assert lines_of(spark, line).select(code.function_name(F.col("line"))).first()[0] == name


@pytest.mark.parametrize("line, name, label", [
    ("class A extends B {", "A", "class"),
    ("export interface Ünit {", "Ünit", "interface"),
    ("type T = string", "T", "type"),
    ("enum Color {", "Color", "enum"),
    ("subclass thing", "thing", "class"),
    ("class Prototype {", "Prototype", "type"),
    ("class A implements interface B", "A", "interface"),
    ("type T<X> = Y", None, "type"),
    ("class {", None, "class"),
    ("enumerate(x)", None, "enum"),
])
def test_class_names(spark, line, name, label):
    row = lines_of(spark, line).select(code.class_name(F.col("line")), code.class_type(F.col("line"))).first()
    assert tuple(row) == (name, label)


def test_names_as_python_finds_them(spark):
    """The same patterns through Python's re on random lines."""
    rng = random.Random(1)
    space = lambda: rng.choice(["", "", " ", "\t", "　 "])
    word = lambda: rng.choice(["a", "é9", "_x", "if", "for", "²x1", "function", "type", "", "a-b"])
    shapes = [
        lambda: f"function{space()}{word()}{space()}(",
        lambda: f"{word()}{space()}{rng.choice(':=')}{space()}function{space()}(",
        lambda: f"{word()}{space()}={space()}({word()}{rng.choice([')', ''])}{space()}=>",
        lambda: f"{word()}{space()}({word()}){space()}=>",
        lambda: f"{rng.choice(['class', 'interface', 'enum'])}{space()}{word()}{space()}{{",
        lambda: f"type{space()}{word()}{space()}=",
        lambda: rng.choice(["(", ")", "=>", " ", ","]),
    ]
    lines = sorted({"".join(rng.choice(shapes)() + space() for _ in range(rng.randrange(1, 4))) for _ in range(4000)})

    def first(line, patterns, rejected=()):
        hits = (re.search(p, line) for p, _ in patterns)
        return next((h.group(1) for h in hits if h and h.group(1) not in rejected), None)

    line = F.col("line")
    got = lines_of(spark, *lines).select(code.function_name(line), code.class_name(line)).collect()
    want = [(first(v, code.FUNCTION_PATTERNS, code.NOT_FUNCTIONS), first(v, code.CLASS_PATTERNS)) for v in lines]
    assert sum(f is not None for f, _ in want) > 300 and sum(c is not None for _, c in want) > 300
    assert [tuple(r) for r in got] == want
    defining = lines_of(spark, *lines).filter(~code.may_define(line)).select(code.function_name(line), code.class_name(line))
    assert {tuple(r) for r in defining.collect()} <= {(None, None)}


def test_a_long_word_takes_linear_time(spark):
    long = "x" * 300_000 + " => function" + " " * 300_000
    began = time.monotonic()
    assert lines_of(spark, long).select(code.function_name(F.col("line")), code.class_name(F.col("line"))).first()[0] is None
    assert time.monotonic() - began < 10


def test_skipped_lines(spark):
    lines = ["", "  ", "// class A", "  /* class A", " * class A", "x // y", "　// z", " class A", "/ /", "\x1c//"]
    got = [r[0] for r in lines_of(spark, *lines).select(code.is_code_line(F.col("line"))).collect()]
    assert got == [False, False, False, False, True, True, False, True, True, False]


def spans(spark, *contents):
    files = spark.createDataFrame([("r", f"f{i}.js", c) for i, c in enumerate(contents)], "repo string, path string, content string")
    return {(r.path, r.name, r.start_line): r.end_line for r in javascript.script_entities(files).collect()}


def test_block_ends(spark):
    got = spans(
        spark,
        "class A {\n}\n",
        "class A\n\n{\n  { }\n}\nrest",
        "class A { function b() { } }",
        "} class A {\n}\n}\n",
        "class A\nno block\n",
        "class A {\n{\n}",
        "}}\nclass A { }\nclass B {\n",
        "class A {} }\nclass B {}",
    )
    assert got == {
        ("f0.js", "A", 1): 2, ("f1.js", "A", 1): 5, ("f2.js", "A", 1): 1, ("f2.js", "b", 1): 1,
        ("f3.js", "A", 1): 4, ("f4.js", "A", 1): 3, ("f5.js", "A", 1): 3,
        ("f6.js", "A", 2): 2, ("f6.js", "B", 3): 4, ("f7.js", "A", 1): 1, ("f7.js", "B", 2): 2,
    }


def block_end(lines, start):
    """Brute force: the shortest stretch from the start that has an opening brace before a close to depth zero."""
    text = "\n".join(lines[start - 1 :])
    for end, ch in enumerate(text):
        part = text[: end + 1]
        if ch == "}" and "{" in part and part.count("{") == part.count("}"):
            return start + part.count("\n")
    return len(lines)


def test_block_ends_by_brute_force(spark):
    rng = random.Random(3)
    contents = []
    for _ in range(250):
        lines = []
        for n in range(rng.randrange(1, 14)):
            text = "".join(rng.choice("{{}} x") for _ in range(rng.randrange(0, 5)))
            lines.append(f"{text} class K{n} {rng.choice(['', '{', '}', '{}'])}" if rng.random() < 0.5 else text)
        contents.append("\n".join(lines))
    want = {}
    for i, content in enumerate(contents):
        lines = content.split("\n")
        for n, line in enumerate(lines, 1):
            if " class K" in line:
                want[f"f{i}.js", line.split("class ")[1].split()[0], n] = block_end(lines, n)
    assert len(want) > 500
    assert spans(spark, *contents) == want


def test_one_exchange_and_no_content_past_the_explode(spark):
    files = spark.createDataFrame([("r", "a.js", "class A {\n}")], "repo string, path string, content string")
    plan = javascript.script_entities(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Generate posexplode") == 1
    carried = re.search(r"Generate posexplode\(.*?\), \[(.*?)\]", plan, re.S).group(1)
    assert "path" in carried and "n_lines" in carried and "content" not in carried


def test_a_large_file_with_many_functions(spark):
    content = "\n".join(f"function f{n}() {{\n  return {n}\n}}\n" for n in range(30_000))
    files = spark.createDataFrame([("r", "big.js", content), ("r", "small.js", "class A {}")], "repo string, path string, content string")
    began = time.monotonic()
    got = {r.name: (r.start_line, r.end_line, r.code) for r in extract_entities(files).collect()}
    assert time.monotonic() - began < 60
    assert len(got) == 30_001
    assert got["f29999"] == (119_997, 119_999, "function f29999() {\n  return 29999\n}")


def test_entities_of_a_mixed_tree(spark):
    files = spark.createDataFrame([
        ("r", "a.ts", "interface I {\n  x: string\n}\nconst go = (x) => {\n  return x\n}", True),
        ("r", "b.py", 'def f():\n    """Doc."""\n    return 1\n', True),
        ("r", "c.go", "func main() {}", True),
        ("r", "d.js", "class Lost {}", False),
        ("q", "a.ts", "enum E { A }", True),
    ], "repo string, path string, content string, valid_utf8 boolean")
    got = {tuple(r) for r in extract_entities(files).drop("class_context").collect()}
    assert got == {
        ("r", "interface", "I", "typescript", "a.ts", "", "interface I {\n  x: string\n}", 1, 3, "class_declaration"),
        ("r", "function", "go", "typescript", "a.ts", "", "const go = (x) => {\n  return x\n}", 4, 6, "function_declaration"),
        ("r", "function", "f", "python", "b.py", "Doc.", 'def f():\n    """Doc."""\n    return 1', 1, 3, "function_definition"),
        ("q", "enum", "E", "typescript", "a.ts", "", "enum E { A }", 1, 1, "class_declaration"),
    }


def test_many_openings_cost_linear_time(spark):
    lines = ["a(" * 60_000 + "=>", "a(" * 60_000 + ") x =>", "a(" * 60_000 + ") =>", "if (x) { b(c) => 1 }", "f = (a, g(b)) => h(", "x) => y(z) =>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string").coalesce(1)
    began = time.time()
    got = [r.n for r in df.select("i", code.function_name(F.col("line")).alias("n")).orderBy("i").collect()]
    assert got == [None, None, "a", "b", None, "y"] and time.time() - began < 15


def test_files_are_dealt_once_before_they_are_parsed(spark, monkeypatch):
    """A stored table in one split is dealt over the tasks; a script's lines, spans and content need no other shuffle."""
    parse, parts = entities.python_entities, []
    monkeypatch.setattr(entities, "python_entities", lambda files: parts.append(files.rdd.getNumPartitions()) or parse(files))
    rows = [("r", f"f{n}.{kind}", "const f = (x) => {\n  x();\n}" if kind == "js" else "def f():\n    pass") for kind in ("js", "py") for n in range(50)]
    found = extract_entities(spark.createDataFrame(rows, "repo string, path string, content string").coalesce(1))
    exchanges = re.findall(r"Exchange hashpartitioning\(.*", found._jdf.queryExecution().executedPlan().toString())
    assert parts == [4] and len(exchanges) == 3 and all("REPARTITION_BY_NUM" in e for e in exchanges)
    assert found.count() == 100


def test_short_and_long_lines_give_the_same_names(spark):
    """Up to 256 bytes the whole pattern is searched, beyond that by pieces; neither goes through an interpreted filter of names."""
    rng = random.Random(11)
    parts = ["f", "if", "x1", "é", " ", "= (", "(", ")", ") =>", "a, b", "function", ":", "{", "\t", "//", "/*", "\u2003"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    long = F.concat("line", F.lit(" " + "-" * 300))
    both = df.select("line", code.function_name(F.col("line")).alias("short"), code.function_name(long).alias("long"))
    assert both.filter("short is not null").count() > 100
    assert both.filter("not (short <=> long)").count() == 0
    plan = df.select(code.function_name(F.col("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in plan
    opens = f"\\A{SPACE}*(?!//|/\\*){NON_SPACE}"
    spaced = df.select(F.concat(F.lit(" \t\u2003"), "line").alias("line")).union(df)
    assert spaced.filter(code.is_code_line(F.col("line")) != F.col("line").rlike(opens)).count() == 0

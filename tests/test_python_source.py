from __future__ import annotations

from codestrata.operators import python_source
from codestrata.plans import index

SOURCE = '''import x

@cache
@other(1)
def plain(a):
    """First line.

    More.
    """
    def inner():
        return 1
    return inner

async def later():
    class Local: pass

class Klass(Base):
    "Short."

    @property
    def value(self): return lambda: 0

    if True:
        def guarded(self): ...
    else:
        def other(self): ...

try:
    def tried(): ...
except ValueError:
    def caught(): ...
else:
    def fine(): ...
finally:
    def last(): ...

match x:
    case 1:
        def matched(): ...

for a in b:
    def looped(): ...
else:
    def done(): ...
with a:
    def held(): ...
'''


def files(spark, **sources):
    return spark.createDataFrame([("r", p.replace("__", "."), s) for p, s in sources.items()], "repo string, path string, content string")


def test_plain_variant(spark):
    got = {(r.type, r.name): r for r in python_source.python_entities(files(spark, a__py=SOURCE)).collect()}
    names = {n for _, n in got}
    assert names == {"plain", "inner", "Local", "Klass", "value", "guarded", "other", "tried", "caught", "fine", "last", "matched", "looped", "done", "held"}
    plain = got["function", "plain"]
    assert (plain.start_line, plain.end_line) == (5, 12)
    assert plain.docstring == "First line.\n\nMore."
    assert plain.code.startswith("def plain(a):") and plain.code.endswith("return inner")
    assert got["class", "Klass"].docstring == "Short."
    assert got["function", "inner"].docstring == ""
    assert {r.node_type for r in got.values()} == {"function_definition", "class_definition"}


def test_decorated_variant(spark):
    found = python_source.python_entities(files(spark, a__py=SOURCE, b__PYI="def stub(): ..."), include_async=True, include_decorators=True)
    got = {r.name: (r.start_line, r.end_line) for r in found.collect()}
    assert got["plain"] == (3, 12) and got["later"] == (14, 15) and got["value"] == (20, 21) and got["stub"] == (1, 1)
    assert len(got) == 17


def test_files_that_do_not_parse(spark):
    df = files(spark, good__py="def f(): pass", bad__py="def f(:", nul__py="x = '\0'", bom__py="﻿def f(): pass", empty__py="", deep__py="(" * 5000, js__js="function f() {}")
    assert {r.path for r in python_source.python_entities(df).collect()} == {"good.py"}
    errors = {r.path: r.error for r in python_source.python_errors(df).collect()}
    assert set(errors) == {"bad.py", "nul.py", "bom.py", "deep.py"}
    assert errors["bad.py"].startswith("SyntaxError")


def test_index_of_repositories(spark):
    tree = spark.createDataFrame([
        ("a", "m.py", "def f(): pass\nclass C: pass"),
        ("a", "node_modules/x.py", "def hidden(): pass"),
        ("a", "none.py", "x = 1"),
        ("a", "app.js", "function f() {}"),
        ("b", "m.py", "def g(): pass"),
        ("b", "broken.py", "def"),
    ], "repo string, path string, content string")
    commits = spark.sql("""select * from values
        ('a', 'a1', 'n', 'e', 'm', timestamp'2024-01-01'), ('a', 'a1', 'n', 'e', 'again', timestamp'2024-01-02'), ('a', 'a2', 'n', 'e', 'm', timestamp'2024-01-03')
        as t(repo, commit_sha, author_name, author_email, message, committed_at)""")
    built = index.index_repositories(tree, commits)
    assert {(r.repo, r.current_path) for r in built.files.collect()} == {("a", "m.py"), ("b", "m.py")}
    got = {(r.repo, r.kind, r.name, r.commit_sha) for r in built.symbols.collect()}
    assert got == {("a", "function", "f", "a2"), ("a", "class", "C", "a2"), ("b", "function", "g", "unknown")}
    assert {(r.commit_sha, r.message) for r in built.commits.collect()} == {("a1", "m"), ("a2", "m")}
    assert built.symbols.join(built.files, ["repo", "file_id"]).count() == 3
    every = index.index_repositories(tree, commits, store_empty_files=True)
    assert every.files.count() == 5


def test_only_blocks_are_walked():
    import ast

    text = "\n".join(["x = [i for i in range(9)]"] * 50 + ["try:", "    import a", "except E:", "    def f(): pass", "else:", "    class C:", "        y = 1", "        async def g(s): return 2",
        "match x:", "    case 1:", "        def h(): pass", "with a:", "    for i in b:", "        while c:", "            def k(): pass", "        else:", "            def m(): pass"])
    walked = python_source._statements(ast.parse(text))
    assert {n.name for n in walked if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))} == {"f", "C", "g", "h", "k", "m"}
    assert not any(isinstance(n, (ast.Assign, ast.Return, ast.Pass, ast.Import)) for n in walked) and len(walked) < 20

"""Python entities. Python's grammar is beyond SQL expressions, so the parse is one Arrow-batched task per file batch."""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = """repo string, path string, type string, name string, docstring string, code string,
    start_line int, end_line int, node_type string, error string"""
_ARROW = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("type", pa.string()), ("name", pa.string()),
    ("docstring", pa.string()), ("code", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("node_type", pa.string()), ("error", pa.string()),
])
_FLUSH_BYTES = 16 * 1024 * 1024
_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")
#: Statements without blocks.
_SIMPLE = frozenset((
    ast.Return, ast.Delete, ast.Assign, ast.TypeAlias, ast.AugAssign, ast.AnnAssign, ast.Raise, ast.Assert, ast.Import, ast.ImportFrom,
    ast.Global, ast.Nonlocal, ast.Expr, ast.Pass, ast.Break, ast.Continue,
))
_NODE_TYPES = {"function": "function_definition", "class": "class_definition"}


def is_python(path: Column, head_indexing: bool = False) -> Column:
    """Whether the path is parsed; the head-indexing variant also takes `.pyi` and any case."""
    if not head_indexing:
        return path.endswith(".py")
    return F.lower(path).endswith(".py") | F.lower(path).endswith(".pyi")


def parse_python(
    files: DataFrame,
    include_async: bool = False,
    include_decorators: bool = False,
    with_text: bool = True,
    parses: Accumulator | None = None,
    with_empty: bool = False,
) -> DataFrame:
    """One row per function or class of each `.py` file, nested ones included, no shuffle.

    A file that does not parse gives one row with only `error` set. `include_async` and
    `include_decorators` give the span rules of the head-indexing variant, which also reads `.pyi`
    and ignores the suffix's case. `with_text=False` leaves docstring and code null. `parses` is a
    Spark accumulator that counts the files parsed. `with_empty` gives one row of nulls for a file that
    holds none, so that every file shows.
    """
    wanted = is_python(F.col("path"), include_decorators)
    labels = {ast.FunctionDef: "function", ast.ClassDef: "class"}
    if include_async:
        labels[ast.AsyncFunctionDef] = "function"

    def entities(content: str) -> list[tuple]:
        found, lines, docstring, code = [], content.split("\n") if with_text else None, None, None
        for node in _statements(ast.parse(content)):
            label = labels.get(type(node))
            if label is None:
                continue
            start, end = node.lineno, node.end_lineno or node.lineno
            if include_decorators and node.decorator_list:
                start = min(start, *(d.lineno for d in node.decorator_list))
            if with_text:
                documented = type(node.body[0]) is ast.Expr
                docstring, code = documented and ast.get_docstring(node) or "", "\n".join(lines[start - 1 : end])
            found.append((label, node.name, docstring, code, start, end, _NODE_TYPES[label], None))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Syntax trees hold no cycles: they go when they are dropped, and the search for cycles only takes time.
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                rows, at, size = [], [], 0
                for i, content in enumerate(batch.column(2).to_pylist()):
                    if parses is not None:
                        parses.add(1)
                    try:
                        found = entities(content)
                    except Exception as problem:  # syntax errors, null bytes, nesting too deep
                        found = [(*[None] * 7, f"{type(problem).__name__}: {problem}")]
                    if with_empty and not found:
                        found = [(None,) * 8]
                    rows += found
                    at += [i] * len(found)
                    size += 200 * len(found)
                    if with_text:
                        for row in found:
                            size += len(row[3] or "")
                    if size > _FLUSH_BYTES:
                        yield _batch(batch, at, rows)
                        rows, at, size = [], [], 0
                if rows:
                    yield _batch(batch, at, rows)
        finally:
            if collects:
                gc.enable()

    return (
        files.filter(wanted & F.col("content").isNotNull()).select("repo", "path", "content").mapInArrow(run, _SCHEMA)
    )


def _statements(tree: ast.AST) -> list[ast.AST]:
    """The tree's compound statements, nested ones included; other statements and expressions cannot hold a definition."""
    found = [tree]
    for node in found:
        for name in _BLOCKS:
            if block := getattr(node, name, None):
                found += [inner for inner in block if type(inner) not in _SIMPLE]
    return found


def _batch(files: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of the files at the places `at`, whose names need not become Python texts."""
    place = pa.array(np.array(at, np.int64))
    names = [files.column(i).take(place).cast(pa.string()) for i in range(2)]
    columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), list(_ARROW)[2:])]
    return pa.RecordBatch.from_arrays([*names, *columns], schema=_ARROW)


def python_entities(files: DataFrame, **options) -> DataFrame:
    """The entities of files that parse."""
    return parse_python(files, **options).filter("error is null").drop("error")


def python_errors(files: DataFrame) -> DataFrame:
    """(repo, path, error) of files that do not parse."""
    return parse_python(files, with_text=False).filter("error is not null").select("repo", "path", "error")

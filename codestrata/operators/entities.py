"""Entity records of all languages, with code and one set of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.records import snippet
from codestrata.operators.javascript import HASHED_FILE, hashed, script_entities, scripts
from codestrata.operators.python_source import python_entities
from codestrata.schemas import ENTITIES
from codestrata.session import dealt

_FILE = ["repo", "path"]


def with_code(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Add the source lines of each span of `script_entities`.

    Spans are gathered per file first, so every file's content meets its spans in one row of one
    join instead of being repeated per span; a file's spans are bounded by its own text. They are
    still partitioned by file, so only the contents are shuffled here. The content is split into
    lines once (the explode of one array keeps Spark from moving the split into the loop over
    spans), so a large file with many spans costs no more than its lines and its result.
    """
    fields = [c for c in spans.columns if c not in HASHED_FILE]

    def with_snippet(span: Column) -> Column:
        code = snippet(F.col("lines"), span["start_line"], span["end_line"])
        return F.struct(*(span[c].alias(c) for c in fields), code.alias("code"))

    per_file = spans.groupBy(*HASHED_FILE).agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return (
        hashed(files).select(*HASHED_FILE, "content")
        .join(per_file, HASHED_FILE)
        .select(*_FILE, "spans", F.explode(F.array(F.split("content", "\n"))).alias("lines"))
        .select(*_FILE, F.inline(F.transform("spans", with_snippet)))
    )


def extract_entities(files: DataFrame) -> DataFrame:
    """Functions, classes, interfaces, types and enums of all supported files.

    Python files, script lines and script contents are three passes, so `files` should be a stored
    or staged table rather than a tree still to be read. Files are dealt over the tasks before they are parsed; a script's
    lines, spans and content then meet without another shuffle.
    """
    readable = files.filter("valid_utf8") if "valid_utf8" in files.columns else files
    python = python_entities(dealt(readable, *_FILE)).withColumn("language", F.lit("python"))
    placed = dealt(hashed(scripts(readable)).select(*HASHED_FILE, "content"), *HASHED_FILE)
    script = with_code(script_entities(placed), placed)
    both = python.unionByName(script).withColumn("class_context", F.lit(None).cast("string"))
    return both.select(*ENTITIES.fieldNames())

"""JavaScript and TypeScript entities with their line spans, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import code
from codestrata.functions.text import language_of

_FILE = ["repo", "path"]
HASHED_FILE = ["file_hash", *_FILE]


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1, with the file's line count. Stays in the scan's stage.

    A file is split once; the count is projected below the explode, so a line's row does not carry its file's content.
    """
    split = files.select(*_FILE, *keep, F.split("content", "\n").alias("lines"))
    counted = split.select(*_FILE, *keep, "lines", F.size("lines").alias("n_lines"))
    return counted.select(
        *_FILE, *keep, "n_lines", F.posexplode("lines").alias("line_at", "line")
    ).select(*_FILE, *keep, "n_lines", (F.col("line_at") + 1).alias("line_no"), "line")


def code_lines(files: DataFrame) -> DataFrame:
    """Lines that can hold a definition: not blank, not opening a comment."""
    return explode_lines(files).filter(code.is_code_line(F.col("line"))).select(*_FILE, "line_no", "line")


def scripts(files: DataFrame) -> DataFrame:
    """The JS/TS files."""
    return files.filter(language_of(F.col("path")).isin("javascript", "typescript"))


def marked_lines(files: DataFrame) -> DataFrame:
    """Lines of JS/TS files without their text: what each defines (or null), and its braces in order."""
    line = F.col("line")
    found = F.struct(
        code.function_name(line).alias("function_name"),
        code.class_name(line).alias("class_name"),
        code.class_type(line).alias("class_type"),
        "n_lines",
    )
    has_brace = line.contains("{") | line.contains("}")
    braces = F.when(has_brace, F.regexp_replace(line, "[^{}]+", "")).otherwise(F.lit(""))
    marked = explode_lines(hashed(scripts(files)), "file_hash").select(
        *HASHED_FILE,
        "line_no",
        F.when(code.may_define(line) & code.is_code_line(line), found).alias("definition"),
        braces.alias("braces"),
    )
    some = F.col("definition.function_name").isNotNull() | F.col("definition.class_name").isNotNull()
    return marked.withColumn("definition", F.when(some, F.col("definition")))


def definitions(files: DataFrame) -> DataFrame:
    """Every line that defines a function, a class-like entity or both."""
    # An explode, unlike a filter, is not pushed down to repeat the pattern matching.
    found = F.explode(F.filter(F.array("definition"), lambda d: d.isNotNull()))
    return (
        marked_lines(files)
        .select(*_FILE, "line_no", found.alias("found"))
        .select(*_FILE, "line_no", "found.function_name", "found.class_name", "found.class_type")
    )


def file_hash() -> Column:
    """Number of a file that leads its key: it sorts faster than the names, which keep the key exact."""
    return F.xxhash64(*_FILE).alias("file_hash")


def hashed(files: DataFrame) -> DataFrame:
    """The files with their `file_hash`, taken once a file."""
    return files if "file_hash" in files.columns else files.withColumn("file_hash", file_hash())


def block_spans(marked: DataFrame) -> DataFrame:
    """`start_line` and `end_line` of every definition in `marked_lines`.

    A block ends at the first closing brace, after some opening brace at or below the definition,
    that brings the nesting depth back to what it was before the line; without one it ends with the
    file. Only braces and names are shuffled, once, by file; three running windows over that one
    partitioning then find (1) the depth, (2) the next opening brace, (3) the next closing brace of
    the same depth. A window holds one file, which is one cell of the input.
    """
    defines, braces = F.col("definition").isNotNull(), F.col("braces")
    # A line's definition has position 0, its braces follow from 1.
    positions = F.when(defines, F.sequence(F.lit(0), F.length(braces))).when(
        braces != "", F.sequence(F.lit(1), F.length(braces))
    )
    position = F.col("position")
    brace = F.when(position > 0, F.substring(braces, position, F.lit(1)))
    events = marked.withColumn("position", F.explode(positions)).select(
        *HASHED_FILE,
        (F.shiftleft(F.col("line_no").cast("bigint"), 32) + position).alias("seq"),
        F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0).alias("step"),
        F.when(position == 0, F.col("definition")).alias("definition"),
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forward = Window.partitionBy(*HASHED_FILE).orderBy("seq").rowsBetween(*so_far)
    backward = Window.partitionBy(*HASHED_FILE).orderBy(F.desc("seq")).rowsBetween(*so_far)
    by_depth = Window.partitionBy(*HASHED_FILE, "depth").orderBy(F.desc("from_seq")).rowsBetween(*so_far)
    seq, is_definition = F.col("seq"), F.col("definition").isNotNull()

    opened = (
        events.withColumn("depth", F.sum("step").over(forward))
        .withColumn("open_seq", F.last(F.when(F.col("step") == 1, seq), ignorenulls=True).over(backward))
        .filter("step <= 0")
    )
    closed = opened.withColumn(
        "from_seq", F.when(is_definition, F.coalesce("open_seq", "seq")).otherwise(seq)
    ).withColumn("close_seq", F.last(F.when(F.col("step") == -1, seq), ignorenulls=True).over(by_depth))
    ends_at = F.when(F.col("open_seq").isNotNull(), F.shiftright("close_seq", 32).cast("int"))
    return closed.filter(is_definition).select(
        *HASHED_FILE,
        "definition.*",
        F.shiftright("seq", 32).cast("int").alias("start_line"),
        F.coalesce(ends_at, F.col("definition.n_lines")).alias("end_line"),
    )


def script_entities(files: DataFrame) -> DataFrame:
    """Functions and class-like entities of JS/TS files; a line gives at most one of each."""
    found = F.array(
        F.struct(
            F.lit("function").alias("type"),
            F.col("function_name").alias("name"),
            F.lit("function_declaration").alias("node_type"),
        ),
        F.struct(
            F.col("class_type").alias("type"),
            F.col("class_name").alias("name"),
            F.lit("class_declaration").alias("node_type"),
        ),
    )
    return (
        block_spans(marked_lines(files))
        .withColumn("entity", F.explode(F.filter(found, lambda e: e["name"].isNotNull())))
        .select(
            *HASHED_FILE,
            language_of(F.col("path")).alias("language"),
            F.col("entity.type").alias("type"),
            F.col("entity.name").alias("name"),
            F.lit("").alias("docstring"),
            "start_line",
            "end_line",
            F.col("entity.node_type").alias("node_type"),
        )
    )

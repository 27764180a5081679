"""The SQL lookups and statistics over commits, files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import contains_like
from codestrata.operators.ranking import top_n
from codestrata.session import broadcast_if_small, stage

_FILE = ["repo", "file_id"]
_LISTED = ["repo", "current_path", "kind", "name", "start_line", "end_line"]
SYMBOL_ORDER = ["current_path", "start_line", "name", "kind", "end_line", "commit_sha"]


def symbols_with_paths(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Inner join of symbols with the path of their file."""
    return symbols.join(files.select(*_FILE, "current_path"), _FILE)


def all_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Every symbol by path and start line."""
    return symbols_with_paths(symbols, files).orderBy("repo", *SYMBOL_ORDER).select(*_LISTED)


def matching_symbols(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name contains the pattern."""
    return symbols.filter(contains_like(F.col("name"), pattern))


def symbol_search(symbols: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name contains the pattern, by path."""
    return all_symbols(matching_symbols(symbols, pattern), files)


def file_counts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Functions and classes per file, files without symbols included.

    Symbols are counted per file id before the join, so both join sides are unique on the key.
    """
    counts = symbols.groupBy(*_FILE).agg(
        F.count_if(F.col("kind") == "function").alias("functions"),
        F.count_if(F.col("kind") == "class").alias("classes"),
    )
    zero = F.lit(0).cast("bigint")
    return files.join(counts, _FILE, "left").select(
        "repo",
        "current_path",
        F.coalesce("functions", zero).alias("functions"),
        F.coalesce("classes", zero).alias("classes"),
    )


def file_statistics(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The counts per file, busiest first."""
    busiest = F.desc(F.col("functions") + F.col("classes"))
    return file_counts(symbols, files).orderBy(busiest, "repo", "current_path")


def top_function_files(symbols: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """The files with the most functions."""
    counts = symbols.filter(F.col("kind") == "function").groupBy(*_FILE).agg(F.count("*").alias("func_count"))
    return (
        files.join(counts, _FILE)
        .select("repo", "current_path", "func_count")
        .orderBy(F.desc("func_count"), "repo", "current_path")
        .limit(limit)
    )


def entity_type_counts(entities: DataFrame) -> DataFrame:
    """Entities per type, sorted by type."""
    return entities.groupBy("type").agg(F.count("*").alias("entities")).orderBy("type")


def repo_stats(repos: DataFrame, commits: DataFrame, prs: DataFrame, files: DataFrame, symbols: DataFrame, store_empty_files: bool = False) -> DataFrame:
    """Five counts per repository in `repos`, zero where there is nothing.

    `store_empty_files` says whether a file without symbols counts as stored. Every input shrinks
    to one row per repository before the joins.
    """
    kinds = symbols.groupBy("repo").agg(
        F.count_if(F.col("kind") == "function").alias("functions_count"),
        F.count_if(F.col("kind") == "class").alias("classes_count"),
    )
    stored = files.select(*_FILE)
    if not store_empty_files:
        stored = stored.join(symbols.select(*_FILE).distinct(), _FILE, "left_semi")
    counted = [
        _count(commits, "commits_count"),
        _count(prs, "prs_count"),
        kinds,
        _count(stored, "files_count"),
    ]
    stats = repos.select("repo")
    for counts in counted:
        stats = stats.join(counts, "repo", "left")
    return stats.na.fill(0)


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("repo").agg(F.count("*").alias(name))


def report_symbols(symbols: DataFrame, files: DataFrame, cap: int = 200) -> DataFrame:
    """The first `cap` symbols of each repository by path and start line, numbered by `rank`.

    They lie in the first `cap` files that have symbols, since each of those gives at least one. So
    the files are ranked first, and the symbol table is only filtered by that short list.
    """
    used = files.select(*_FILE, "current_path").join(symbols.select(*_FILE).distinct(), _FILE, "left_semi")
    first = top_n(used, ["repo"], [F.asc("current_path")], cap).drop("rank")
    listed = symbols.join(broadcast_if_small(stage(first, "first_files")), _FILE)
    return top_n(listed, ["repo"], [F.asc(c) for c in SYMBOL_ORDER], cap)


def report_files(counts: DataFrame, cap: int = 50) -> DataFrame:
    """The `cap` busiest files of each repository, numbered by `rank`."""
    busiest = [F.desc(F.col("functions") + F.col("classes")), F.asc("current_path")]
    return top_n(counts, ["repo"], busiest, cap)


def names_by_file(ranked: DataFrame, symbols: int = 100, files: int = 10, names: int = 10) -> DataFrame:
    """Function and class names per file, from ranked symbols.

    Only the first `symbols` rows of a repository count, files keep first-seen order and stop at
    `files`, and each list stops at `names`. After the first filter a group is bounded by the caps.
    """
    def listed(kind: str):
        seen = F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "name")))
        return F.slice(F.transform(F.array_sort(seen), lambda s: s["name"]), 1, names)

    per_file = (
        ranked.filter(F.col("rank") <= symbols)
        .groupBy("repo", "current_path")
        .agg(F.min("rank").alias("seen"), listed("function").alias("functions"), listed("class").alias("classes"))
    )
    order = Window.partitionBy("repo").orderBy("seen")
    return (
        per_file.withColumn("file_rank", F.row_number().over(order))
        .filter(F.col("file_rank") <= files)
        .select(
            "repo",
            "file_rank",
            "current_path",
            F.array_join("functions", ", ").alias("functions"),
            F.array_join("classes", ", ").alias("classes"),
        )
    )

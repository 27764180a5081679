"""Repository reports and their contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators import context
from codestrata.operators.lookups import SYMBOL_ORDER
from codestrata.operators.ranking import top_n
from codestrata.session import broadcast_if_small, stage

# How much of each list a report keeps, and the warning of a report without a tree.
MAX_COMMITS = 50
MAX_PRS = 30
MAX_SYMBOLS = 200
MAX_FILES = 50
NO_CHECKOUT = "Git not available - code parsing skipped"

_CAPS = {"commits": MAX_COMMITS, "prs": MAX_PRS, "symbols": MAX_SYMBOLS, "file_stats": MAX_FILES}
_FILE = ["repo", "file_id"]

# The item of each list: its fields and the columns they come from.
_ITEMS = {
    "commits": {"sha": "commit_sha", "message": "message", "author": "author_name", "email": "author_email", "date": "committed_at"},
    "prs": {"number": "number", "title": "title", "state": "state", "user": "user_login", "created_at": "created_at"},
    "symbols": {"file": "current_path", "kind": "kind", "name": "name", "start_line": "start_line", "end_line": "end_line"},
    "file_stats": {"file": "current_path", "functions": "functions", "classes": "classes"},
}


# What orders each list, ascending with nulls last, as columns of the types in `_PLACES`.
_ORDERS = {
    "commits": {"n1": "-unix_micros(cast(committed_at as timestamp))", "t1": "commit_sha"},
    "prs": {"n1": "-unix_micros(cast(created_at as timestamp))", "n2": "-number"},
    "file_stats": {"n1": "-(functions + classes)", "t1": "current_path"},
    "symbols": dict(zip(("t1", "n2", "t2", "t3", "n3", "t4"), SYMBOL_ORDER, strict=True)),
}
_PLACES = {"n1": "bigint", "t1": "string", "n2": "bigint", "t2": "string", "t3": "string", "n3": "bigint", "t4": "string"}


def _tagged(rows: DataFrame, section: str) -> DataFrame:
    """(repo, section, order columns, one struct column a section) of one section's rows."""
    item = F.struct(*(F.col(column).alias(field) for field, column in _ITEMS[section].items()))
    places = [F.expr(_ORDERS[section].get(name, "null")).cast(kind).alias(name) for name, kind in _PLACES.items()]
    return rows.select("repo", F.lit(section).alias("section"), *places, item.alias(f"_{section}"))


def repo_reports(repos: DataFrame, commits: DataFrame, prs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One nested row per repository: details (the columns of `repos`), capped lists, and stats.

    Counts cover the kept commits and pull requests but all symbols and all stored files.

    Every list is a set of tagged rows, so one two-step ranking and one aggregate serve all of them. Symbols are
    counted per file once; files, one row an id, meet those counts once, symbols of unknown files being kept. The
    symbols listed lie in the first files that have any, as each gives at least one. So files are read once and
    symbols twice.
    """
    counts = symbols.groupBy(*_FILE).agg(
        F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"))
    zero, known, used = F.lit(0).cast("bigint"), F.col("_known"), F.col("functions").isNotNull()
    stored = files.select(*_FILE, "current_path", F.lit(True).alias("_known"))
    listing = stage(stored.join(counts, _FILE, "full"), "files")
    first = top_n(listing.filter(known & used).select(*_FILE, "current_path"), ["repo"], [F.asc_nulls_last("current_path")], MAX_SYMBOLS).drop("rank")
    listed = symbols.join(broadcast_if_small(stage(first, "first_files")), _FILE)
    file_stats = listing.filter(known).select("repo", "current_path", *(F.coalesce(c, zero).alias(c) for c in ("functions", "classes")))

    sections = {"commits": commits, "prs": prs, "symbols": listed, "file_stats": file_stats}
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (_tagged(rows, name) for name, rows in sections.items()))
    order = [F.asc_nulls_last(name) for name in _PLACES]
    cap = reduce(lambda c, name: F.when(F.col("section") == name, _CAPS[name]).otherwise(c), _CAPS, F.lit(0))
    ranked = top_n(tagged, ["repo", "section"], order, max(_CAPS.values())).filter(F.col("rank") <= cap)
    sums = listing.groupBy("repo").agg(
        F.sum("functions").alias("functions_count"), F.sum("classes").alias("classes_count"), F.count_if(known).alias("files_count"))
    lines = ranked.unionByName(sums, allowMissingColumns=True)

    def gathered(name: str) -> Column:
        item = F.when(F.col(f"_{name}").isNotNull(), F.struct("rank", F.col(f"_{name}").alias("item")))
        return F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"]).alias(name)

    totals = ("functions_count", "classes_count", "files_count")
    report = repos.join(lines.groupBy("repo").agg(*map(gathered, _ITEMS), *(F.max(c).alias(c) for c in totals)), "repo", "left")
    details = [c for c in repos.columns if c != "repo"]
    kept = {name: F.coalesce(name, F.array().cast(report.schema[name].dataType)) for name in _ITEMS}
    sizes = [F.coalesce(F.size(kept[name]), F.lit(0)).cast("bigint").alias(f"{name}_count") for name in ("commits", "prs")]
    stats = F.struct(*sizes, *(F.coalesce(c, zero).alias(c) for c in totals))
    return report.select("repo", F.struct(*details).alias("details"), *(c.alias(name) for name, c in kept.items()), stats.alias("stats"))


def degraded(reports: DataFrame, checked_out: DataFrame) -> DataFrame:
    """Reports of repositories without a checkout keep metadata, commits and pull requests only.

    `checked_out` holds the repositories whose tree could be read.
    """
    marked = reports.join(checked_out.select("repo").distinct().withColumn("_tree", F.lit(True)), "repo", "left")
    missing = F.col("_tree").isNull()
    for name in ("symbols", "file_stats"):
        marked = marked.withColumn(name, F.when(missing, F.array().cast(reports.schema[name].dataType)).otherwise(F.col(name)))
    stats = F.col("stats")
    for name in ("functions_count", "classes_count", "files_count"):
        stats = stats.withField(name, F.when(missing, F.lit(0).cast("bigint")).otherwise(F.col(f"stats.{name}")))
    return (
        marked.withColumn("stats", stats)
        .withColumn("warning", F.when(missing, F.lit(NO_CHECKOUT)))
        .drop("_tree")
    )


def as_json(reports: DataFrame) -> DataFrame:
    """(repo, report): each report as JSON text, with its nulls."""
    return reports.select("repo", F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"))


def repo_contexts(reports: DataFrame) -> DataFrame:
    """(repo, context) of reports whose details have a `description`: a projection of each report."""
    return reports.select("repo", context.report_context().alias("context"))

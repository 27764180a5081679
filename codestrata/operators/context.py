"""Context texts and prompts. Every list a text is made of is capped before it is gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import preview

# Section order and line formats of the two context texts.
STATISTICS = (
    ("Files", "files_count"),
    ("Functions", "functions_count"),
    ("Classes", "classes_count"),
    ("Commits", "commits_count"),
    ("Pull Requests", "prs_count"),
)
SECTIONS = (("functions", "Functions:"), ("commits", "Commits:"), ("prs", "PRs:"))
NO_CONTEXT = "No relevant repository context found."


def _lines(rows: DataFrame, keys: list[str], order: str, line: Column, name: str, separator: str = "\n") -> DataFrame:
    """One text per key from its lines in order."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(gathered, lambda s: s["line"]), separator).alias(name)
    )


def _shown(c: Column) -> Column:
    """A missing value must not blank out its whole line."""
    return F.coalesce(c, F.lit("None"))


def _file_block(path: Column, symbols: Column, names: int) -> Column:
    """A file's path and the first names of its functions and classes."""
    def listed(label: str, kind: str) -> Column:
        of_kind = F.filter(symbols, lambda s: s["file"].eqNullSafe(path) & (s["kind"] == kind))
        found = F.array_join(F.transform(F.slice(of_kind, 1, names), lambda s: s["name"]), ", ")
        return F.when(found != "", F.concat(F.lit(f"\n  {label}: "), found)).otherwise(F.lit(""))

    return F.concat(F.lit("\n"), path, F.lit(":"), listed("Functions", "function"), listed("Classes", "class"))


def _block(header: str, items: Column, line: Callable[[Column], Column]) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{header}\n"), F.array_join(F.transform(items, line), "\n")))


def report_context(shown: int = 5, symbols: int = 100, files: int = 10, names: int = 10) -> Column:
    """The context of a report row: counts, names by file, newest commits and pull requests.

    The first `symbols` symbols count; files keep first-seen order and stop at `files`, names of a kind at
    `names`, commits and pull requests at `shown`. The report's lists are capped, so this is work within a row.
    """
    def commit_line(c: Column) -> Column:
        return F.concat(F.lit("- "), _shown(preview(c["message"])), F.lit(" (by "), _shown(c["author"]), F.lit(")"))

    def pr_line(p: Column) -> Column:
        return F.concat(
            F.lit("- PR #"), _shown(p["number"].cast("string")), F.lit(": "), _shown(preview(p["title"])), F.lit(" ("), _shown(p["state"]), F.lit(")")
        )

    seen = F.slice("symbols", 1, symbols)
    paths = F.slice(F.array_distinct(F.transform(seen, lambda s: s["file"])), 1, files)
    counts = [F.concat(F.lit(f"- {label}: "), F.col(f"stats.{column}").cast("string")) for label, column in STATISTICS]
    description = F.col("details.description")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Repository: "), "repo"),
        F.when(description != "", F.concat(F.lit("Description: "), description)),
        F.lit("\nCodebase Statistics:"),
        *counts,
        _block("Code Structure:", paths, lambda path: _file_block(path, seen, names)),
        _block("Recent Commits:", F.slice("commits", 1, shown), commit_line),
        _block("Recent Pull Requests:", F.slice("prs", 1, shown), pr_line),
    )


def retrieval_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Add `context` to every query: numbered hits per collection, sections without hits left out.

    `hits` are resolved: query_id, collection, rank and the item's `name` and `text`.
    """
    title = F.concat(F.col("rank").cast("string"), F.lit(". "))
    named = F.concat(F.coalesce("name", F.lit("unknown")), F.lit(": "))
    text = F.coalesce("text", F.lit(""))
    line = F.concat(title, F.when(F.col("collection") == "functions", named).otherwise(F.lit("")), text)
    sections = _lines(hits, ["query_id", "collection"], "rank", line, "body")
    place, header = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (collection, heading) in enumerate(SECTIONS):
        same = F.col("collection") == collection
        place = F.when(same, F.lit(i)).otherwise(place)
        header = F.when(same, F.lit(heading)).otherwise(header)
    ordered = sections.withColumn("place", place).withColumn("header", header).filter("place is not null")
    block = F.concat("header", F.lit("\n"), "body")
    contexts = _lines(ordered, ["query_id"], "place", block, "context", "\n\n")
    return queries.join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def or_fallback(context: Column) -> Column:
    return F.when(context.isNull() | (context == ""), F.lit(NO_CONTEXT)).otherwise(context)


def retrieval_prompt(context: Column, question: Column, role: str = "Notes on a code base follow; rely on them alone.") -> Column:
    """Role line, context, question, answer cue."""
    return F.concat(F.lit(f"{role}\n\nContext:\n"), or_fallback(context), F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:"))


def service_prompt(repo: Column, context: Column, question: Column, role: str = "Code base:", instruction: str = "Name the files, commits or requests behind each point.") -> Column:
    """Role line naming the repository, context, question, instruction."""
    return F.concat(F.lit(f"{role} "), repo, F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion:\n"), question, F.lit(f"\n\n{instruction}"))

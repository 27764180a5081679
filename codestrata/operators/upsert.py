"""First-write-wins inserts, the file dictionary and repeatable symbol writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.ranking import numbered
from codestrata.session import broadcast_if_small, stage


def first_write(rows: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the first to arrive; one without an arrival comes after those that have it.

    Rows with a null in the key are all kept, as in SQLite. An aggregate rather than a window, so a hot key shrinks to one row per task before the shuffle.
    """
    has_key = _no_nulls(keys)
    order = F.struct(*(part for c in arrival for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    rest = [c for c in rows.columns if c not in keys]
    kept = (
        rows.filter(has_key)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
    )
    return kept.unionByName(rows.filter(~has_key)).select(*rows.columns)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: list[str], small_batch: bool = False) -> DataFrame:
    """The incoming rows an insert-or-ignore would add.

    `small_batch` suits a micro-batch against a large table: the table is only filtered by the
    batch's broadcast keys, so it is read once and never shuffled. The broadcast is size-checked.
    """
    first = first_write(incoming, keys, arrival)
    taken = existing.select(*keys)
    if small_batch:
        batch_keys = incoming.select(*keys).filter(_no_nulls(keys)).distinct()
        taken = taken.join(broadcast_if_small(batch_keys), keys, "left_semi")
    return first.join(taken, keys, "left_anti")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The table after the insert: existing rows win, then the first arrival."""
    fresh = new_rows(existing, incoming, keys, arrival)
    return existing.unionByName(fresh.select(*existing.columns))


def new_files(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(repo, file_id, current_path) of the distinct non-null paths that `existing` lacks, numbered above its ids.

    Ids are dense numbers, so two paths cannot share one, and they come from the parts' counts, not from a
    window over all paths. One writer at a time may add to a dictionary.
    """
    found = paths.select("repo", "current_path").filter(F.col("current_path").isNotNull()).distinct()
    found = found.join(existing.select("repo", "current_path"), ["repo", "current_path"], "left_anti")
    last = existing.agg(F.max("file_id")).first()[0]
    return numbered(found, "file_id", max(0, last or 0)).select("repo", "file_id", "current_path")


def file_dictionary(paths: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(repo, file_id, current_path) of every distinct non-null path; existing entries keep their id."""
    if existing is None:
        existing = paths.sparkSession.createDataFrame([], "repo string, file_id bigint, current_path string")
    return existing.select("repo", "file_id", "current_path").unionByName(new_files(paths, existing))


def replace_symbols(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append symbols so that indexing a commit again replaces its rows instead of doubling them."""
    indexed = stage(incoming.select("repo", "commit_sha").distinct(), "indexed_commits")
    kept = existing.join(broadcast_if_small(indexed), ["repo", "commit_sha"], "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def _no_nulls(keys: list[str]) -> Column:
    test = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        test = test & F.col(key).isNotNull()
    return test

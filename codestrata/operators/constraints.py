"""Declared constraints as checks that report instead of raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import broadcast_if_small, stage

# Kinds a symbol may have; null passes, as in a SQL CHECK.
KINDS = ("function", "class")
_REQUIRED = ("file_id", "commit_sha", "name")


def tag_violations(symbols: DataFrame) -> DataFrame:
    """Add `violation`: the first broken rule of a symbol row, or null."""
    broken = F.lit(None).cast("string")
    for column in reversed(_REQUIRED):
        broken = F.when(F.col(column).isNull(), F.lit(f"{column} is null")).otherwise(broken)
    bad_kind = ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(True))
    return symbols.withColumn("violation", F.coalesce(broken, F.when(bad_kind, F.lit("kind not allowed"))))


def split_valid(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be stored, rejected rows with their reason)."""
    tagged = tag_violations(symbols)
    return tagged.filter("violation is null").drop("violation"), tagged.filter("violation is not null")


def orphans(symbols: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """Symbol rows whose file or commit is missing, one row per broken reference; a null refers to nothing.

    The distinct references are compared with the parents, so a hot file or commit counts once. The
    symbol rows are then only filtered by the references found broken.
    """
    return _broken(symbols, files, ["repo", "file_id"], "files").unionByName(
        _broken(symbols, commits, ["repo", "commit_sha"], "commits")
    )


def _broken(symbols: DataFrame, parents: DataFrame, key: list[str], name: str) -> DataFrame:
    used = symbols.select(*key).distinct()
    missing = stage(used.join(parents.select(*key), key, "left_anti"), f"missing_{name}")
    found = symbols.join(broadcast_if_small(missing), key, "left_semi")
    return found.select(*symbols.columns, F.lit(name).alias("missing"))

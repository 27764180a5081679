"""Caps and numbering per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import stage

_SALT = "_salt"
_PLACE_BITS = 33


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first `n` rows per key in a total order, numbered from 1.

    Done twice: first within (key, salt), where the salt is the input partition, then within the
    key. Spark limits each group to `n` rows on the map side of both shuffles, so the task that
    finally holds a hot key receives at most `salts * n` rows however large the key is.
    """
    within = Window.partitionBy(*keys, _SALT).orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    local = (
        df.withColumn(_SALT, F.spark_partition_id() % salts)
        .withColumn(rank, F.row_number().over(within))
        .filter(F.col(rank) <= n)
        .drop(rank, _SALT)
    )
    return local.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def numbered(df: DataFrame, column: str, above: int = 0) -> DataFrame:
    """The rows, staged, with consecutive whole numbers from `above` + 1 on in no stated order.

    A row knows its place within its part; only the parts' counts, one row each, are summed up.
    """
    at = F.col("_at")
    rows = stage(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(at, _PLACE_BITS), at.bitwiseAND((1 << _PLACE_BITS) - 1)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbers = rows.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return numbers.withColumn(column, F.lit(above) + F.col("_before") + place + 1).select(*df.columns, column)


def recent_commits(commits: DataFrame, n: int = 50) -> DataFrame:
    """The `n` newest commits of every repository."""
    return top_n(commits, ["repo"], [F.desc("committed_at"), F.asc("commit_sha")], n)


def recent_prs(prs: DataFrame, n: int = 30, by: str = "created_at") -> DataFrame:
    """The `n` newest pull requests of every repository, in any state."""
    return top_n(prs, ["repo"], [F.desc(by), F.desc("number")], n)

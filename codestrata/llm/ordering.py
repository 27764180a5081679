"""Ranks and running sums over one global order, without a window that holds a whole group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import stage

_LOCAL_BITS = 33


def carried(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that working columns cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows range-sorted by `order`, staged, with `part` and `pos` (place within the part).

    Rows equal in `order` are spread over parts by a running number, so a key that many rows
    share does not make one large part. Their relative order is open; staging fixes it.
    """
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie")
    at = F.monotonically_increasing_id()
    rows = ranged.sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", at)
    return stage(rows, "order").select(
        "*", F.shiftright("at", _LOCAL_BITS).alias("part"), F.col("at").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("pos"),
    ).drop("at")


def ranked(df: DataFrame, order: list[str], group: str | None = None, value: str | None = None) -> DataFrame:
    """`df` with `rank` (from 0, within `group`), `members` of the group and, given `value`, `before` and `total`.

    The group must lead `order`. Each part knows its place within itself; only one row a part and group is
    summed up over the parts, so a group may hold any share of the rows. `before` is the sum of `value`
    over the rows that precede in the group. `df` must not hold columns of these names, nor part, pos, tie, at.
    """
    rows = in_order(df if group else df.withColumn("whole", F.lit(0)), order)
    key = group or "whole"
    sums = [F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first")]
    if value:
        sums.append(F.sum(value).alias("amount"))
    parts = rows.groupBy(key, "part").agg(*sums)
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    parts = parts.select(
        F.col(key).alias("p_key"), F.col("part").alias("p_part"), "first",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.sum("rows").over(whole).alias("members"),
        *([F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("amount_before"),
           F.sum("amount").over(whole).alias("total")] if value else []),
    )
    out = rows.join(parts, (F.col(key).eqNullSafe(F.col("p_key"))) & (F.col("part") == F.col("p_part")))
    added = [(F.col("rows_before") + F.col("pos") - F.col("first")).alias("rank"), F.col("members")]
    if value:
        within = Window.partitionBy("part", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        added += [(F.col("amount_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).alias("before"), F.col("total")]
    return out.select(*(F.col(c) for c in df.columns), *added)


def runs(batches, keys: int):
    """Tables of the rows that agree in the first `keys` columns, from rows in their order."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        first = 0
        for i, name in enumerate(names):
            if name != now:
                if now is not None and i > first:
                    held.append(batch.slice(first, i - first))
                if held:
                    yield pa.Table.from_batches(held)
                held, now, first = [], name, i
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)

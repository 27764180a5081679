"""Shards that all hold the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import ranked


def interleaved(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row, in DataFrame operations only.

    Rows of a source are ranked in a seeded random order; the fractional ranks (rank + 1/2) / rows of all
    sources are sorted together and the order is cut into `shards` runs whose lengths differ by one at most,
    so each run holds every source in proportion. Both ranks come from range sorts of narrow rows (no text is
    shuffled), and a source may hold any share of the rows. `size` is the text's UTF-8 bytes plus 16.

    A null text counts as empty, null sources are one source, null ids are ids like others. Rows that agree
    in id, source and text are interchangeable. With fewer rows than shards some shards are empty; an
    empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), body).alias("shuffled"),
    )
    placed = ranked(rows, ["source", "shuffled", "doc_id", "text_crc32"], group="source")
    strata = placed.select(*rows.columns, ((F.col("rank") + 0.5) / F.col("members")).alias("share"))
    cut = ranked(strata, ["share", "shuffled", "doc_id", "source", "text_crc32"]).withColumn(
        "shard", F.expr(f"cast(rank * {shards} div members as int)"))
    start = F.expr(f"(shard * members + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("rank") - start).alias("slot"))

"""Packing into length buckets with the least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.ordering import ranked
from codestrata.session import stage


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` upper bounds that minimise the padding of `counts` texts of `lengths` (ascending).

    Dynamic programming over the histogram: the least padding of the first j lengths in b buckets. The
    cost of a bucket meets the quadrangle inequality, so the best last cut never moves left as j grows; each
    layer is solved by halving, all ranges of a level at once, in time m log m for m lengths.
    """
    m = len(lengths)
    if not m:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    words = np.concatenate([[0], np.cumsum(counts.astype(np.float64) * lengths)])

    def cost(i, j):  # lengths[i:j] padded to lengths[j - 1]
        return lengths[j - 1] * (rows[j] - rows[i]) - (words[j] - words[i])

    best = cost(np.zeros(m, dtype=np.int64), np.arange(1, m + 1))
    best = np.concatenate([[0.0], best])
    cuts = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        layer, cut = np.full(m + 1, 0.0), np.zeros(m + 1, dtype=np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, least, most = todo.pop()
            j = (lo + hi) // 2
            i = np.arange(least, min(most, j - 1) + 1)
            total = best[i] + cost(i, np.full(len(i), j))
            at = int(np.argmin(total))
            layer[j], cut[j] = total[at], i[at]
            if lo < j:
                todo.append((lo, j - 1, least, int(i[at])))
            if j < hi:
                todo.append((j + 1, hi, int(i[at]), most))
        best = layer
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(set(bounds))


def packed(rows: DataFrame, length: str, buckets: int = 16, budget: int = 16_384, seed: int = 3, id_col: str = "doc_id") -> DataFrame:
    """doc_id, length, bucket, padded (the bucket's length), batch and slot of every row.

    The histogram of all lengths up to `budget` decides the bounds (`best_bounds`); it has `budget` + 1 rows
    at most, whatever the input, and comes to the driver. In a bucket rows stand in a seeded random order
    and fill batches of floor(budget / padded) rows. A row longer than `budget` fits no batch and makes one of
    its own, unpadded, in bucket -1. Batches are numbered from 0 within the bucket, so (bucket, batch) names one.

    A null length counts as 0; lengths of 0 share the first bucket. Null ids, ties and repeated rows are
    rows like others. An empty table gives no rows. Other columns are not read.
    """
    narrow = stage(rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.greatest(F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0)), F.lit(0)).alias("length")), "lengths")
    found = narrow.where(F.col("length") <= budget).groupBy("length").count().orderBy("length").toPandas()
    bounds = best_bounds(found["length"].to_numpy(np.int64), found["count"].to_numpy(np.int64), buckets) or [0]
    bucket = F.when(F.col("length") > budget, F.lit(-1))
    for k, bound in enumerate(bounds):
        bucket = bucket.when(F.col("length") <= bound, F.lit(k))
    padded = F.when(F.col("bucket") < 0, F.col("length")).otherwise(F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.greatest(F.col("bucket"), F.lit(0)) + 1))
    placed = narrow.withColumn("bucket", bucket.cast("int")).withColumn("padded", padded)
    placed = placed.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "length"))
    room = F.when(F.col("bucket") < 0, F.lit(1)).otherwise(F.expr(f"greatest(1, {budget} div greatest(padded, 1))"))
    done = ranked(placed, ["bucket", "shuffled", "doc_id", "length"], group="bucket").withColumn("room", room.cast("long"))
    return done.select("doc_id", "length", "bucket", "padded", F.expr("rank div room").alias("batch"), F.expr("rank % room").alias("slot"))

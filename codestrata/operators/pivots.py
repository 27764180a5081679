"""Exact nearest-neighbour search that reads only the parts of a stored table that the triangle inequality leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.vectors import as_matrix, knn
from codestrata.session import stage

#: What the choice of pivots looks at: so many bytes of vectors, the first by a hash of their ids. Every vector is indexed.
SAMPLE_BYTES = 16 * 1024 * 1024
_ROUNDS = 6
_SLACK = 1e-6
#: More conditions than this are given per pivot only, without its distances.
_CONDITIONS = 512
_CELLS = 100_000


class PivotIndex(NamedTuple):
    """`rows` (collection, item_id, embedding, pivot, pivot_distance) lie sorted by the last two; `cells` says what each pivot holds."""

    rows: DataFrame
    cells: DataFrame
    pivots: np.ndarray
    metric: str


def scaled(vectors: np.ndarray, metric: str) -> np.ndarray:
    """The vectors that distances are taken of: as they are, or of length one; a zero vector, which has no direction, stays."""
    if metric != "unit" or not len(vectors):
        return vectors
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of `a` and of `b`, which are pivots and so few."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def choose_pivots(vectors: DataFrame, dim: int, metric: str = "l2", most: int = 256) -> np.ndarray:
    """Centres of a bounded sample: about one for each square root of rows, `most` at most.

    Any vectors would give right results; centres of clusters let a search skip the other clusters.
    """
    vectors = vectors.filter("embedding is not null")
    rows = vectors.count()
    if not rows:
        return np.zeros((0, dim))
    sample = vectors.orderBy(F.xxhash64("item_id"), "item_id").limit(max(most, SAMPLE_BYTES // (8 * max(1, dim)))).select("embedding").toArrow()
    points = np.unique(scaled(as_matrix(sample.column("embedding")), metric), axis=0)
    count = min(len(points), most, max(1, math.isqrt(rows) // 2))
    # Farthest points first, so that every cluster gets one, then a few rounds of means.
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < count:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    centers = points[chosen]
    for _ in range(_ROUNDS):
        nearest = distances(points, centers).argmin(axis=1)
        held = np.bincount(nearest, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
    return centers


def with_pivots(vectors: DataFrame, pivots: np.ndarray, metric: str = "l2") -> DataFrame:
    """Add `pivot`, the place of the nearest pivot, and `pivot_distance`. Vectors of another width are errors."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # `most` rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = as_matrix(batch.column("embedding"))
            if found.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors of width {found.shape[1]} in an index of width {shared.value.shape[1]}")
            gaps = distances(scaled(found, metric), shared.value)
            nearest = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(nearest.astype(np.int32)), pa.array(gaps[np.arange(len(gaps)), nearest])],
                names=[*batch.schema.names, "pivot", "pivot_distance"])

    plain = vectors.select("collection", "item_id", "embedding").filter("embedding is not null")
    return plain.mapInArrow(place, "collection string, item_id string, embedding array<float>, pivot int, pivot_distance double")


def cells_of(placed: DataFrame) -> DataFrame:
    """collection, pivot, rows, and the least and greatest distance of its vectors."""
    return placed.groupBy("collection", "pivot").agg(
        F.count("*").alias("rows"), F.min("pivot_distance").alias("low"), F.max("pivot_distance").alias("high"))


def reachable(gaps: np.ndarray, bound: np.ndarray, pivot: int, low: float, high: float, pivots: np.ndarray) -> tuple[float, float] | None:
    """Between which distances from `pivot` a vector may lie that is within `bound` of one of the queries, or None.

    `gaps` are the queries' distances to all pivots. A vector x of the pivot's cell has d(q, x) >= |d(q, p) - d(p, x)|, and as
    no pivot is nearer to it than p, it lies on p's side of the plane halfway to the query's own nearest pivot.
    """
    room = bound + _SLACK * (1 + np.where(np.isfinite(bound), bound, 0) + gaps[:, pivot])
    own = gaps.argmin(axis=1)
    apart = np.sqrt(((pivots[own] - pivots[pivot]) ** 2).sum(axis=1))
    plane = (gaps[:, pivot] ** 2 - gaps[np.arange(len(gaps)), own] ** 2) / np.maximum(2 * apart, 1e-300)
    first, last = np.maximum(gaps[:, pivot] - room, low), np.minimum(gaps[:, pivot] + room, high)
    near = (first <= last) & ((apart == 0) | (plane <= room))
    return (float(first[near].min()), float(last[near].max())) if near.any() else None


def to_read(index: PivotIndex, queries: DataFrame, k: int = 5, broadcast_bytes: int = 64 * 1024 * 1024) -> Column | None:
    """What a search of `queries` must read of `index.rows`, as a condition that reaches the Parquet scan; None for all.

    First the cells nearest to each query, as many as hold `k` rows, are searched: the k-th distance found bounds the
    result's. Then every cell is left out, or cut to a range of distances, that the bound rules out for all queries.
    """
    asked = stage(queries.filter("embedding is not null").select("query_id", "embedding"), "queries")
    row_bytes = 8 * max(1, index.pivots.shape[1]) + 8 * max(1, len(index.pivots))
    if asked.count() * row_bytes > broadcast_bytes or not len(index.pivots):
        return None
    cells = index.cells.limit(_CELLS + 1).collect()
    if len(cells) > _CELLS:
        return None
    table = asked.toArrow()  # `broadcast_bytes`, checked above
    ids, vectors = np.array(table.column("query_id").cast(pa.string()).to_pylist(), object), as_matrix(table.column("embedding"))
    if not len(ids):
        return F.lit(False)
    gaps = distances(scaled(vectors, index.metric), index.pivots)
    by_collection: dict[str, list] = {}
    for cell in cells:
        by_collection.setdefault(cell["collection"], []).append(cell)
    probes = {}
    for name, held in by_collection.items():
        near = np.argsort(gaps[:, [c["pivot"] for c in held]], axis=1, kind="stable")
        rows = np.array([c["rows"] for c in held])[near].cumsum(axis=1)
        taken = np.arange(len(held)) <= (rows < k).sum(axis=1)[:, None]
        probes[name] = sorted({held[i]["pivot"] for i in np.unique(near[taken])})
    first = _any([(F.col("collection") == name) & F.col("pivot").isin(found) for name, found in probes.items()])
    hits = knn(index.rows.filter(first), asked, k, index.metric).filter(F.col("rank") == k).select("collection", "query_id", "distance").collect()
    place = {q: i for i, q in enumerate(ids)}
    bounds = {name: np.full(len(ids), np.inf) for name in by_collection}
    for hit in hits:  # one a query and collection
        bounds[hit["collection"]][place[hit["query_id"]]] = math.sqrt(max(0.0, hit["distance"]))
    if index.metric == "unit":
        for bound in bounds.values():
            bound[~vectors.any(axis=1)] = -1.0  # a query without direction finds nothing
    wanted = []
    for name, held in by_collection.items():
        for cell in held:
            span = reachable(gaps, bounds[name], cell["pivot"], cell["low"], cell["high"], index.pivots)
            if span:
                wanted.append((name, cell["pivot"], *span))
    if len(wanted) > _CONDITIONS:
        return _any([(F.col("collection") == name) & F.col("pivot").isin([p for n, p, _, _ in wanted if n == name]) for name in by_collection])
    return _any([(F.col("collection") == name) & (F.col("pivot") == pivot) & F.col("pivot_distance").between(low - _SLACK, high + _SLACK) for name, pivot, low, high in wanted])


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a balanced tree."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0] if conditions else F.lit(False)


def search(index: PivotIndex, queries: DataFrame, k: int = 5, broadcast_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """What `knn` finds in `index.rows`, ties included, from the rows that can be among the results.

    Many queries, or cells, than can be looked at together read all rows.
    """
    condition = to_read(index, queries, k, broadcast_bytes)
    rows = index.rows if condition is None else index.rows.filter(condition)
    return knn(rows, queries, k, index.metric, broadcast_bytes)

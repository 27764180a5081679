"""Exact top-k inner products, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.ordering import ranked
from codestrata.session import stage

LEVELS = (4, 16)
#: Rows and queries that meet at once: the matrices of a tile have this many cells squared.
_CHUNK = 2048
_SEEDS = 512
_FLOAT_EXACT = 2.0**53


def whole_vectors(ids: pa.Array, vectors: pa.Array, scale: float = 256.0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: ids and floor(scale * component) of the rows whose id and components are all there and finite."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    good = ~(ids.is_null().to_numpy(zero_copy_only=False) | vectors.is_null().to_numpy(zero_copy_only=False))
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    width = np.diff(offsets)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for w in np.unique(width[good]).tolist():
        rows = np.flatnonzero(good & (width == w))
        values = np.floor(flat[offsets[rows][:, None] + np.arange(w)] * scale)
        finite = np.isfinite(values).all(axis=1)
        if finite.any():
            out[w] = numbers[rows[finite]], values[finite]
    return out


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of `segments` runs of components, both times the root of the run's length.

    The distance of two vectors is at least the distance of their statistics, and a vector and its
    statistics have the same norm; so the statistics' inner product bounds the vectors' from above.
    """
    width = vectors.shape[1]
    edges = np.unique(np.linspace(0, width, min(segments, max(width, 1)) + 1).astype(np.int64))[:-1]
    if not width:
        return np.zeros((len(vectors), 1))
    length = np.diff(np.append(edges, width)).astype(np.float64)
    total = np.add.reduceat(vectors, edges, axis=1)
    squares = np.add.reduceat(vectors * vectors, edges, axis=1)
    spread = np.maximum(squares - total * total / length, 0.0)
    return np.hstack([total / np.sqrt(length), np.sqrt(spread)])


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of the named pairs, as 64-bit integers."""
    if not len(q):
        return np.zeros(0, np.int64)
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    if most < _FLOAT_EXACT:
        if 4 * len(q) > len(queries) * len(rows):
            return (queries @ rows.T)[q, r].astype(np.int64)
        found = np.empty(len(q), np.float64)
        for a in range(0, len(q), 1 << 16):
            found[a : a + (1 << 16)] = np.einsum("ij,ij->i", queries[q[a : a + (1 << 16)]], rows[r[a : a + (1 << 16)]])
        return found.astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(queries[i], rows[j], strict=True)) for i, j in zip(q, r, strict=True)]
    return np.array(sums, np.int64)  # raises OverflowError where a score has no 64-bit form


def best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's `k` best rows: by score, then smaller id; a row id counts once."""
    order = np.lexsort((-score, row, query))
    first = np.ones(len(order), bool)
    first[1:] = (query[order][1:] != query[order][:-1]) | (row[order][1:] != row[order][:-1])
    order = order[first]
    order = order[np.lexsort((row[order], -score[order], query[order]))]
    q = query[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[rank < k]


class Block:
    """Queries of one width with their statistics."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.linalg.norm(vectors, axis=1)
        self.levels = [statistics(vectors, s) for s in LEVELS if s < max(2, vectors.shape[1])]

    def seeded(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A lower bound of each query's k-th score, from a few of the rows."""
        seed_ids, seeds = np.unique(ids, return_index=True)
        seed_ids, seeds = seed_ids[:_SEEDS], seeds[:_SEEDS]
        if len(seeds) <= self.k:
            return np.full(len(self.ids), -np.inf)
        found = self.vectors @ rows[seeds].T
        found[self.ids[:, None] == seed_ids] = -np.inf
        kth = -np.partition(-found, self.k - 1, axis=1)[:, self.k - 1]
        return kth - 1e-9 * (1 + np.abs(kth)) - 1e-9 * self.norm * np.linalg.norm(rows[seeds], axis=1).max(initial=0)

    def survivors(self, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that no level's bound rules out."""
        norm = np.linalg.norm(rows, axis=1)
        columns = np.arange(len(rows))
        alive = np.ones((len(self.ids), len(rows)), bool)
        for segments, mine in zip(LEVELS, self.levels, strict=False):
            slack = 1e-9 * (1 + self.norm[:, None] * norm[columns])
            alive &= mine @ statistics(rows[columns], segments).T + slack >= least[:, None]
            some = alive.any(axis=0)
            columns, alive = columns[some], alive[:, some]
        q, at = np.nonzero(alive)
        return q, columns[at]


class Search:
    """The best rows so far of one tile of queries."""

    def __init__(self, block: Block):
        self.block, self.least = block, np.full(len(block.ids), -np.inf)
        self.q = self.r = self.s = np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        block = self.block
        if np.isneginf(self.least).any():
            self.least = np.maximum(self.least, block.seeded(ids, rows))
        q, at = block.survivors(rows, self.least)
        other = block.ids[q] != ids[at]
        q, at = q[other], at[other]
        scores = exact(block.vectors, rows, q, at)
        near = scores >= self.least[q]
        q, r, s = (np.concatenate(x) for x in ((self.q, q[near]), (self.r, ids[at[near]]), (self.s, scores[near])))
        kept = best(q, r, s, block.k)
        self.q, self.r, self.s = q[kept], r[kept], s[kept]
        last = np.cumsum(np.bincount(self.q, minlength=len(self.least))) - 1
        full = np.bincount(self.q, minlength=len(self.least)) == block.k
        self.least[full] = np.maximum(self.least[full], self.s[last[full]])


def searches(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, list[Search]]:
    """By width, the queries in tiles."""
    return {w: [Search(Block(ids[a : a + _CHUNK], vectors[a : a + _CHUNK], k)) for a in range(0, len(ids), _CHUNK)] for w, (ids, vectors) in queries.items()}


def _searcher(queries, k: int, scale: float):
    def search(batches):
        held = searches(queries.value, k)
        for batch in batches:
            for width, (ids, rows) in whole_vectors(batch.column(0), batch.column(1), scale).items():
                for a in range(0, len(ids), _CHUNK):
                    for tile in held.get(width, ()):
                        tile.meet(ids[a : a + _CHUNK], rows[a : a + _CHUNK])
        for tile in (t for tiles in held.values() for t in tiles):
            yield pa.RecordBatch.from_arrays([pa.array(tile.block.ids[tile.q]), pa.array(tile.r), pa.array(tile.s)], names=["query_id", "vec_id", "score"])
    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding",
          block_bytes: int = 128 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's `k` highest integer inner products, exactly.

    Components become floor(scale * x). Queries go to all tasks in blocks of `block_bytes` at most, one scan of the vectors
    a block; in a task tiles of a block and of its rows meet one after another, so its matrices do not grow with either. The
    vectors are read in place, pruned by segment statistics (`LEVELS`, coarse to fine) against the k-th best
    score so far, and the survivors' exact scores are taken. A task returns `k` rows a query at most. Queries need not
    be rows of `vectors`: each task's first bound comes from its own rows.

    Rows with a null id or vector, or a null or non-finite component, take no part. Vectors meet queries of their
    own width only. A row is never a candidate of a query of its id; rows that repeat an id count once, with their best
    score. Ties go to the smaller id. Fewer than `k` candidates give all; an empty side gives no rows. A score
    beyond 64 bits is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    corpus = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where("vec_id is not null and v is not null")
    asked = stage(ranked(asked, ["vec_id"]).select("vec_id", "v", "rank"), "queries")
    count, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    size = max(1, block_bytes // (8 * max(1, widest)))
    schema = "query_id long, vec_id long, score long"
    parts = []
    for first in range(0, count, size):
        table = asked.where((F.col("rank") >= first) & (F.col("rank") < first + size)).select("vec_id", "v").toArrow()
        blocks = spark.sparkContext.broadcast(whole_vectors(table.column(0), table.column(1), scale))
        part = corpus.mapInArrow(_searcher(blocks, k, scale), schema)
        parts.append(part if count <= size else stage(part, "hits"))
    hits = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        hits = hits.unionByName(part)
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

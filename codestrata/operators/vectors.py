"""Embedding of texts and exact nearest-neighbour search."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions.text import is_blank
from codestrata.operators.ranking import top_n
from codestrata.session import stage

# Fixed value: width of the vector that replaces a failed embedding.
FAILURE_WIDTH = 1536

_HITS = "collection string, query_id string, item_id string, distance double"
_HITS_ARROW = pa.schema([
    ("collection", pa.string()), ("query_id", pa.string()), ("item_id", pa.string()), ("distance", pa.float64()),
])
_CELLS = 1_000_000
_HELD = 1_000_000
# What a task splits into words at once; its words take many times as much.
_TEXT_BYTES = 4 * 1024 * 1024
# Never part of a word, in whatever version of Unicode.
_BETWEEN_WORDS = re.compile("[\0-/:-@\\[-`{-\x7f\u2000-\u200a\u2010-\u2029\u3000-\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` bytes, as [start, stop); a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def text_pieces(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """The texts as they are, or, of a single one longer than `most` characters, pieces that are cut between words."""
    text = texts[0].as_py() if len(texts) == 1 else None
    if text is None or len(text) <= most:
        yield texts
        return
    start = 0
    while start < len(text):
        gap = _BETWEEN_WORDS.search(text, start + most)
        stop = gap.start() if gap else len(text)
        yield pa.array([text[start:stop]])
        start = stop


def hashing_embedder(dim: int = 256) -> Callable[[Column], Column]:
    """Default embedder: signed counts of a text's words in `dim` buckets, as exact whole numbers.

    An Arrow UDF like any model would be, so it needs no shuffle; a remote or local model plugs in
    as another Column -> Column function that gives null where it fails. Such a UDF should be marked
    non-deterministic, as here: otherwise Spark copies the call into every filter on its result.
    """
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed_words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}

        def cells(words: list[str]) -> np.ndarray:
            """Each word's bucket, twice, and one more for a positive sign."""
            if len(known) > 300_000:
                known.clear()
            for word in words:
                if word not in known:
                    digest = md5(word.encode()).hexdigest()
                    known[word] = 2 * (int(digest[:8], 16) % dim) + (digest[8] < "8")
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

        def counted(part: pa.Array) -> np.ndarray:
            spaced = pc.replace_substring_regex(pc.cast(pc.fill_null(part, ""), pa.large_string()), r"[^\p{L}\p{N}]+", " ")
            split = pc.split_pattern(pc.ascii_trim(spaced, " "), " ")
            rows = np.repeat(np.arange(len(part)), np.diff(split.offsets.to_numpy()))
            words = split.flatten().dictionary_encode()
            signed = np.append(cells(words.dictionary.to_pylist()), 0)[words.indices.to_numpy()]
            blank = pc.equal(words, "").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)  # a text without words
            signs = np.where(blank, 0, 2 * (signed % 2) - 1)
            return np.bincount(rows * dim + signed // 2, weights=signs, minlength=len(part) * dim)

        for batch in texts:
            counts = np.zeros((len(batch), dim), np.float32)
            for start, stop in text_slices(batch, _TEXT_BYTES):
                pieces = text_pieces(batch.slice(start, stop - start), _TEXT_BYTES)
                counts[start:stop] = sum(map(counted, pieces)).reshape(-1, dim)
            offsets = np.arange(0, len(batch) * dim + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))

    once = embed_words.asNondeterministic()
    return lambda text: once(F.lower(text))


def embed(df: DataFrame, text: str, embedder: Callable[[Column], Column], width: int = FAILURE_WIDTH) -> DataFrame:
    """Add `embedding` and `failed`; rows with blank text are left out, failures become zero vectors."""
    embedded = df.filter(~is_blank(F.col(text))).withColumn("embedding", embedder(F.col(text)))
    failed = F.col("embedding").isNull()
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return embedded.withColumn("failed", failed).withColumn("embedding", F.coalesce("embedding", zero))


def embed_collections(entities: DataFrame, commits: DataFrame, prs: DataFrame, embedder: Callable[[Column], Column], width: int = FAILURE_WIDTH) -> DataFrame:
    """Vectors of three collections in one pass: code, commit messages, pull-request titles.

    Each input has `item_id` and the column named for it.
    """
    texts = (
        entities.select(F.lit("functions").alias("collection"), "item_id", F.col("code").alias("text"))
        .unionByName(commits.select(F.lit("commits").alias("collection"), "item_id", F.col("message").alias("text")))
        .unionByName(prs.select(F.lit("prs").alias("collection"), "item_id", F.col("title").alias("text")))
    )
    return embed(texts, "text", embedder, width).drop("text")


def embed_summary(vectors: DataFrame) -> DataFrame:
    """Embedded and failed items per collection."""
    return vectors.groupBy("collection").agg(
        F.count_if(~F.col("failed")).alias("embedded"), F.count_if("failed").alias("failed")
    )


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )


def build_index(vectors: DataFrame, dim: int) -> DataFrame:
    """The vector table a search reads: one dimension for all, with squared norms.

    A row of another width raises, as building a flat index from it would.
    """
    width = F.size("embedding")
    return vectors.select(
        *vectors.columns,
        F.when(width == dim, squared_norm(F.col("embedding")))
        .otherwise(F.raise_error(F.format_string("vector of %s has width %d", F.col("item_id"), width)))
        .alias("squared_norm"),
    )


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", broadcast_bytes: int = 64 * 1024 * 1024, chunk_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """The exact `k` nearest corpus rows of every query in every collection.

    `corpus` has collection, item_id, embedding; `queries` has query_id, embedding. Distances are
    squared: `l2` on the vectors as they are, `unit` on the vectors scaled to length one (zero
    vectors, which have no direction, are left out). Ties go to the smaller item_id.

    Query vectors that fit `broadcast_bytes` are sent to every task and the corpus is read in place:
    block products per Arrow batch, k rows per query leave a task, one ranking follows. More queries
    than that are split into blocks that meet chunks of the corpus of about `chunk_bytes` in a
    co-grouped shuffle, so no task ever holds more than one block and one chunk, however wide the
    vectors are. The corpus goes over the network once a block and the queries once a chunk; larger
    sizes of both make that less. The queries, and a corpus that is counted, are
    staged: an embedder behind them runs once. Vectors of several widths and rows without an id are errors.
    """
    given = F.col("embedding").isNotNull()
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"a vector has no {c}")).cast("string")).alias(c)
    corpus = corpus.filter(given).select("collection", named("item_id"), "embedding")
    queries = stage(queries.filter(given).select(named("query_id"), "embedding"), "queries")
    sizes = queries.agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).alias("dim"),
        F.sum(F.octet_length("query_id")).alias("id_bytes"),
    ).first()
    row_bytes = 8 * (sizes["dim"] or 1) + 16
    total = sizes["n"] * row_bytes + (sizes["id_bytes"] or 0)
    if total <= broadcast_bytes:
        hits = _knn_broadcast(corpus, queries, k, metric)
    else:
        hits = _knn_blocks(stage(corpus, "corpus"), queries, k, metric, math.ceil(total / broadcast_bytes), chunk_bytes)
    return top_n(hits, ["collection", "query_id"], [F.asc("distance"), F.asc("item_id")], k)


def resolve_hits(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Join hits to the rows they stand for by (collection, item_id), not by list position."""
    return items.join(hits, ["collection", "item_id"])


def _knn_broadcast(corpus: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    table = queries.toArrow()  # at most broadcast_bytes, checked above
    shared = corpus.sparkSession.sparkContext.broadcast(
        (table.column("query_id").to_pylist(), as_matrix(table.column("embedding").combine_chunks()))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(*shared.value, k, metric)
        for batch in batches:
            if nearest.is_full():
                yield nearest.flush()
            nearest.add(batch)
        yield nearest.flush()

    return corpus.mapInArrow(search, _HITS)


def _held_bytes(corpus: DataFrame) -> int:
    """What the corpus takes in a task's memory: vectors of doubles, with their names."""
    names = F.octet_length("item_id") + F.coalesce(F.octet_length("collection"), F.lit(0))
    return corpus.agg(F.sum(8 * F.size("embedding").cast("bigint") + names + 16)).first()[0] or 0


def _knn_blocks(corpus: DataFrame, queries: DataFrame, k: int, metric: str, blocks: int, chunk_bytes: int) -> DataFrame:
    chunks = max(1, math.ceil(_held_bytes(corpus) / chunk_bytes))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = corpus.withColumn("chunk", spread("item_id", chunks)).withColumn("block", every(blocks))
    right = queries.withColumn("block", spread("query_id", blocks)).withColumn("chunk", every(chunks))

    def search(items: pa.Table, asked: pa.Table) -> pa.Table:
        if not items.num_rows or not asked.num_rows:
            return _HITS_ARROW.empty_table()
        ids = asked.column("query_id").to_pylist()
        nearest = _Nearest(ids, as_matrix(asked.column("embedding").combine_chunks()), k, metric)
        parts = []
        for batch in items.select(["collection", "item_id", "embedding"]).to_batches():
            if nearest.is_full():
                parts.append(nearest.flush())
            nearest.add(batch)
        return pa.Table.from_batches([*parts, nearest.flush()])

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, _HITS)


def as_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {widths.tolist()[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Nearest:
    """Best k rows per query and collection seen so far in one task."""

    def __init__(self, query_ids: list[str], queries: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        norms = (queries * queries).sum(axis=1) if len(query_ids) else np.zeros(0)
        keep = norms > 0 if metric == "unit" else np.ones(len(query_ids), dtype=bool)
        self.query_ids = [q for q, kept in zip(query_ids, keep) if kept]
        self.queries, self.norms = queries[keep], norms[keep]
        self.best: dict[str, list[list[tuple[float, str]]]] = {}
        self.worst: dict[str, np.ndarray] = {}

    def is_full(self) -> bool:
        """Time to hand over what is held; the final ranking merges the parts."""
        return len(self.best) * len(self.query_ids) * self.k > _HELD

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not self.query_ids:
            return
        vectors = as_matrix(batch.column("embedding"))
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"corpus width {vectors.shape[1]}, query width {self.queries.shape[1]}")
        norms = (vectors * vectors).sum(axis=1)
        names = np.array(batch.column("collection").to_pylist(), dtype=object)
        ids = np.array(batch.column("item_id").to_pylist(), dtype=str)
        usable = norms > 0 if self.metric == "unit" else np.ones(len(ids), dtype=bool)
        step = max(1, _CELLS // len(self.query_ids))
        for name in dict.fromkeys(names):
            rows = np.flatnonzero(usable & (names == name))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                self._merge(name, ids[part], vectors[part], norms[part])

    def _merge(self, name: str, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        dots = self.queries @ vectors.T
        if self.metric == "unit":
            distances = 2 - 2 * dots / np.sqrt(self.norms[:, None] * norms[None, :])
            slack = 0.0
        else:
            distances = self.norms[:, None] + norms[None, :] - 2 * dots
            slack = 1e-9 * (1 + float(norms.max()) + float(self.norms.max()))
        if name not in self.best:
            self.best[name] = [[] for _ in self.query_ids]
            self.worst[name] = np.full(len(self.query_ids), np.inf)
        best, worst = self.best[name], self.worst[name]
        # The expanded formula only narrows the candidates (with room for its rounding, and for ties);
        # what is ranked and reported is the sum of squared differences.
        limits = worst + slack
        if len(ids) > self.k:
            limits = np.minimum(limits, np.partition(distances, self.k - 1, axis=1)[:, self.k - 1] + slack)
        near = distances <= limits[:, None]
        for q in np.flatnonzero(near.any(axis=1)):
            columns = np.flatnonzero(near[q])
            if self.metric == "unit":
                exact = distances[q, columns]
            else:
                gaps = vectors[columns] - self.queries[q]
                exact = (gaps * gaps).sum(axis=1)
            first = np.lexsort((ids[columns], exact))[: self.k]
            found = zip(exact[first].tolist(), ids[columns[first]].tolist())
            held = sorted([*best[q], *found])[: self.k]
            best[q] = held
            if len(held) == self.k:
                worst[q] = held[-1][0]

    def flush(self) -> pa.RecordBatch:
        rows = [
            (name, query_id, item_id, distance)
            for name, per_query in self.best.items()
            for query_id, held in zip(self.query_ids, per_query)
            for distance, item_id in held
        ]
        self.best, self.worst = {}, {}
        columns = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, _HITS_ARROW)], schema=_HITS_ARROW
        )

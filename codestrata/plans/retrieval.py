"""Questions in, prompts out."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators.context import retrieval_context, retrieval_prompt
from codestrata.operators.pivots import PivotIndex, search
from codestrata.operators.vectors import embed, knn, resolve_hits
from codestrata.plans.embeddings import embed_stored
from codestrata.session import broadcast_if_small, stage
from codestrata.sources.tables import load_pivot_index, write_pivot_index


class VectorStore(NamedTuple):
    """Where item vectors stay between calls, and the name of the model that computes them."""

    root: str
    model: str


def search_texts(items: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column], width: int, k: int = 5, store: VectorStore | None = None) -> DataFrame:
    """Nearest items of every collection for every query text: collection, query_id, item_id, distance, rank.

    `items` has collection, item_id, text; `queries` has query_id, text. Each query is embedded once. With a `store` the
    items' texts are embedded once and for all, and a later call embeds only texts that are new.
    """
    if store is None:
        vectors = embed(items.select("collection", "item_id", "text"), "text", embedder, width)
    else:
        vectors = embed_stored(store.root, items.select("collection", "item_id", "text"), "text", embedder, store.model, width)
    asked = embed(queries.select("query_id", "text"), "text", embedder, width)
    return knn(vectors.filter("not failed"), asked.filter("not failed"), k, metric="unit")


def retrieve(items: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column], width: int, k: int = 5, store: VectorStore | None = None) -> DataFrame:
    """Every query with its context; `items` also has `name`.

    The few hits are written before they meet the items, so the search runs once and the items are
    filtered where they lie.
    """
    return _answered(search_texts(items, queries, embedder, width, k, store), items, queries)


def prompts(items: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column], width: int, k: int = 5, store: VectorStore | None = None) -> DataFrame:
    """(query_id, prompt) for every query, with the fallback text where nothing was found."""
    return _prompts(retrieve(items, queries, embedder, width, k, store))


def index_items(root: str, items: DataFrame, embedder: Callable[[Column], Column], model: str, width: int, **options) -> PivotIndex:
    """Embed what is new among `items`, and store the vectors of all of them as an index at `root`/index."""
    vectors = embed_stored(f"{root}/texts", items.select("collection", "item_id", "text"), "text", embedder, model, width)
    write_pivot_index(vectors.filter("not failed"), f"{root}/index", width, "unit", **options)
    return open_index(items.sparkSession, root, width)


def open_index(spark: SparkSession, root: str, width: int) -> PivotIndex:
    """The index that `index_items` stored; nothing is embedded."""
    return load_pivot_index(spark, f"{root}/index", f"{root}/absent", width, "unit")


def indexed_prompts(index: PivotIndex, items: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column], width: int, k: int = 5) -> DataFrame:
    """`prompts` from a stored index: the questions are embedded, and the vectors that can be near one are read."""
    asked = embed(queries.select("query_id", "text"), "text", embedder, width)
    return _prompts(_answered(search(index, asked.filter("not failed"), k), items, queries))


def _answered(hits: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    return retrieval_context(queries, resolve_hits(broadcast_if_small(stage(hits, "hits")), items))


def _prompts(answered: DataFrame) -> DataFrame:
    question = F.coalesce("text", F.lit(""))
    return answered.select("query_id", retrieval_prompt(F.col("context"), question).alias("prompt"))

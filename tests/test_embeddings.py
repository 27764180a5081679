"""Stored embeddings: each text is embedded once, and prompts come from what was stored."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.operators import vectors
from codestrata.plans import embeddings, retrieval

ITEMS = "collection string, item_id string, name string, text string"
WIDTH = 32


@pytest.fixture
def counted(spark):
    """An embedder, and how many texts it was called with."""
    calls = spark.sparkContext.accumulator(0)
    plain = vectors.hashing_embedder(WIDTH)

    @F.arrow_udf("string")
    def seen(texts: pa.Array) -> pa.Array:
        calls.add(len(texts))
        return texts

    once = seen.asNondeterministic()
    return (lambda text: plain(once(text))), calls


@pytest.fixture(scope="module")
def items(spark):
    words = "load save parse walk tree file commit branch merge diff".split()
    rows = [(c, f"{c}{i}", f"n{i}", " ".join(words[(i * k) % 10] for k in range(1, 5))) for c in ("code", "commits") for i in range(30)]
    rows += [("code", f"copy{i}", None, "load load load") for i in range(200)] + [("code", "blank", None, " \t"), ("code", "none", None, None), ("code", "odd", None, "!?")]
    return spark.createDataFrame(rows, ITEMS).repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "walk the tree"), ("q2", "load"), ("q3", " "), ("q4", "!")], "query_id string, text string")


def test_each_text_is_embedded_once(spark, tmp_path, items, counted):
    embedder, calls = counted
    root = str(tmp_path / "store")
    want = sorted((r.item_id, tuple(r.embedding), r.failed) for r in vectors.embed(items, "text", vectors.hashing_embedder(WIDTH), WIDTH).collect())

    def got(rows, model="m"):
        return sorted((r.item_id, tuple(r.embedding), r.failed) for r in embeddings.embed_stored(root, rows, "text", embedder, model, WIDTH).collect())

    distinct = items.filter("trim(text) <> '' and text <> ' \t'").select("text").distinct().count()
    assert got(items) == want and calls.value == distinct
    assert got(items) == want and calls.value == distinct
    more = items.unionByName(spark.createDataFrame([("code", "new", None, "something new"), ("code", "same", None, "load load load")], ITEMS))
    assert len(got(more)) == len(want) + 2 and calls.value == distinct + 1
    assert got(items, "other") == want and calls.value == 2 * distinct + 1
    assert got(items.limit(0)) == []


def test_failures_are_not_stored(spark, tmp_path, items):
    root, plain = str(tmp_path / "store"), vectors.hashing_embedder(WIDTH)
    failing = lambda c: F.when(~c.startswith("load"), plain(c))
    first = embeddings.embed_stored(root, items, "text", failing, "m", WIDTH)
    assert first.filter("failed").count() >= 200
    assert first.filter("failed").select(F.array_max("embedding")).distinct().collect()[0][0] == 0.0
    assert embeddings.embed_stored(root, items, "text", plain, "m", WIDTH).filter("failed").count() == 0


def test_a_second_call_embeds_questions_only(spark, tmp_path, items, asked, counted, rows):
    embedder, calls = counted
    want = rows(retrieval.prompts(items, asked, vectors.hashing_embedder(WIDTH), WIDTH))
    store = retrieval.VectorStore(str(tmp_path / "store"), "m")
    assert rows(retrieval.prompts(items, asked, embedder, WIDTH, store=store)) == want
    calls.value = 0
    assert rows(retrieval.prompts(items, asked, embedder, WIDTH, store=store)) == want
    assert calls.value == 3  # the questions that are not blank


def test_prompts_from_a_stored_index(spark, tmp_path, items, asked, counted, rows):
    embedder, calls = counted
    root = str(tmp_path / "retrieval")
    retrieval.index_items(root, items, vectors.hashing_embedder(WIDTH), "m", WIDTH, pivots=8)
    want = rows(retrieval.prompts(items, asked, vectors.hashing_embedder(WIDTH), WIDTH))
    assert rows(retrieval.indexed_prompts(retrieval.open_index(spark, root, WIDTH), items, asked, embedder, WIDTH)) == want
    assert 0 < calls.value <= 9  # three questions, in the passes of the bound and of the search

"""Embeddings that stay: a text is embedded once, whatever items hold it and however often it is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.text import is_blank
from codestrata.operators.vectors import FAILURE_WIDTH, embed
from codestrata.schemas import TEXT_VECTORS
from codestrata.session import broadcast_if_small, stage
from codestrata.sources.runs import RunTables


def vector_store(spark: SparkSession, root: str) -> RunTables:
    """model, text_hash and embedding of every text embedded so far."""
    return RunTables(spark, root, {"vectors": TEXT_VECTORS}, "text_hash")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embed_missing(root: str, texts: DataFrame, text: str, embedder: Callable[[Column], Column], model: str, width: int) -> int:
    """Embed and store the texts that `model` has no vector of yet; returns how many were stored.

    Only hashes are compared with the store. The texts of missing ones alone are shuffled, one a hash, and embedded. A text whose
    embedding fails is not stored, so the next call tries it again.
    """
    spark = texts.sparkSession
    store = vector_store(spark, root)
    given = texts.filter(~is_blank(F.col(text))).select(F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    known = store.read("vectors").filter(F.col("model") == model).select("text_hash")
    missing = stage(given.select("text_hash").distinct().join(known, "text_hash", "left_anti"), "missing")
    if missing.isEmpty():
        return 0
    one = given.join(broadcast_if_small(missing), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    vectors = embed(one, "text", embedder, width).filter("not failed").select(F.lit(model).alias("model"), "text_hash", "embedding")
    vectors = stage(vectors, "vectors")
    store.append(vectors=vectors)
    return vectors.count()


def embed_stored(root: str, items: DataFrame, text: str, embedder: Callable[[Column], Column], model: str, width: int = FAILURE_WIDTH) -> DataFrame:
    """`embed` by way of the store at `root`: items with `embedding` and `failed`, blank texts left out, failures as zero vectors.

    The vectors of all models lie in one store; `model` names what `embedder` computes, options included.
    """
    embed_missing(root, items, text, embedder, model, width)
    held = vector_store(items.sparkSession, root).read("vectors").filter(F.col("model") == model).select("text_hash", "embedding")
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    hashed = items.filter(~is_blank(F.col(text))).withColumn("text_hash", text_hash(F.col(text)))
    joined = hashed.join(held, "text_hash", "left").withColumn("failed", F.col("embedding").isNull())
    return joined.withColumn("embedding", F.coalesce("embedding", zero)).drop("text_hash")

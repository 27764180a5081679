"""A corpus pipeline of the training-data operators: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import mixing, near_dup, packing, pii, quality, token_ids
from codestrata.llm.queries import END_ID
from codestrata.session import work_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dup.one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and disclosing terms replaced in their texts."""
    return pii.sanitise(docs, length="n_chars")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each as often as it was taken."""
    return mixing.mix(docs, weight=mixing.log_size)


def packing_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document by its number of tokens, the end id included."""
    import public_tokenizers

    counts = token_ids.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return packing.packed(counts, "n_tokens")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing_sources),
    ("packing", packing_batches),
]

#: The near-duplicate, sampling and packing stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read back."""
    return run_on(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over `docs`; columns beside those of documents go with the rows until packing."""
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

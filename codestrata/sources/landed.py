"""Landed JSON documents and API pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.functions import records
from codestrata.session import broadcast_if_small, stage


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of files that each hold a JSON array.

    A missing path gives no rows. A file that is not JSON, or a record of which no field can be read, gives none
    either and lands with the file's text in the quarantine (file, value), once a file. Fields of another type
    than the schema's become null or text. Records are read as a stream, so neither a file nor a text is too long;
    of a repeated key the last counts.
    """
    bad = "_corrupt_record"
    try:
        rows = (
            spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())]))
            .option("multiLine", True)
            .option("columnNameOfCorruptRecord", bad)
            .option("maxStringLen", 2**31 - 1)
            .json(path)
        )
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, value string")
    unread = F.col(bad).isNotNull()
    for name in schema.fieldNames():
        unread = unread & F.col(name).isNull()
    files = rows.filter(unread).select(F.col("_metadata.file_path").alias("file"), F.col(bad).alias("value"))
    return rows.filter(~unread).select(*schema.fieldNames()), files.dropDuplicates(["file"])


def flatten(landed: DataFrame, column: str, paths: dict[str, str], types: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) from a JSON text column.

    A record lacking one of the paths is set aside; a JSON null at the end of a path is a value.
    The records come out of an explode: a filter would be pushed down and parse the text again.
    """
    v = F.col("_v")
    parsed = landed.withColumn("_v", F.try_parse_json(F.col(column)))
    complete = F.coalesce(records.all_present(v, paths), F.lit(False))
    kinds = types or {}
    flat = [records.leaf(v, path, kinds.get(name, "string")).alias(name) for name, path in paths.items()]
    found = F.filter(F.array(F.when(complete, F.struct(*flat))), lambda record: record.isNotNull())
    return parsed.select(*keep, F.inline(found)), parsed.filter(~complete).select(*landed.columns)


def repo_metadata(column: str) -> list[Column]:
    """Repository metadata from a JSON text column, with a default for absent keys."""
    v = F.try_parse_json(F.col(column))
    return [
        records.with_default(v, path, kind, default).alias(name)
        for name, (path, kind, default) in records.META_FIELDS.items()
    ]


def read_metadata(landed: DataFrame, column: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(metadata, quarantine) of bodies that should be JSON objects: one that is none has no defaults but is set aside."""
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(column))).startswith("OBJECT"), F.lit(False))
    return landed.filter(readable).select(*keep, *repo_metadata(column)), landed.filter(~readable)


def flatten_commits(documents: DataFrame) -> DataFrame:
    """Commit documents (struct author and committer) as flat rows."""
    return documents.select(
        *(c for c in documents.columns if c not in ("author", "committer")),
        F.col("author.name").alias("author_name"),
        F.col("author.email").alias("author_email"),
        F.to_timestamp("author.date").alias("authored_at"),
        F.col("committer.name").alias("committer_name"),
        F.col("committer.email").alias("committer_email"),
        F.to_timestamp("committer.date").alias("committed_at"),
    )


def flatten_prs(documents: DataFrame) -> DataFrame:
    """Pull-request documents as flat rows; a null body becomes ''."""
    nested = ("user", "head", "base", "body", "created_at", "updated_at", "closed_at", "merged_at")
    return documents.select(
        *(c for c in documents.columns if c not in nested),
        F.coalesce("body", F.lit("")).alias("body"),
        *(F.to_timestamp(c).alias(c) for c in ("created_at", "updated_at", "closed_at", "merged_at")),
        F.col("user.login").alias("user_login"),
        F.col("user.avatar_url").alias("user_avatar_url"),
        *(F.col(f"{side}.{part}").alias(f"{side}_{part}") for side in ("head", "base") for part in ("ref", "sha")),
    )


def stop_pages(counts: DataFrame, page_size: int, source: str, page: str, first_page: int) -> DataFrame:
    """(source, _stop), staged: the first short page of each source, or the first that is absent, from staged (source, page, n).

    A page that was never landed is found as a successor without a row.
    """
    short = counts.filter(F.col("n") < page_size).select(source, page)
    expected = counts.select(source, (F.col(page) + 1).alias(page)).unionByName(
        counts.select(source).distinct().select(source, F.lit(first_page).cast(counts.schema[page].dataType).alias(page))
    )
    absent = expected.join(counts.select(source, page), [source, page], "left_anti")
    stops = short.unionByName(absent).filter(F.col(page) >= first_page).groupBy(source).agg(F.min(page).alias("_stop"))
    return stage(stops, "stop_pages")


def read_pages(pages: DataFrame, page_size: int, source: str = "source", page: str = "page", first_page: int = 1) -> DataFrame:
    """Rows of every source up to and including its first short page, up to its first empty one.

    Page counts reduce the data before anything is compared; the rows then meet one stop page per source.
    """
    counts = stage(pages.groupBy(source, page).agg(F.count("*").alias("n")), "page_counts")
    stops = stop_pages(counts, page_size, source, page, first_page)
    return (
        pages.join(broadcast_if_small(stops), source)
        .filter((F.col(page) <= F.col("_stop")) & (F.col(page) >= first_page))
        .drop("_stop")
    )

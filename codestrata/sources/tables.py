"""Lineage, entity and vector tables on any Hadoop file system."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.operators.pivots import PivotIndex, cells_of, choose_pivots, with_pivots
from codestrata.operators.upsert import new_rows
from codestrata.operators.vectors import build_index
from codestrata.schemas import COMMITS, FILES, INDEXED, SYMBOLS, VECTORS
from codestrata.session import broadcast_if_small, stage
from codestrata.sources.runs import RunTables


def write_partitioned(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Write partitioned by `key`.

    The rebalance hint gives each key value its own tasks and splits those of a hot one, so no task
    writes a third of the table and small values do not scatter into many files. `overwrite`
    replaces only the key values that are written.
    """
    (
        df.hint("rebalance", key)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def lineage_tables(spark: SparkSession, root: str) -> RunTables:
    """The lineage tables under `root`; symbols carry the number of the run that wrote them."""
    numbered = T.StructType([*SYMBOLS.fields, T.StructField("number", T.LongType())])
    return RunTables(spark, root, {"commits": COMMITS, "files": FILES, "symbols": numbered, "indexed": INDEXED}, "repo")


def last_indexed(indexed: DataFrame) -> DataFrame:
    """The last run that wrote the symbols of each commit."""
    return indexed.groupBy("repo", "commit_sha").agg(F.max_by(F.struct("number", "tree"), "number").alias("last")).select("repo", "commit_sha", "last.*")


def write_lineage(root: str, **tables: DataFrame) -> None:
    """Add to the lineage tables as one run: commits and paths that are there keep their rows.

    Symbols of a commit take the place of those it had; other commits, earlier ones of the repository among them, keep theirs.
    """
    spark = next(iter(tables.values())).sparkSession
    store = lineage_tables(spark, root)
    rows = {}
    if "commits" in tables:
        given = tables["commits"].select(*COMMITS.fieldNames())
        rows["commits"] = new_rows(store.read("commits"), given, ["repo", "commit_sha"], ["committed_at", "author_name", "author_email", "message"])
    if "files" in tables:
        given = tables["files"].select(*FILES.fieldNames())
        rows["files"] = new_rows(store.read("files"), given, ["repo", "current_path"], ["file_id"])
    if "symbols" in tables:
        number = F.lit(store.manifest().next_number()).cast("long").alias("number")
        rows["symbols"] = stage(tables["symbols"].select(*SYMBOLS.fieldNames(), number), "symbols")
        rows["indexed"] = rows["symbols"].select("repo", "commit_sha", "number", F.lit(None).cast("string").alias("tree")).distinct()
    store.append(**rows)


def read_lineage(spark: SparkSession, root: str, name: str) -> DataFrame:
    store = lineage_tables(spark, root)
    rows = store.read(name)
    if name == "symbols":
        last = broadcast_if_small(last_indexed(store.read("indexed")).select("repo", "commit_sha", "number"))
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("repo", "commit_sha", "number")]
        rows = rows.alias("s").join(last.alias("l"), same[0] & same[1] & same[2], "left_semi").select(*SYMBOLS.fieldNames())
    return rows


def write_entities(entities: DataFrame, path: str, file_rows: int = 500_000) -> None:
    """JSON lines, compressed: every span repeats the names of its columns and the code of the spans inside it.

    A compressed file is read by one task, so a file holds `file_rows` rows at most.
    """
    entities.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", file_rows).json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    write_partitioned(vectors.select(*VECTORS.fieldNames()), path, "collection")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table; missing vectors are an error, as for any index built from them."""
    return spark.read.schema(VECTORS).parquet(path).select(*VECTORS.fieldNames())


def load_index(spark: SparkSession, index_path: str, vectors_path: str, dim: int) -> DataFrame:
    """The index table, built from the vectors first when it does not exist."""
    schema = T.StructType([*VECTORS.fields, T.StructField("squared_norm", T.DoubleType())])
    try:
        return spark.read.schema(schema).parquet(index_path).select(*schema.fieldNames())
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    write_partitioned(build_index(read_vectors(spark, vectors_path), dim), index_path, "collection")
    return spark.read.schema(schema).parquet(index_path).select(*schema.fieldNames())


_PLACED = T.StructType([*VECTORS.fields, T.StructField("pivot", T.IntegerType()), T.StructField("pivot_distance", T.DoubleType())])
_CELLS = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("pivot", T.IntegerType()), T.StructField("rows", T.LongType()),
    T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
])
_PIVOTS = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("metric", T.StringType())])


def write_pivot_index(vectors: DataFrame, path: str, dim: int, metric: str = "l2", pivots: int = 256, file_rows: int = 50_000) -> None:
    """Store `vectors` sorted by nearest pivot and the distance to it, so that a search skips files and row groups.

    Rows of a hot pivot go on over as many files as they fill. The cells are written last: an index without them is built anew.
    """
    spark = vectors.sparkSession
    chosen = choose_pivots(vectors, dim, metric, pivots)
    table = spark.createDataFrame([(i, [float(x) for x in v], metric) for i, v in enumerate(chosen)], _PIVOTS)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    order = ["pivot", "pivot_distance", "item_id"]
    rows = with_pivots(vectors, chosen, metric) if len(chosen) else spark.createDataFrame([], _PLACED)
    (rows.repartitionByRange("collection", *order).sortWithinPartitions("collection", *order)
     .write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", file_rows).partitionBy("collection").parquet(f"{path}/rows"))
    cells_of(spark.read.schema(_PLACED).parquet(f"{path}/rows")).write.mode("overwrite").parquet(f"{path}/cells")


def load_pivot_index(spark: SparkSession, path: str, vectors_path: str, dim: int, metric: str = "l2", **options) -> PivotIndex:
    """The pivot index at `path`, built from the vectors first when it is not there."""
    try:
        cells = spark.read.schema(_CELLS).parquet(f"{path}/cells")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        write_pivot_index(read_vectors(spark, vectors_path), path, dim, metric, **options)
        cells = spark.read.schema(_CELLS).parquet(f"{path}/cells")
    stored = spark.read.schema(_PIVOTS).parquet(f"{path}/pivots").orderBy("pivot").collect()
    if any(row["metric"] != metric for row in stored):
        raise ValueError(f"the index at {path} is not for {metric}")
    pivots = np.array([row["vector"] for row in stored], np.float64) if stored else np.zeros((0, dim))
    return PivotIndex(spark.read.schema(_PLACED).parquet(f"{path}/rows"), cells, pivots, metric)

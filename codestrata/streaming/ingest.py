"""First-write-wins ingest of landed files as a stream."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators.upsert import first_write, new_rows
from codestrata.session import stage
from codestrata.sources.runs import Manifest, read_or_empty

_RUN, _BITS, _BUCKET = "ingest_run", "ingest_bits", "ingest_bucket"
#: The driver names at most so many (2 to this power) key buckets when it says which ones a batch can touch.
_NAMED_BITS = 10


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Landed parquet files as a stream, oldest first."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to, kept with it: a fresh checkpoint is a new run."""
    schema = T.StructType([T.StructField("run", T.StringType())])
    known = read_or_empty(spark, f"{checkpoint}/run", schema).first()
    if known is not None:
        return known.run
    run = uuid.uuid4().hex
    spark.range(1, numPartitions=1).select(F.lit(run).alias("run")).write.parquet(f"{checkpoint}/run")
    return run


def _low_bits(number: Column, bits: int) -> Column:
    return number.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _read(spark: SparkSession, target: str, schema: T.StructType, entries: list[Row]) -> DataFrame:
    """The rows of the listed folders, with the bits of their folder and the bucket they lie in."""
    stored = T.StructType([*schema.fields, T.StructField(_RUN, T.StringType()), T.StructField(_BITS, T.IntegerType()), T.StructField(_BUCKET, T.IntegerType())])
    if not entries:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).option("basePath", f"{target}/data").parquet(*(f"{target}/data/{_RUN}={e['run']}" for e in entries))


def _write(rows: DataFrame, target: str, keys: list[str], count: int, bucket_rows: int) -> tuple[str, int]:
    """A new folder of `rows`, at most `count` of them, in as many key buckets as that takes: its name and bits.

    A folder has 2^bits buckets of about `bucket_rows` rows, so with twice the rows each splits in two, and so many tasks write.
    """
    bits = max(0, math.ceil(math.log2(max(1, count) / bucket_rows)))
    run = uuid.uuid4().hex
    bucketed = rows.withColumn(_BITS, F.lit(bits)).withColumn(_BUCKET, _low_bits(F.xxhash64(*keys), bits))
    bucketed.repartition(1 << bits, _BUCKET).write.option("partitionOverwriteMode", "static").partitionBy(_BITS, _BUCKET).parquet(f"{target}/data/{_RUN}={run}")
    return run, bits


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], arrival: list[str], bucket_rows: int = 1_000_000) -> StreamingQuery:
    """Insert every row whose key is new into the parquet table at `target`, then stop.

    Each micro-batch is staged once, compared with the table, and written to a folder of its own that is listed in a manifest
    afterwards. A batch that runs again after a failure takes the place of its own folder, and as all others are
    compared with it, neither a lost checkpoint nor another source's stream into the same table doubles or removes a key.
    Folders are bucketed by key, the finer the more rows they hold, and a batch reads only buckets it can have keys in.
    `compact` merges folders between runs. One stream, or one compaction, at a time may write to a table.
    """
    spark = stream.sparkSession
    run, schema = _run_of(spark, checkpoint), stream.schema
    manifest = Manifest(spark, f"{target}/batches")

    def insert(batch: DataFrame, batch_id: int) -> None:
        label = f"{run}-{batch_id}"
        rows = stage(batch, "micro-batch")
        named = F.collect_set(_low_bits(F.xxhash64(*keys), _NAMED_BITS))
        count, touched = rows.agg(F.count(F.lit(1)), named).first()
        others = [e for e in manifest.current() if e["label"] != label]
        if others:
            can = None
            for bits in sorted({e["bits"] for e in others}):
                shown = min(bits, _NAMED_BITS)
                here = (F.col(_BITS) == bits) & _low_bits(F.col(_BUCKET), shown).isin(sorted({t & ((1 << shown) - 1) for t in touched}))
                can = here if can is None else can | here
            table = _read(rows.sparkSession, target, schema, others).filter(can).select(*schema.fieldNames())
            fresh = new_rows(table, rows, keys, arrival, small_batch=True)
        else:
            fresh = first_write(rows, keys, arrival)
        folder, bits = _write(fresh, target, keys, count, bucket_rows)
        manifest.add(folder, label=label, rows=count, bits=bits)

    return (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, target: str, schema: T.StructType, keys: list[str], below_rows: int | None = None, bucket_rows: int = 1_000_000) -> str | None:
    """Merge the table's folders of fewer than `below_rows` rows, or all, into one with as many buckets as its rows need.

    The new folder counts, and the merged ones no longer do, from the moment it is listed; so a compaction that dies changes nothing
    and is started again. Replaced folders stay for readers that are on them and can be removed later.
    """
    manifest = Manifest(spark, f"{target}/batches")
    old = [e for e in manifest.current() if below_rows is None or e["rows"] < below_rows]
    if len(old) < 2:
        return None
    rows = _read(spark, target, schema, old).select(*schema.fieldNames())
    count = rows.count()
    folder, bits = _write(rows, target, keys, count, bucket_rows)
    manifest.add(folder, [e["run"] for e in old], rows=count, bits=bits)
    return folder


def ingest_append_only(stream: DataFrame, target: str, checkpoint: str, keys: list[str], event_time: str, delay: str) -> StreamingQuery:
    """The variant for keys that can only repeat within `delay`: state instead of a look at the table."""
    return (
        stream.withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(keys)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _read(spark, target, schema, Manifest(spark, f"{target}/batches").current()).select(*schema.fieldNames())

"""Tables that grow by runs: the rows of a run count once the run is listed."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.session import shuffles_dropped

_LISTED = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("number", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("replaces", T.ArrayType(T.StringType())), T.StructField("rows", T.LongType()), T.StructField("bits", T.IntegerType()),
])


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parquet table, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty when planned, so reading it runs no job.
        return spark.range(0).select(*(F.lit(None).cast(field.dataType).alias(field.name) for field in schema))


class Manifest:
    """The list of a table's runs, one small file each, written by one writer at a time.

    A run is a folder that was written before it is listed, so a job that dies before that leaves nothing that is read. A
    listed run may replace others by name, as a compaction does, or the earlier run of its `label`, as a
    micro-batch that runs again. The list holds a row a run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.listed: list[Row] = read_or_empty(spark, path, _LISTED).collect()

    def current(self) -> list[Row]:
        """The runs that count, oldest first."""
        gone = {name for row in self.listed for name in row["replaces"] or ()}
        last = {row["label"]: row["run"] for row in sorted(self.listed, key=lambda r: r["number"]) if row["label"]}
        return sorted((r for r in self.listed if r["run"] not in gone and last.get(r["label"], r["run"]) == r["run"]), key=lambda r: r["number"])

    def next_number(self) -> int:
        return max((row["number"] for row in self.listed), default=0) + 1

    def add(self, run: str, replaces: list[str] = (), label: str | None = None, rows: int | None = None, bits: int | None = None) -> None:
        row = Row(*_LISTED.fieldNames())(run, self.next_number(), label, list(replaces), rows, bits)
        # A literal row needs no Python worker, which would cost more than the batch it lists.
        listed = F.from_json(F.lit(json.dumps(row.asDict())), _LISTED)
        self.spark.range(1, numPartitions=1).select(listed.alias("row")).select("row.*").write.mode("append").parquet(self.path)
        self.listed.append(row)


class RunTables:
    """Tables of fixed schemas under `root`; a run writes a folder of its own in each and is then listed."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], key: str):
        self.spark, self.root, self.schemas, self.key = spark, root.rstrip("/"), schemas, key

    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/runs")

    def runs(self) -> list[str]:
        """The runs that count, oldest first."""
        return [row["run"] for row in self.manifest().current()]

    def read(self, name: str) -> DataFrame:
        schema = self.schemas[name]
        folders = [f"{self.root}/{name}/{run}" for run in self.runs()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read_run(self, name: str, run: str) -> DataFrame:
        """The rows that one run wrote."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/{run}")

    def append(self, replaces: list[str] = (), together: tuple[str, ...] = (), **rows: DataFrame) -> str:
        """Add the rows of one run; tables that are not given get none. In `together` the rows of a key lie so already."""
        manifest, run = self.manifest(), uuid.uuid4().hex
        for name, schema in self.schemas.items():
            given = rows.get(name)
            out = self.spark.createDataFrame([], schema) if given is None else given.select(*schema.fieldNames())
            if given is not None:
                # A key's rows lie together, so a reader of one key skips the other row groups, and a hot key is split over tasks.
                out = (out if name in together else out.hint("rebalance", self.key)).sortWithinPartitions(self.key)
            with shuffles_dropped(self.spark):
                out.write.option("compression", "zstd").parquet(f"{self.root}/{name}/{run}")
        manifest.add(run, replaces)
        return run

    def compact(self, **resolve) -> str | None:
        """Rewrite all runs as one, so that the number of files follows the rows and not the runs.

        `resolve` maps a table's name to a function of its rows that drops what no longer counts. Old folders stay for readers
        that are on them; they are no part of the tables once the new run is listed. A compaction that dies leaves all as it was.
        """
        old = self.runs()
        if len(old) < 2:
            return None
        return self.append(old, **{name: resolve.get(name, lambda rows: rows)(self.read(name)) for name in self.schemas})

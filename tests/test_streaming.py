from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codestrata.sources.runs import Manifest
from codestrata.streaming import ingest
from workload.queries import QUERIES


def land(spark, folder, start, stop):
    spark.range(start, stop).select(
        (F.col("id") % 30).alias("key"), F.col("id").alias("at"), F.timestamp_seconds("id").alias("ts")
    ).coalesce(1).write.mode("append").parquet(folder)


def test_first_arrival_wins_across_runs(spark, tmp_path, rows):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    land(spark, source, 0, 20)
    schema = spark.read.parquet(source).schema

    def run():
        stream = ingest.stream_files(spark, source, schema, files_per_batch=1)
        ingest.ingest(stream, target, checkpoint, ["key"], ["at"]).awaitTermination()
        return ingest.read_ingested(spark, target, schema)

    assert [r[:2] for r in sorted(map(tuple, run().collect()))] == [(k, k) for k in range(20)]
    land(spark, source, 20, 100)
    land(spark, source, 100, 130)
    assert [r[:2] for r in sorted(map(tuple, run().collect()))] == [(k, k) for k in range(30)]
    assert run().count() == 30


def test_a_batch_run_again_does_not_double(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, source, 0, 40)
    schema = spark.read.parquet(source).schema
    for attempt in ("one", "two"):
        # A lost checkpoint: batch 0 is processed again over its own earlier output.
        stream = ingest.stream_files(spark, source, schema)
        ingest.ingest(stream, target, str(tmp_path / attempt), ["key"], ["at"]).awaitTermination()
        assert ingest.read_ingested(spark, target, schema).count() == 30


def test_append_only_variant(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, source, 0, 90)
    stream = ingest.stream_files(spark, source, spark.read.parquet(source).schema)
    ingest.ingest_append_only(stream, target, str(tmp_path / "state"), ["key"], "ts", "1 hour").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(target).collect()) == list(range(30))


def test_a_lost_checkpoint_over_several_batches(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, source, 0, 20)
    land(spark, source, 20, 40)
    schema = spark.read.parquet(source).schema
    for state, files in (("one", 1), ("two", 10), ("three", 1)):
        stream = ingest.stream_files(spark, source, schema, files_per_batch=files)
        ingest.ingest(stream, target, str(tmp_path / state), ["key"], ["at"]).awaitTermination()
        stored = [r.key for r in ingest.read_ingested(spark, target, schema).collect()]
        assert sorted(stored) == list(range(30))


def test_two_sources_into_one_table(spark, tmp_path):
    target = str(tmp_path / "out")
    for name, start in (("a", 0), ("b", 10), ("a", 0)):
        source = str(tmp_path / name)
        land(spark, source, start, start + 15)
        stream = ingest.stream_files(spark, source, spark.read.parquet(source).schema)
        ingest.ingest(stream, target, str(tmp_path / f"state-{name}"), ["key"], ["at"]).awaitTermination()
    stored = ingest.read_ingested(spark, target, spark.read.parquet(str(tmp_path / "a")).schema)
    assert sorted((r.key, r.at) for r in stored.collect()) == [(k, k) for k in range(25)]


def test_a_lost_compaction_changes_nothing_and_a_whole_one_keeps_a_row_a_key(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for start in range(0, 60, 20):
        land(spark, source, start, start + 20)
    schema = spark.read.parquet(source).schema

    def run(state):
        ingest.ingest(ingest.stream_files(spark, source, schema, files_per_batch=1), target, str(tmp_path / state), ["key"], ["at"], bucket_rows=4).awaitTermination()

    def stored():
        return sorted((r.key, r.at) for r in ingest.read_ingested(spark, target, schema).collect())

    run("one")
    want = [(k, k) for k in range(30)]
    assert stored() == want

    class Killed(Exception):
        pass

    add = Manifest.add
    monkeypatch.setattr(Manifest, "add", lambda *args, **kwargs: (_ for _ in ()).throw(Killed))
    with pytest.raises(Killed):
        ingest.compact(spark, target, schema, ["key"], bucket_rows=4)
    monkeypatch.setattr(Manifest, "add", add)
    assert stored() == want and len(Manifest(spark, f"{target}/batches").current()) == 3
    assert ingest.compact(spark, target, schema, ["key"], bucket_rows=4) is not None
    assert stored() == want
    (entry,) = Manifest(spark, f"{target}/batches").current()
    assert entry.rows == 30 and entry.bits == 3 and ingest.compact(spark, target, schema, ["key"]) is None
    # Batches of a lost checkpoint meet the merged folder.
    run("two")
    assert stored() == want


def test_buckets_and_write_tasks_grow_with_the_rows(spark, tmp_path):
    source, schema = str(tmp_path / "in"), None
    for name, rows in (("few", 100), ("more", 1600)):
        spark.range(rows).select(F.col("id").alias("key"), F.col("id").alias("at")).coalesce(1).write.parquet(f"{source}/{name}")
        schema = spark.read.parquet(f"{source}/{name}").schema
        target = str(tmp_path / f"out-{name}")
        ingest.ingest(ingest.stream_files(spark, f"{source}/{name}", schema), target, str(tmp_path / f"state-{name}"), ["key"], ["at"], bucket_rows=100).awaitTermination()
        assert len(list((tmp_path / f"out-{name}").glob("data/*/*/*/*.parquet"))) == rows // 100
        assert ingest.read_ingested(spark, target, schema).count() == rows


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("at")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        ingest.ingest(ingest.stream_files(spark, source, schema), target, str(tmp_path / "state"), ["key"], ["at"], bucket_rows=10).awaitTermination()

    run()
    entries = Manifest(spark, f"{target}/batches").current()
    bits = entries[0].bits
    bucket = spark.range(7, 8).select(ingest._low_bits(F.xxhash64("id"), bits)).first()[0]
    read = ingest._read(spark, target, schema, entries).filter(F.col("ingest_bucket") == bucket)
    assert 0 < read.count() < 100 and "PartitionFilters: [isnotnull(ingest_bucket" in read._jdf.queryExecution().executedPlan().toString()
    spark.range(7, 8).select(F.col("id").alias("key"), F.lit(-1).cast("long").alias("at")).coalesce(1).write.mode("append").parquet(source)
    run()
    assert ingest.read_ingested(spark, target, schema).count() == 1000


def test_the_query_streams_events_without_a_time_in_distributed_writes(spark, tmp_path):
    user, event = F.col("id") % 50, F.col("id")
    no_time = (user >= 40) | (F.col("id") % 7 == 0)
    events = spark.range(0, 800, 1, 4).select(
        event.alias("event_id"), F.when(~no_time, F.timestamp_seconds(10_000 - event)).alias("ts"),
        user.alias("user_id"), F.lit("view").alias("event_type"), event.cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    landed = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("codestrata/stream-*/in/*.parquet"))
    before = landed()
    got = {r.user_id: r.event_id for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()}
    rows = sorted(events.collect(), key=lambda r: (r.ts is None, r.ts.timestamp() if r.ts else 0, r.event_id), reverse=True)
    assert got == {r.user_id: r.event_id for r in rows} and len(got) == 50
    assert len(landed() - before) > 5

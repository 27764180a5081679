"""What the physical plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from codestrata.operators import lookups, ranking
from codestrata.session import broadcast_if_small, stage, work_dir
from workload.queries import QUERIES
from workload.views import view

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairing_of_everything(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["top_function_files"](spark, SF))
    lineitem = next(line for line in plan.split("\n") if "lineitem.parquet" in line)
    assert "l_returnflag" in lineitem and "l_extendedprice" not in lineitem and "l_shipdate" not in lineitem
    assert re.search(r"DataFilters: \[[^\]]*l_returnflag", lineitem)


def test_caps_are_applied_before_both_shuffles(spark):
    plan = plan_of(ranking.recent_commits(view(spark, SF, "v_commits")))
    assert plan.count("Partial") >= 2 and plan.count("WindowGroupLimit") == 4


def test_statistics_count_before_the_join(spark):
    plan = plan_of(lookups.file_statistics(view(spark, SF, "v_symbols"), view(spark, SF, "v_files")))
    assert re.search(r"Join.*HashAggregate", plan, re.S)


def test_top_files_need_no_full_sort(spark):
    plan = plan_of(QUERIES["top_function_files"](spark, SF))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_a_hot_key_is_split_in_the_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        symbols = spark.range(60000).repartition(8).select(
            F.lit("r").alias("repo"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("file_id"),
            F.md5(F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("start_line"),
        )
        files = spark.range(997).select(F.lit("r").alias("repo"), F.col("id").alias("file_id"), F.concat(F.lit("p"), "id").alias("current_path"))
        joined = lookups.symbols_with_paths(symbols, files)
        assert joined.agg(F.count("*"), F.max("name")).collect()[0][0] == 60000
        rows = joined.select("current_path", "name")
        assert len(rows.collect()) == 60000
        assert "isSkew=true" in plan_of(rows) or "skew=true" in plan_of(rows)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_broadcast_is_size_checked(spark):
    small, large = spark.range(5), spark.range(50)
    other = spark.range(100)
    assert "BroadcastHashJoin" in plan_of(other.join(broadcast_if_small(small, 10), "id"))
    assert broadcast_if_small(large, 10) is large


def test_staged_results_live_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(folder)
    staged = stage(spark.range(10), "numbers")
    assert all(folder in f for f in staged.inputFiles()) and staged.count() == 10

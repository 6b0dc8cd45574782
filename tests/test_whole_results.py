"""No built-in ceilings, no lost text, no task that gets all NULL keys."""

from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.functions import json as J
from logspark.operators.alerts import plain_number, rule_history
from logspark.operators.retention import enforce_hot_cap, hot_cap_steps
from logspark.operators.search import attribute_paths, query_all
from logspark.plans.skew import salted_join


@pytest.fixture
def many(spark):
    return spark.range(12_345).select(F.col("id").alias("event_key"), (F.lit(T0).cast("timestamp")).alias("ts"), F.lit(1).alias("x"))


def test_pages_hold_what_the_caller_asks_for(many):
    assert query_all(many, "x = 1", T0, T0).count() == 12_345
    assert query_all(many, "x = 1", T0, T0, 1_500).count() == 1_500


def test_rule_history_is_whole_without_a_number(spark):
    rows = spark.range(300).selectExpr("'r' AS rule_id", "timestamp_seconds(id) AS ts", "'warn' AS severity")
    assert rule_history(rows).count() == 300 and rule_history(rows, 250).count() == 250


def test_hot_cap_takes_all_the_steps_it_needs(spark):
    logs = spark.range(200).select((F.lit(T0).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.lit(100).cast("long").alias("raw_len"))
    assert hot_cap_steps(logs, 1_000).count() == 190
    assert enforce_hot_cap(logs, 1_000).first()["cutoff"] == T0 + timedelta(hours=190)
    assert hot_cap_steps(logs, 1_000, max_steps=48).count() == 48


def test_attributes_unfold_at_any_depth(spark):
    deep = '{"a":' * 9 + "1" + "}" * 9
    got = attribute_paths(spark.createDataFrame([(1, deep)], "event_key long, attributes string"), "event_key").collect()
    assert [(r["path"], r["value"]) for r in got] == [(".".join("a" * 9), "1")]


@pytest.mark.parametrize("text,good", [('{"a":1}', True), ('{"a":1},1] lost text', False), ('{"a":[2,1]}', True), ('{"a":"x,1] y"}', True), ('{"a":1} tail', False), ('{"a":1},1]', False), ('{"a":1},1],[2', False)])
def test_parser_accepts_whole_texts_only(spark, text, good):
    df = spark.createDataFrame([(text,)], "raw string").select(J.parse_fields(F.col("raw")).alias("m"))
    assert df.select(F.col("m").isNotNull()).first()[0] is good


def test_numbers_in_messages():
    assert [plain_number(x) for x in (1234567.5, 5.0, 0.25, 1e21, 1e-7)] == ["1234567.5", "5", "0.25", "1" + "0" * 21, "0.0000001"]


def test_null_keys_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(6_400).select("id", F.when(F.col("id") < 0, F.lit("k")).alias("k"))
        small = spark.createDataFrame([("k", 1)], "k string, v int")
        out = salted_join(big, small, ["k"], F.col("id"), "left", hot_rows=50)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 6_400 and max(sizes) <= 2 * 6_400 / 32
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")

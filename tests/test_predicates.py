from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.plans import ranges as R
from logspark.plans.predicates import PredicateError, check_service_window, compile_predicate

ROWS = [
    (1, "api", "error", "User 42 failed 100% of_it", 10, None, True),
    (2, "web", "info", "all good", 200, "T1", False),
    (3, "my_app", "warn", "Slow\\path", 50, "t1", None),
    (4, None, "info", "other", None, None, None),
]
DDL = "id int, service string, level string, message string, raw_len int, trace_id string, is_canary boolean"


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, DDL)


def ids(logs, spec, **kw):
    return sorted(r["id"] for r in logs.filter(compile_predicate(spec, logs.schema, ["is_canary"], **kw)).collect())


@pytest.mark.parametrize(
    "spec, expected",
    [
        (None, [1, 2, 3, 4]),
        (["service", "=", "api"], [1]),
        (["service", "!=", "api"], [2, 3]),
        (["raw_len", ">", 50], [2]),
        (["raw_len", ">=", "50"], [2, 3]),
        (["raw_len", "<", 50], [1]),
        (["raw_len", "<=", 50], [1, 3]),
        (["message", "~", "GOOD"], [2]),
        (["text", "user"], [1]),
        (["message", "=", "user % failed"], [1]),
        (["message", "=", "100%"], [1]),
        (["service", "=", "my_app"], [3]),
        (["message", "~", "slow\\path"], [3]),
        (["trace_id", "=", "T1"], [2]),
        (["is_canary", "=", "true"], [1]),
        (["and", ["level", "=", "info"], ["raw_len", ">", 1]], [2]),
        (["or", ["level", "=", "warn"], ["level", "=", "error"]], [1, 3]),
        (["not", ["service", "=", "api"]], [2, 3]),
        (["not", ["message", "~", "l"]], [4]),
        (["not", ["not", ["service", "=", "api"]]], [1]),
        (["not", ["or", ["level", "=", "info"], ["raw_len", ">", 20]]], [1]),
    ],
)
def test_specs(logs, spec, expected):
    assert ids(logs, spec) == expected


def test_exact_mode(logs):
    assert ids(logs, ["service", "=", "m_app"]) == []
    assert ids(logs, ["service", "=", "my%"]) == [3]
    assert ids(logs, ["service", "=", "my%"], exact=True) == []
    assert ids(logs, ["service", "=", "my_app"], exact=True) == [3]


@pytest.mark.parametrize(
    "spec",
    [
        ["nope", "=", "x"],
        ["id", "=", 1],
        ["service", ">", "a"],
        ["raw_len", "~", "1"],
        ["raw_len", "=", "abc"],
        ["raw_len", "=", 1.5],
        ["service", "like", "x"],
        ["and"],
        ["not", ["service", "=", "a"], ["service", "=", "b"]],
        ["is_canary", "=", "maybe"],
        ["service", "="],
    ],
)
def test_bad_specs(logs, spec):
    with pytest.raises(PredicateError):
        compile_predicate(spec, logs.schema, ["is_canary"])


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, DDL).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    spec = ["and", ["service", "=", "api"], ["raw_len", ">", 5]]
    plan = t.filter(compile_predicate(spec, t.schema))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service,api)" in plan and "GreaterThan(raw_len,5)" in plan


def test_service_window():
    limits = [("api*", 3600)]
    check_service_window(["service", "=", "web"], 10**6, limits)
    check_service_window(["not", ["service", "=", "api1"]], 10**6, limits)
    check_service_window(["service", "=", "api1"], 3600, limits)
    with pytest.raises(PredicateError):
        check_service_window(["and", ["level", "=", "x"], ["service", "=", "api1"]], 3601, limits)


NOW = datetime(2024, 1, 15, 10)


def test_ranges():
    assert R.window_seconds("90s") == 90 and R.window_seconds("2w") == 1209600 and R.window_seconds("15 min") == 900
    with pytest.raises(ValueError):
        R.window_seconds("5 parsecs")
    assert R.log_range(NOW) == (NOW - timedelta(hours=1), NOW)
    assert R.log_range(NOW, "30m", NOW - timedelta(days=9)) == (NOW - timedelta(minutes=30), NOW)
    assert R.web_range(NOW) == (NOW - timedelta(days=1), NOW)
    with pytest.raises(ValueError):
        R.web_range(NOW, "91d")
    with pytest.raises(ValueError):
        R.web_range(NOW, start=NOW)
    assert R.log_width(NOW, NOW + timedelta(hours=6)) == "1m"
    assert R.log_width(NOW, NOW + timedelta(hours=7)) == "1h"
    assert R.log_width(NOW, NOW + timedelta(hours=7), "minute") == "1m"
    assert [R.web_width(NOW, NOW + timedelta(hours=h)) for h in (2, 3, 48, 49)] == ["1m", "1h", "1h", "1d"]
    assert R.web_width(NOW, NOW, "5m") == "5m"
    assert R.horizon_points("6h") == 360 and R.horizon_points("2d", "hour") == 48 and R.horizon_points("30m", "hour") == 1


def test_closed_and_half_open(spark):
    t = spark.createDataFrame([(NOW,), (NOW + timedelta(hours=1),)], "ts timestamp")
    end = NOW + timedelta(hours=1)
    assert t.filter(R.in_log_range(F.col("ts"), NOW, end)).count() == 2
    assert t.filter(R.in_web_range(F.col("ts"), NOW, end)).count() == 1

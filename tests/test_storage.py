import os
from datetime import date, timedelta

from conftest import T0
from pyspark.sql import functions as F

from logspark import schemas
from logspark.operators import retention as K, search as E, traces as G
from logspark.plans.skew import salted_join
from logspark.sources import tiers as T


def log_rows(spark, *rows):
    data = [(i, T0 + timedelta(hours=r.get("h", 0)), r.get("service", "api"), r.get("level", "info"), r.get("msg", "m"), r.get("attrs", "{}"), r.get("bytes", 10), r.get("trace"), r.get("protocol", "http_json")) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "event_key long, ts timestamp, service string, level string, message string, attributes string, raw_len int, trace_id string, protocol string")
    return schemas.conform(df, schemas.LOGS, ("event_key",))


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "cold")
    logs = log_rows(spark, {"h": -30}, {"h": -30, "service": "a/b c"}, {"h": -30, "service": None}, {"h": 0})
    T.archive_logs(logs, path, T0 - timedelta(hours=24), ("trace_id",))
    names = sorted({d for root, dirs, _ in os.walk(path) for d in dirs if d.startswith("service_part=")})
    assert len(names) == 3 and names[-1] == "service_part=unknown--00000000" and any(n.startswith("service_part=a_b_c--") for n in names)
    cold = T.read_archive(spark, path)
    both = T.union_tiers(K.split_hot(logs, T0 - timedelta(hours=24))[1], cold)
    assert both.count() == 4 and both.filter("service is null").count() == 1
    plan = cold.filter(F.col("date") == "2024-01-14")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    foot = T.cold_footprint(cold).collect()
    assert [(str(r["date"]), r["rows"]) for r in foot] == [("2024-01-14", 3)] and foot[0]["bytes"] > 0
    assert T.read_archive(spark, str(tmp_path / "none")) is None
    T.archive_logs(logs, path, T0 - timedelta(hours=24))
    assert T.read_archive(spark, path).count() == 6


def test_compact(spark, tmp_path):
    logs = log_rows(spark, {"h": -30}, {"h": 0})
    K.compact(logs, str(tmp_path / "cold"), str(tmp_path / "hot"), T0 - timedelta(hours=1))
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 1


def test_hot_cap(spark):
    logs = log_rows(spark, *[{"h": h, "bytes": 100} for h in range(10)])
    r = K.enforce_hot_cap(logs, 250).first()
    assert (r["cutoff"], r["moved_rows"], r["moved_bytes"]) == (T0 + timedelta(hours=8), 8, 800)
    assert K.enforce_hot_cap(logs, 10_000).first()["moved_rows"] == 0
    assert K.enforce_hot_cap(logs, 0, max_steps=3).first()["moved_rows"] == 3


def test_retention_rules(spark):
    parts = spark.createDataFrame([("2024-01-01", 0, s) for s in ("api-1", "web", "api_x")], "date string, hour int, service_part string")
    out = K.expired_partitions(parts, [("api-*", 30), ("a?i*", 5), ("api x", 1)], 90, date(2024, 1, 20))
    assert {r["service_part"] for r in out.collect()} == {"api_x"}
    web = spark.createDataFrame([("2024-01-14", "s"), ("2024-01-15", "s")], "date string, site string")
    assert [r["date"] for r in K.expired_web(web, 5, date(2024, 1, 20)).collect()] == ["2024-01-14"]


def test_safe_names(spark):
    import re
    import zlib

    names = ["api", "", "....", "a b", "x" * 120, "é", "ok_", "trail.", "a/b", "UPPER-1.2"]

    def plain(n):
        m = re.sub(r"[^A-Za-z0-9_.-]", "_", n)
        t = m[:96].rstrip("._ ") or "unknown"
        return t if t == n and len(m) <= 96 else f"{t}--{zlib.crc32(n.encode()):08x}"

    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", K.safe_partition_name(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {n: plain(n) for n in names}


def test_commits_hide_unfinished_batches(spark, tmp_path):
    root = str(tmp_path / "store")
    logs = log_rows(spark, {}, {})
    T.commit_batch(logs, None, root, 0)
    T.append_once(logs, f"{root}/logs", 1)
    assert T.read_committed(spark, root, "logs").count() == 2
    T.commit_batch(logs, logs, root, 1)
    T.commit_batch(logs, logs, root, 1)
    assert T.read_committed(spark, root, "logs").count() == 4 and T.read_committed(spark, root, "web_events").count() == 2


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = spark.createDataFrame([(T0, 'a,"b"', None)], "ts timestamp, name string, path string")
    full = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in T.EXPORT_EVENTS if c not in rows.columns])
    T.export_csv(full, "events", path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    head, line = open(f"{path}/{part}").read().splitlines()
    assert head == ",".join(T.EXPORT_EVENTS) and line.startswith('2024-01-15T10:00:00.000000Z,,"a,""b""",,')


def test_flatten_attributes(spark):
    logs = log_rows(spark, {"attrs": '{"a":{"b":1,"c":{"d":[1,2]}},"e":"x"}'}, {"h": 1, "attrs": '{"e":null,"z":true}'}, {"h": 2, "attrs": "{}"}, {"h": 3})
    flat = E.flatten_attributes(logs, F.lit(True), T0, T0 + timedelta(hours=2))
    assert {c for c in flat.columns if c.startswith("attr.")} == {"attr.a.b", "attr.a.c.d", "attr.e", "attr.z"}
    r = flat.filter("event_key = 0").first()
    assert (r["attr.a.b"], r["attr.a.c.d"], r["attr.e"], r["attr.z"]) == ("1", "[1,2]", "x", None)
    assert flat.count() == 3 and [x["event_key"] for x in E.flatten_attributes(logs, F.lit(True), T0, T0 + timedelta(hours=9), 1).limit(1).collect()] == [3]


def test_search_page(spark):
    logs = log_rows(spark, *[{"h": h, "msg": f"m{h}"} for h in range(5)])
    page = E.search_logs(logs, F.lit(True), T0, T0 + timedelta(hours=9), 2, 1).collect()
    assert [(r["message"], r["total_matched"], r["truncated"]) for r in page] == [("m3", 5, True), ("m2", 5, True)]
    none = E.window_summary(logs.limit(0), T0, T0).first()
    assert (none["total"], none["error_rate"], list(none["hints"])) == (0, 0.0, ["no rows between the given times"])


def test_traces(spark):
    logs = log_rows(spark, {"trace": "t", "protocol": "otlp_span", "attrs": '{"duration_ms":5,"span_kind":"K"}'}, {"h": 1, "trace": "t", "protocol": "otlp_span", "level": "error"}, {"trace": "t"}, {"trace": "", "protocol": "otlp_span"})
    r = G.list_traces(logs, T0, T0 + timedelta(hours=2)).collect()
    assert [(x["span_count"], x["error_count"], x["duration_ms"]) for x in r] == [(2, 1, 5.0)]
    assert [x["span_kind"] for x in G.trace_spans(logs, "t").collect()] == ["K", None]


def test_salted_join_equals_plain_join(spark):
    big = spark.range(2000).select(F.col("id").alias("e"), F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, big.join(small, ["k"], how).select("e").collect()))
        got = salted_join(big, small, ["k"], F.col("e"), how, hot_rows=100)
        assert sorted(map(str, got.select("e").collect())) == want
    counted = small.join(big.groupBy("k").count().withColumnRenamed("count", "n"), "k", "left").fillna(0, ["n"])
    assert salted_join(big, counted, ["k"], F.col("e"), "left", hot_rows=100).count() == 2000

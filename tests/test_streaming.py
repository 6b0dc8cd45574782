from datetime import timedelta

from conftest import T0
from pyspark.sql import functions as F

from logspark import schemas
from logspark.operators import errors as C, sessions as S, visit_store as V, web_reports as R, web_rollups as WR
from logspark.sources import tiers as T
from logspark.streaming import jobs as J


def land(df, path, parts):
    """Write ``df`` as several files, one micro-batch each."""
    for i, part in enumerate(parts):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def memory(spark, df, name, mode):
    drain(df.writeStream.format("memory").queryName(name).outputMode(mode))
    return spark.table(name)


def test_normalise_stream(spark, raw, tmp_path):
    df = raw('{"msg":"a","service":"s"}', "plain error", '{"msg":"b"}')
    land(df, str(tmp_path / "in"), ["raw like '%a%'", "raw not like '%a%'"])
    root = str(tmp_path / "out")
    drain(J.normalise_stream(stream(spark, df, str(tmp_path / "in")), root, str(tmp_path / "cp")))
    assert sorted(r["message"] for r in T.read_committed(spark, root, "logs").collect()) == ["a", "b", "plain error"]


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=13 * i), "api" if i % 3 else None, "info", '{"duration_ms":%d}' % i, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "event_key long, ts timestamp, service string, level string, attributes string, raw_len int")
    land(df, str(tmp_path / "in"), ["event_key < 30", "event_key >= 30"])
    from logspark.operators.rollups import rollup_logs

    got = memory(spark, J.rollup_stream(stream(spark, df, str(tmp_path / "in"))), "rollup_s", "complete")
    want = rollup_logs(df)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_realtime_and_session_streams(spark, web, tmp_path):
    df = web({"v": 1}, {"v": 2, "at": 1}, {"v": 1, "at": 2}, {"v": 1, "at": 60}, {"v": 9, "bot": True})
    land(df, str(tmp_path / "in"), ["event_key < 3", "event_key >= 3"])
    live = memory(spark, J.realtime_stream(stream(spark, df, str(tmp_path / "in"))), "live_s", "complete")
    assert live.agg(F.max("visitors")).first()[0] == 2
    visits = memory(spark, J.session_count_stream(stream(spark, df, str(tmp_path / "in"))), "visits_s", "complete")
    assert sorted((r["visitor_id"], r["events"]) for r in visits.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_session_stream_recuts_late_events(spark, web, tmp_path):
    df = web({"v": 7}, {"v": 7, "at": 50}, {"v": 8}, {"v": 7, "at": 25, "event": "custom"})
    land(df, str(tmp_path / "in"), ["event_key < 3", "event_key = 3"])
    ev, ses = str(tmp_path / "ev"), str(tmp_path / "ses")
    drain(J.session_stream(stream(spark, df, str(tmp_path / "in")), ev, ses, str(tmp_path / "cp")))
    got, want = V.read_sessions(spark, ses), S.sessionize(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert V.read_sessions(spark, ses, below=1).count() == 3


def test_recompute_days_counts_late_events_once(spark, web, tmp_path):
    minute, daily = str(tmp_path / "m"), str(tmp_path / "d")
    for ev in (web({"v": 1}, {"v": 2}), web({"v": 1}, {"v": 2}, {"v": 3})):
        J.recompute_days(S.stamp_sessions(ev), S.sessionize(ev), minute, daily, T0.date(), T0.date())
    assert spark.read.parquet(minute).agg(F.sum("pageviews")).first()[0] == 3
    assert spark.read.parquet(daily).filter("dim = 'os'").agg(F.sum("visitors")).first()[0] == 3


def test_error_group_stream(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=i), "api", "error", f"boom {i}", f"f{i % 2}", '{"stack":"s%d"}' % (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_key long, ts timestamp, service string, level string, message string, fingerprint string, attributes string")
    land(df, str(tmp_path / "in"), ["event_key < 5", "event_key >= 5"])
    groups = str(tmp_path / "groups")
    drain(J.error_group_stream(stream(spark, df, str(tmp_path / "in")), groups, str(tmp_path / "cp")))
    got = {r["fingerprint"]: (r["total_count"], r["last_seen"], len(r["samples"])) for r in J.read_snapshot(spark, groups).collect()}
    want = {r["fingerprint"]: (r["count"], r["last_seen"], len(r["samples"])) for r in C.fold_error_groups(df).collect()}
    assert got == want


def test_alert_stream_fires_on_changes_only(spark, tmp_path):
    from logspark.operators.rollups import rollup_logs

    rows = [(i, T0 + timedelta(seconds=i), "api", "error", "m", None, "{}", 1, "http_json") for i in range(5)]
    logs = spark.createDataFrame(rows, "event_key long, ts timestamp, service string, level string, message string, fingerprint string, attributes string, raw_len int, protocol string")
    ticks = spark.createDataFrame([(i, T0 + timedelta(minutes=m)) for i, m in enumerate((1, 2, 600))], "i int, now timestamp")
    land(ticks, str(tmp_path / "in"), ["i = 0", "i = 1", "i = 2"])
    rules = [{"rule_id": 1, "name": "r", "metric": "volume", "condition": {"type": "threshold", "comparator": ">", "value": 1}}]
    tables = lambda s: {"logs": logs, "rollup": rollup_logs(logs)}
    out = str(tmp_path / "events")
    drain(J.alert_stream(stream(spark, ticks, str(tmp_path / "in")), rules, tables, str(tmp_path / "state"), out, str(tmp_path / "cp")))
    fired = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r["ts"], r["severity"]) for r in fired] == [(T0 + timedelta(minutes=1), "alert"), (T0 + timedelta(minutes=600), "ok")]


def test_chunk_stream(spark, tmp_path):
    rows = [(T0, "a", 1, 2, "B"), (T0 + timedelta(seconds=1), "a", 0, 2, "A"), (T0 + timedelta(seconds=1), "a", 0, 2, "A"), (T0, "b", 0, 2, "x"), (T0 + timedelta(minutes=5), "z", 0, 1, "z"), (T0 + timedelta(minutes=9), "y", 0, 1, "y")]
    df = spark.createDataFrame(rows, "receive_ts timestamp, msg_id string, seq int, total int, payload string")
    land(df, str(tmp_path / "in"), ["msg_id in ('a','b')", "msg_id = 'z'", "msg_id = 'y'"])
    got = memory(spark, J.chunk_stream(stream(spark, df, str(tmp_path / "in"))), "chunks_s", "append")
    assert ("a", "AB") in {tuple(r) for r in got.collect()} and "b" not in {r["msg_id"] for r in got.collect()}


def test_exact_visitors_follow_late_events(spark, web, tmp_path):
    from logspark.operators.realtime import sliding_visitors, visitor_minutes

    at = [0, 1, 4, 9, 10, 15.5, 837, 838, 840, 841, 845]  # T0 is 10:00, so 840 minutes later the day ends
    df = web(*[{"v": v, "at": m + v / 4, "bot": v == 3} for m in at for v in (1, 2, 3)], {"v": 9, "at": 12}, {"v": 9, "at": 2})
    seen = [(r["ts"], r["visitor_id"]) for r in df.collect() if not r["is_bot"]]
    want = set()
    for i in range(0, 900):
        end = T0 + timedelta(minutes=i)
        inside = [v for ts, v in seen if end - timedelta(minutes=5) <= ts < end]
        if inside:
            want.add((end, "s", len(set(inside)), len(inside)))
    assert {tuple(r) for r in sliding_visitors(visitor_minutes(df)).collect()} == want
    land(df, str(tmp_path / "in"), ["event_key % 3 = 1", "event_key % 3 = 0", "event_key % 3 = 2"])
    for _ in range(2):
        drain(J.realtime_exact_stream(stream(spark, df, str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "cp")))
        got = spark.read.parquet(str(tmp_path / "live" / "live")).drop("part_day")
        assert {tuple(r) for r in got.collect()} == want

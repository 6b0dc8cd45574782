"""Alert severities and chunk timeouts kept in state, fed in several batches."""

import random
from datetime import timedelta

from conftest import T0
from pyspark.sql import functions as F

from logspark.operators.alerts import entries_of, severity_history
from logspark.streaming import stateful as Z


def fed(spark, df, path, parts, build, name):
    """Feeds the rows in the given parts, one file after the other, and gives all rows put out."""
    for p in parts:
        df.filter(p).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    build(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


STEPS = [{"comparator": ">=", "value": 2.0, "severity": "warning"}, {"comparator": ">=", "value": 5.0, "severity": "critical"}]
RULES = [{"rule_id": i, "name": f"r{i}", "metric": "volume", "condition": {"type": "threshold", "thresholds": STEPS, "cooldown_secs": 600}} for i in (1, 2)]


def test_severities_follow_event_time_not_arrival(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(r, T0 + timedelta(minutes=m), float(rnd.choice([0, 0, 3, 7])), rnd.randrange(4)) for r in (1, 2) for m in range(60)]
    rows += [(1, T0 + timedelta(days=1), 0.0, 4)]  # moves the watermark past all others
    df = spark.createDataFrame(rows, "rule_id long, ts timestamp, value double, part int")
    got = fed(spark, df, str(tmp_path / "in"), [f"part = {i}" for i in range(5)], lambda s: Z.severity_stream(s, RULES, "2 hours"), "severities")
    series = df.filter("part < 4")
    want = severity_history(series, ["rule_id"], entries_of(RULES[0]["condition"])).collect()
    key = lambda r: (r["rule_id"], r["ts"], r["value"], r["before"], r["severity"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 20


def test_cooldown_keeps_a_rule_quiet(spark, tmp_path):
    values = [(0, 3.0), (2, 7.0), (5, 0.0), (6, 3.0), (9, 7.0), (10, 7.0), (16, 7.0), (25, 3.0)]  # minutes; cooldown of ten
    rows = [(1, T0 + timedelta(minutes=m), v, i % 3) for i, (m, v) in enumerate(values)] + [(1, T0 + timedelta(days=1), 3.0, 3)]
    df = spark.createDataFrame(rows, "rule_id long, ts timestamp, value double, part int")
    got = fed(spark, df, str(tmp_path / "in"), [f"part = {i}" for i in range(4)], lambda s: Z.severity_stream(s, RULES, "2 hours", cooldown=True), "cooled")
    assert sorted((int((r["ts"] - T0).total_seconds() // 60), r["severity"]) for r in got) == [(0, "warning"), (5, "ok"), (10, "critical"), (25, "warning")]


def test_chunks_time_out_and_begin_anew(spark, tmp_path):
    def part(m, at, seq, total, text, file):
        return (T0 + timedelta(seconds=at), m, seq, total, text, file)

    rows = [
        part("a", 0, 1, 2, "B", 0), part("a", 1, 0, 2, "A", 1), part("a", 2, 0, 2, "A", 1),  # whole over two batches, a part twice
        part("b", 0, 0, 2, "x", 0), part("b", 7, 1, 2, "y", 1),  # the second part comes too late, and is alone then
        part("c", 1, 0, 1, "c", 0), part("d", 1, 0, 3, "d", 0), part("d", 2, 1, 4, "d", 0),  # two totals
        part("e", 3, 0, 2, "é", 1), part("e", 2, 1, 2, "!", 2), part("bad", 1, 5, 2, "z", 0), part(None, 1, 0, 1, "z", 0),
        part("z", 100, 0, 1, "z", 3),
    ]
    df = spark.createDataFrame(rows, "receive_ts timestamp, msg_id string, seq int, total int, payload string, file int")
    got = fed(spark, df, str(tmp_path / "in"), [f"file = {i}" for i in range(4)], lambda s: Z.chunk_messages(s, 5, "10 seconds"), "messages")
    assert sorted(map(tuple, got), key=str) == sorted([
        ("a", "AB", True, 2, 2), ("b", None, False, 1, 2), ("b", None, False, 1, 2), ("c", "c", True, 1, 1), ("d", None, False, 1, -1), ("e", "é!", True, 2, 2), ("z", "z", True, 1, 1),
    ], key=str)


def test_messages_of_one_bucket_keep_their_own_times(spark, tmp_path):
    """One state value serves many messages: each still ends, fails or begins anew by its own time."""
    rows = [(T0 + timedelta(seconds=m % 4), f"m{m}", s, 3, f"{m}.{s};", s) for m in range(40) for s in range(3) if not (m % 5 == 0 and s == 2)]
    rows += [(T0 + timedelta(seconds=30), "m1", 0, 1, "again", 2), (T0 + timedelta(minutes=5), "end", 0, 1, "", 3)]
    df = spark.createDataFrame(rows, "receive_ts timestamp, msg_id string, seq int, total int, payload string, file int")
    got = fed(spark, df, str(tmp_path / "in"), [f"file = {i}" for i in range(4)], lambda s: Z.chunk_messages(s, 5, "40 seconds", buckets=2), "bucketed")
    want = [(f"m{m}", None, False, 2, 3) if m % 5 == 0 else (f"m{m}", f"{m}.0;{m}.1;{m}.2;", True, 3, 3) for m in range(40)]
    assert sorted(map(tuple, got), key=str) == sorted([*want, ("m1", "again", True, 1, 1), ("end", "", True, 1, 1)], key=str)

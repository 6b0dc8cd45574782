"""Visits kept batch by batch against cutting all events at once."""

import random
from datetime import timedelta

import pytest
from conftest import T0, WEB_DDL
from pyspark.sql import functions as F

from logspark.operators import sessions as S, visit_store as V
from logspark.operators.web_rollups import web_rollup_daily, web_rollup_minute
from logspark.streaming import jobs as J

GAP = 3600


def events(spark, n, days=9, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(seconds=rnd.randrange(days * 86_400) + rnd.choice([0, 0.5]))
        kind = rnd.choice(["pageview", "pageview", "custom", "vital", "engagement"])
        v = rnd.choice([0, 1, 1, 1, *range(2, 30)])
        rows.append((i, at, at, rnd.choice("ab"), v, v or None, kind, rnd.choice(["/a", "/b"]) if kind == "pageview" else None, None, 10.0,
                     rnd.choice(["x", None]), "m", "ID", None, None, "desktop", "Chrome", "Linux", rnd.random() < 0.2, rnd.random() < 0.05))
    return spark.createDataFrame(rows, WEB_DDL).cache()


def lines(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_batches_in_any_order_equal_one_cut(spark, tmp_path):
    df, root = events(spark, 2500), str(tmp_path)
    for k in range(5):  # events of all days in every batch: most of them come late
        batch = df.filter(F.col("event_key") % 5 == k)
        V.apply_batch(batch, root, k, GAP, buckets=3)
        seen = df.filter(F.col("event_key") % 5 <= k)
        assert lines(V.read_sessions(spark, root)) == lines(S.sessionize(seen, GAP))
    assert lines(V.read_sessions(spark, root, below=4)) == lines(S.sessionize(df.filter(F.col("event_key") % 5 <= 3), GAP))
    V.apply_batch(df.filter("event_key % 5 = 4"), root, 4, GAP, buckets=3)  # run again
    assert lines(V.read_sessions(spark, root)) == lines(S.sessionize(df, GAP))
    V.apply_batch(df.limit(0), root, 5, GAP, buckets=3)
    assert lines(V.read_sessions(spark, root)) == lines(S.sessionize(df, GAP))
    stamped = V.stamp_from_visits(df, V.read_visits(spark, root), GAP).select("event_key", "session_id")
    assert lines(stamped) == lines(S.stamp_sessions(df, GAP).select("event_key", "session_id"))


def test_a_batch_reads_touched_partitions_only_and_keeps_three_places(spark, web, tmp_path):
    root = str(tmp_path)
    day = 24 * 60
    old = web(*[{"v": v, "at": d * day} for v in range(1, 9) for d in range(5)])
    V.apply_batch(old, root, 0, GAP, buckets=4)
    before = {r["part_day"]: r for r in V.read_index(spark, root).collect()}
    late = web({"v": 3, "at": 2 * day + 10}).withColumn("event_key", F.lit(99).cast("long"))
    changed, parts = V.apply_batch(late, root, 1, GAP, buckets=4)
    assert [(r["visitor_id"], r["events"]) for r in changed.collect()] == [(3, 2)]
    assert {p["part_day"] for p in parts} == {(T0 + timedelta(days=2)).date()} and len(parts) == 1
    read = V.read_parts(spark, root, parts)
    assert all(f"part_day={parts[0]['part_day']}/part_bucket={parts[0]['part_bucket']}" in f for f in read.inputFiles())
    after = {(r["part_day"], r["part_bucket"]): r["place"] for r in V.read_index(spark, root).collect()}
    assert sorted(after.values()) == [0] * (len(after) - 1) + [1] and before
    for k in range(2, 8):
        V.apply_batch(late.withColumn("event_key", F.lit(100 + k).cast("long")), root, k, GAP, buckets=4)
    part = f"part_day={parts[0]['part_day']}/part_bucket={parts[0]['part_bucket']}"
    assert len(list((tmp_path / "visits").glob(f"place=*/{part}"))) == 3 and len(list((tmp_path / "index").glob("ring=*"))) == 3


def test_a_visit_over_many_days_is_found_and_moves_back(spark, web, tmp_path):
    root = str(tmp_path)
    chain = [{"v": 5, "at": 50 * i} for i in range(0, 100)]  # one visit of more than three days
    late = [{"v": 5, "at": -50}, {"v": 5, "at": 50 * 100}, {"v": 6, "at": 1}]
    df = web(*chain, *late)
    V.apply_batch(df.filter("event_key < 100 and event_key <> 30"), root, 0, GAP, buckets=2)
    assert V.read_sessions(spark, root).count() == 2
    V.apply_batch(df.filter("event_key = 30"), root, 1, GAP, buckets=2)  # joins both
    V.apply_batch(df.filter("event_key >= 100"), root, 2, GAP, buckets=2)
    assert lines(V.read_sessions(spark, root)) == lines(S.sessionize(df, GAP))
    index = V.read_index(spark, root)
    assert index.filter("n = 0").count() >= 1  # a partition whose visits have moved to an earlier day
    late = df.filter("event_key = 101")
    assert V.touched(index, V.placed(V.cut(late, GAP), 2), GAP).filter("n > 0").count() >= 1


def test_a_failed_batch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    df, root = events(spark, 400, 3), str(tmp_path)
    V.apply_batch(df.filter("event_key % 2 = 0"), root, 0, GAP, buckets=2)
    want = lines(V.read_sessions(spark, root))
    monkeypatch.setattr(type(spark), "range", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("before the mark")))
    with pytest.raises(RuntimeError):
        V.apply_batch(df.filter("event_key % 2 = 1"), root, 1, GAP, buckets=2)
    monkeypatch.undo()
    assert lines(V.read_sessions(spark, root)) == want
    V.apply_batch(df.filter("event_key % 2 = 1"), root, 1, GAP, buckets=2)
    assert lines(V.read_sessions(spark, root)) == lines(S.sessionize(df, GAP))


def test_rollups_follow_late_events_day_by_day(spark, tmp_path):
    df, root, src = events(spark, 1200, 5, seed=4), str(tmp_path / "web"), str(tmp_path / "in")
    # four batches: three in order of time, then late ones for the second day only
    second = F.to_date("ts") == F.lit((T0 + timedelta(days=1)).date())
    late = second & (F.col("event_key") % 4 == 0)
    part = F.when(late, 3).otherwise(F.floor(F.datediff("ts", F.lit(T0)) / 2))
    for k in range(4):
        df.filter(part == k).coalesce(1).write.mode("append").parquet(src)

    def run():
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        J.web_rollup_stream(source, root, str(tmp_path / "cp"), GAP, 2).trigger(availableNow=True).start().awaitTermination()

    run()
    stamped, rows = S.stamp_sessions(df, GAP), S.sessionize(df, GAP)
    got = spark.read.parquet(f"{root}/minute").drop("part_day")
    assert lines(got) == lines(web_rollup_minute(stamped))
    assert lines(spark.read.parquet(f"{root}/daily").drop("part_day")) == lines(web_rollup_daily(stamped, rows))
    dirty = {}
    for r in spark.read.parquet(f"{root}/dirty").collect():
        dirty.setdefault(r["batch_id"], set()).add((r["day"] - T0.date()).days)
    assert 1 in dirty[3] and dirty[3] <= {0, 1, 2} and max(dirty[2]) >= 4
    written = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "web" / "daily").glob("part_day=*/*.parquet")}
    J.rebuild_days(spark, root, [(T0 + timedelta(days=1)).date()], 3, GAP)
    again = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "web" / "daily").glob("part_day=*/*.parquet")}
    assert {d for d in again if again[d] != written[d]} == {f"part_day={(T0 + timedelta(days=1)).date()}"}
    assert lines(spark.read.parquet(f"{root}/daily").drop("part_day")) == lines(web_rollup_daily(stamped, rows))

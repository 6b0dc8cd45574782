from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.operators import series as Z, sessions as S, web_reports as R, web_rollups as WR

A, B = T0 - timedelta(days=1), T0 + timedelta(days=5)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_daily_uniques_and_replace(web, spark, tmp_path):
    ev = web({"v": 1}, {"v": 2}, {"v": 1, "at": 1, "path": "/b"}, {"v": 1, "at": 1440})
    stamped, ses = S.stamp_sessions(ev), S.sessionize(ev)
    daily = WR.web_rollup_daily(stamped, ses)
    visits = daily.filter("dim = 'device'").groupBy("day").agg(F.sum("visitors").alias("v")).orderBy("day")
    assert [r["v"] for r in visits.collect()] == [2, 1]
    assert R.web_summary(stamped, ses, A, B).first()["visitors"] == 3


def test_top_n_and_other(web):
    ev = web(*[{"v": i, "path": p} for i, p in enumerate(["/a", "/a", "/a", "/b", "/b", "/c"], 1)])
    stamped, ses = S.stamp_sessions(ev), S.sessionize(ev)
    rows = WR.web_rollup_daily(stamped, ses, top=2).filter("dim = 'path'").orderBy("dim_value")
    assert [(r["dim_value"], r["pageviews"], r["visitors"], r["bounces"]) for r in rows.collect()] == [("(other)", 1, 1, 1), ("/a", 3, 3, 3), ("/b", 2, 2, 2)]


def test_funnel(web):
    ev = web(
        {"v": 1, "path": "/"}, {"v": 1, "at": 1, "path": "/program/x"}, {"v": 1, "at": 2, "path": "/give"},
        {"v": 2, "path": "/"}, {"v": 2, "at": 1, "path": "/other"}, {"v": 3, "path": "/give"}, {"v": 3, "at": 1, "path": "/program/y"},
    )
    st = S.stamp_sessions(ev)
    for hot in (10**6, 1):
        out = R.funnel(st, ["/", "/program/*", "/give"], A, B, hot_rows=hot).orderBy("step")
        assert [r["sessions"] for r in out.collect()] == [2, 1, 1]
        assert [r["overall_conversion"] for r in out.collect()][-1] == 0.5
    same_time = web({"path": "/x"}, {"event": "custom", "name": "go"})
    assert [r["sessions"] for r in R.funnel(S.stamp_sessions(same_time), ["/x", "event:go"], A, B).orderBy("step").collect()] == [1, 0]
    with pytest.raises(ValueError):
        R.funnel(st, ["/"], A, B)
    none = R.funnel(st, ["/nothing", "/give"], A, B).orderBy("step").collect()
    assert [(r["sessions"], r["drop_off"]) for r in none] == [(0, 0.0), (0, 0.0)]


def test_summary_numbers(web):
    ev = web(
        {"v": 1, "source": "direct", "medium": "direct"}, {"v": 1, "at": 1, "event": "engagement", "value": 3000.0}, {"v": 1, "at": 2, "event": "outbound", "name": "x.example"},
        {"v": 2, "source": "google", "medium": "organic"}, {"v": 2, "at": 1, "event": "engagement", "value": 2500.0},
        {"v": 3, "internal": True}, {"v": 4, "bot": True},
    )
    st, ses = S.stamp_sessions(ev), S.sessionize(ev)
    r = R.web_summary(st, ses, A, B).first()
    assert (r["pageviews"], r["visitors"], r["sessions"], r["bounce_rate"], r["avg_duration_ms"]) == (2, 2, 2, 0.5, 2750.0)
    assert R.web_summary(st, ses, A, B, include_internal=True).first()["sessions"] == 3
    assert plain(R.links(st, "outbound", A, B)) == [("x.example", "/", 1)]
    assert {r["medium"]: r["bounce_rate"] for r in R.sources(ses, A, B).collect()} == {"direct": 0.0, "organic": 1.0}
    assert R.list_sessions(ses, A, B, events=st, chips={"source": "google"}).count() == 1
    with pytest.raises(ValueError):
        R.links(st, "inbound", A, B)
    with pytest.raises(ValueError):
        R.breakdown("shoe size", A, B, events=st)
    with pytest.raises(ValueError):
        R.web_stats("joy", A, B, events=st)


def test_lists_survive_a_further_limit(web):
    ev = web({"v": 1, "path": "/b", "medium": "m"}, {"v": 2, "path": "/a"}, {"v": 3, "path": "/a"})
    top = R.pages(S.stamp_sessions(ev), S.sessionize(ev), A, B, 1).limit(1).collect()
    assert top[0]["page"] == "/a"


def test_vitals(web):
    ev = web(*[{"event": "vital", "name": "LCP", "value": float(v), "path": "/a"} for v in (1000, 2000, 3000, 9000)])
    r = R.vitals(ev, A, B).first()
    assert (r["p75"], r["samples"], r["good_pct"]) == (3000.0, 4, 0.5)
    assert R.vitals_overall(R.vitals(ev, A, B)).filter("scope = 'overall'").first()["status"] == "Needs work"


def test_series_helpers(spark):
    s = spark.createDataFrame([(T0, 3)], "bucket timestamp, value long")
    filled = Z.zero_fill(s, T0 - timedelta(minutes=2), T0 + timedelta(minutes=1), "1m").orderBy("bucket")
    assert [r["value"] for r in filled.collect()] == [0, 0, 3]
    shares = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert sorted(r["percent"] for r in Z.share_percent(shares, "n", ["k"]).collect()) == [33, 33, 34]
    assert [r["percent"] for r in Z.share_percent(shares.withColumn("n", F.lit(0)), "n", ["k"]).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(5,)], "n long")
    r = Z.compare_previous(one, one.withColumn("n", F.lit(4).cast("long")), ["n"]).first()
    assert (r["n_delta"], r["n_change_pct"]) == (1, 25.0)
    r = Z.compare_previous(one, one.limit(0), ["n"]).first()
    assert (r["n_prev"], r["n_change_pct"]) == (0, None)

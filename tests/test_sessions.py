import random
from datetime import datetime, timedelta

from conftest import T0, WEB_DDL
from pyspark.sql import functions as F

from logspark.operators import sessions as S


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy("visitor_id", "start_ts").collect()]


def test_gap_split(web):
    ev = web({"v": 11}, {"v": 11, "at": 5}, {"v": 11, "at": 45}, {"v": 11, "at": 46, "event": "custom"}, {"v": 22, "at": 2})
    out = rows(S.sessionize(ev), "visitor_id", "start_ts", "pageviews", "events", "is_bounce")
    assert out == [(11, T0, 2, 2, False), (11, T0 + timedelta(minutes=45), 1, 2, False), (22, T0 + timedelta(minutes=2), 1, 1, True)]


def test_exact_gap(web):
    assert S.sessionize(web({}, {"at": 30})).count() == 1
    assert S.sessionize(web({}, {"at": 30 + 1 / 60})).count() == 2


def test_bots_anonymous_and_settle(web):
    ev = web({"v": 1}, {"v": 2, "bot": True}, {"v": 0}, {"v": 3, "at": 10})
    assert {r["visitor_id"] for r in S.sessionize(ev).collect()} == {1, 3}
    settled = S.settled(ev, T0 + timedelta(minutes=10, seconds=20))
    assert {r["visitor_id"] for r in S.sessionize(settled).collect()} == {1}


def test_lone_beacons(web):
    ev = web({"v": 1, "event": "vital"}, {"v": 2}, {"v": 2, "at": 1, "event": "vital"}, {"v": 2, "at": 2, "event": "engagement", "value": 100.0})
    assert rows(S.sessionize(ev), "visitor_id", "start_ts", "events")[0][2] == 3
    ids = {r["visitor_id"]: r["session_id"] for r in S.stamp_sessions(ev).collect()}
    assert ids[1] == 0 and ids[2] not in (0, None)


def test_bounce_rules(web):
    ev = web(
        {"v": 1}, {"v": 1, "event": "vital"}, {"v": 1, "event": "engagement"},
        {"v": 2}, {"v": 2, "event": "outbound"}, {"v": 3}, {"v": 3, "at": 1},
    )
    assert [r[2] for r in rows(S.sessionize(ev), "visitor_id", "start_ts", "is_bounce")] == [True, False, False]


def test_first_touch_entry_exit_and_clamp(web):
    ev = web(
        {"event": "vital", "source": "direct", "medium": "direct", "path": None},
        {"source": "google", "medium": "organic", "path": "/landing"},
        {"at": 2, "event": "engagement", "value": 3_600_000.0},
    )
    r = S.sessionize(ev).first()
    assert (r["source"], r["medium"], r["entry_path"], r["exit_path"]) == ("google", "organic", "/landing", "/landing")
    assert r["engaged_ms"] == 120_000 and not r["is_internal"]
    both = S.sessionize(web({"v": 1, "internal": True}, {"v": 2, "internal": True}, {"v": 2, "at": 1}))
    assert [x[2] for x in rows(both, "visitor_id", "start_ts", "is_internal")] == [True, False]


def test_late_event_restitches(web):
    ev = web({"v": 7}, {"v": 7, "at": 50}, {"v": 8}, {"v": 7, "at": 25, "event": "custom"})
    early, late = ev.filter("event_key < 3"), ev.filter("event_key = 3")
    old = S.sessionize(early)
    assert old.count() == 3
    new = S.restitch(ev, old, late)
    assert rows(new, "visitor_id", "start_ts", "events") == [(7, T0, 3), (8, T0, 1)]
    assert sorted(map(tuple, S.restitch(ev, new, late).collect())) == sorted(map(tuple, new.collect()))
    assert new.filter("visitor_id = 7").first()["session_id"] in {r["session_id"] for r in old.collect()}


def plain_sessions(events, gap):
    """The rules read straight: sort, split where the gap in whole seconds is exceeded."""
    out, by_visitor = [], {}
    for e in events:
        if not e["bot"] and e["v"]:
            by_visitor.setdefault((e["site"], e["v"]), []).append(e)
    for key, items in by_visitor.items():
        items.sort(key=lambda e: (e["ts"], e["key"]))
        visit = []
        for e in items + [None]:
            if e is None or (visit and int(e["ts"].timestamp()) - int(visit[-1]["ts"].timestamp()) > gap):
                views = [x for x in visit if x["event"] == "pageview"]
                if views:
                    paths = [x["path"] for x in visit if x["path"] is not None]
                    acted = any(x["event"] in S.INTERACTIONS for x in visit)
                    out.append((*key, views[0]["ts"], visit[-1]["ts"], len(views), len(visit), paths[0], paths[-1], len(views) == 1 and not acted))
                visit = []
            if e is not None:
                visit.append(e)
    return sorted(out)


def test_random_events_against_plain_python(spark):
    rnd = random.Random(5)
    events = []
    for i in range(1500):
        event = rnd.choice(["pageview", "custom", "vital", "engagement", "outbound", "error"])
        events.append({
            "key": i, "site": rnd.choice("ab"), "v": rnd.choice([0, 1, 1, 1, 1, 2, 3]), "bot": rnd.random() < 0.05, "event": event,
            "ts": T0 + timedelta(seconds=rnd.choice([0, 0.25, 0.75]) + rnd.randrange(0, 200_000)), "path": rnd.choice(["/a", "/b", "/c"]) if event == "pageview" else None,
        })
    data = [(e["key"], e["ts"], e["ts"], e["site"], e["v"], None, e["event"], e["path"], None, None, None, None, None, None, None, None, None, None, False, e["bot"]) for e in events]
    df = spark.createDataFrame(data, WEB_DDL)
    for gap in (60, 600, 1800):
        got = S.sessionize(df, gap).select("site_id", "visitor_id", "start_ts", "end_ts", "pageviews", "events", "entry_path", "exit_path", "is_bounce")
        assert sorted(map(tuple, got.collect())) == plain_sessions(events, gap)
        stamped = S.stamp_sessions(df, gap, hot_rows=1)
        assert stamped.count() == len(events)
        plain = {r["event_key"]: r["session_id"] for r in S.stamp_sessions(df, gap).collect()}
        assert plain == {r["event_key"]: r["session_id"] for r in stamped.collect()}


def test_repairs(web):
    good = S.sessionize(web({"v": 1, "path": "/x"}, {"v": 1, "at": 3, "path": "/y"}))
    ev = S.stamp_sessions(web({"v": 1, "path": "/x"}, {"v": 1, "at": 3, "path": "/y"}))
    null = F.lit(None).cast("string")
    bad = good.withColumns({"entry_path": null, "is_bounce": F.lit(True), "engaged_ms": F.lit(10**9)})
    bad = bad.withColumns({"os": F.lit("desktop"), "region": F.lit("Chrome"), "city": F.lit("Linux"), "device": F.lit("JK"), "browser": F.lit("Jakarta")})
    r = S.repair_sessions(bad, ev, T0 + timedelta(days=1)).first()
    assert (r["entry_path"], r["exit_path"], r["is_bounce"], r["engaged_ms"]) == ("/x", "/y", False, 180_000)
    assert (r["device"], r["browser"], r["os"], r["region"], r["city"]) == ("desktop", "Chrome", "Linux", "JK", "Jakarta")
    assert S.repair_sessions(good, ev, T0 + timedelta(days=1)).first() == good.first()
    empty = good.withColumn("pageviews", F.lit(0).cast("long"))
    assert S.repair_sessions(empty, ev, T0 + timedelta(days=1)).count() == 0
    assert S.repair_sessions(empty, ev, T0 + timedelta(days=30)).count() == 1


def test_hot_visitor_is_folded_before_the_window(web):
    ev = web(*[{"at": i / 60} for i in range(600)])
    plan = S.sessionize(ev)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window")
    assert "partial_count" in plan[window:], "events must be aggregated per slot below the window"
    assert S.slots(ev).count() <= 2

import json
import random
from datetime import date, timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.functions import web as W
from logspark.functions.levels import normalise_level
from logspark.functions.timestamps import flexible_ts
from logspark.normalise import beacons as B, common as C, enrich as N, error_events as X, logs as L, otlp as O, shippers as H
from logspark.sources.tiers import split_bodies


def first(df):
    return df.first().asDict()


def attrs(df):
    return json.loads(df.first()["attributes"])


def test_json_envelope(raw):
    df = L.normalise(raw('{"@timestamp":"2024-01-15T09:00:00+01:00","service":"api","level":"WARNING","msg":"hi","n":1,"big":1.5,"deep":{"a":[1,null]}}'))
    r = first(df)
    assert (r["service"], r["level"], r["message"], r["ts"], r["source_host"]) == ("api", "warn", "hi", T0.replace(hour=8), "10.0.0.9")
    assert attrs(df) == {"n": 1, "big": 1.5, "deep": {"a": [1, None]}} and r["trace_id"] is None


def test_whole_body_is_the_message_without_one(raw):
    body = '{"service":"x","k":"' + "y" * 3000 + '"}'
    r = first(L.normalise(raw(body)))
    assert r["message"] == body and r["raw_len"] == len(body)


def test_not_quite_json_is_text(raw):
    for body in ('{"a":1} trailing', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "[1,2]", '"text"', "{broken"):
        assert first(L.normalise(raw(body)))["message"] == body


def test_repeated_keys_last_wins(raw):
    assert attrs(L.normalise(raw('{"msg":"m","a":1,"a":2}'))) == {"a": 2}


def test_text_levels(raw):
    df = L.normalise(raw("Job FAILED", "a warning", "debugging", "hello", "Traceback ..."))
    assert [r["level"] for r in df.collect()] == ["error", "warn", "debug", "info", "error"]


def test_not_utf8(spark):
    df = spark.createDataFrame([(T0, "h", "tcp", bytearray(b"\xff\xfe\x00"))], "receive_ts timestamp, source_addr string, protocol string, raw binary")
    assert first(L.normalise_text(df))["message"] == "<3 non-utf8 bytes>"


def test_syslog(raw):
    old = first(L.normalise(raw("<34>Oct  1 22:14:15 box su[7]: denied", protocol="syslog_udp")))
    assert (old["level"], old["source_host"], old["service"], old["message"], old["ts"].month) == ("fatal", "box", "su", "denied", 10)
    new = L.normalise(raw('<165>1 2003-10-11T22:14:15.003Z host app 12 ID47 [a@1 x="1" y="q\\"z"][b k="2"] body here', protocol="syslog_tcp"))
    assert first(new)["message"] == "body here" and first(new)["level"] == "info"
    assert attrs(new) == {"syslog_facility": "LOG_LOCAL4", "syslog_procid": "12", "syslog_msgid": "ID47", "syslog_sd_a@1_x": "1", "syslog_sd_a@1_y": 'q"z', "syslog_sd_b_k": "2"}
    assert first(L.normalise(raw("<13>just words", protocol="syslog_udp")))["message"] == "just words"
    assert first(L.normalise(raw("<34>Oct  1 22:14:15 box su: x")))["service"] is None


def test_promotion_and_residue(raw):
    specs = tuple(map(C.promoted_spec, ("user_id:bigint", "env", "route:varchar:$.ctx.route", "ok:bool", "ratio:double")))
    df = L.normalise(raw('{"msg":"m","user_id":"42","env":"prod","ctx":{"route":"/x"},"ok":"on","ratio":true,"left":1}', '{"msg":"m","user_id":[1],"env":7,"ok":2,"ratio":"1e3"}', '{"msg":"m"}'), specs)
    rows = [(r["user_id"], r["env"], r["route"], r["ok"], r["ratio"]) for r in df.collect()]
    assert rows == [(42, "prod", "/x", True, 1.0), (None, "7", None, None, 1000.0), (None,) * 5]
    assert attrs(df) == {"ctx": {"route": "/x"}, "left": 1}
    for bad in ("1x", "a:blob", "a b", ""):
        with pytest.raises(ValueError):
            C.promoted_spec(bad)


def test_message_json(raw):
    inner = json.dumps({"service": "in", "level": "E", "a": 1, "b": 2, "hostname": "hh"})
    body = json.dumps({"msg": inner, "a": 9})
    r = L.normalise(raw(body))
    assert (first(r)["service"], first(r)["level"], first(r)["source_host"], first(r)["message"]) == ("in", "error", "hh", inner)
    assert attrs(r) == {"a": 9, "b": 2}
    off = L.normalise(raw(body), lift_message=False)
    assert first(off)["service"] is None and attrs(off) == {"a": 9}
    assert attrs(L.normalise(raw(json.dumps({"msg": "[1,2]"})))) == {}


def test_drop_keys(raw):
    df = L.normalise(raw('{"msg":"m","service":"s","x":1,"y":2,"z":3}'), drop_keys=("x", "y", "service"))
    assert attrs(df) == {"z": 3} and first(df)["service"] == "s"


def test_levels_against_plain_python(spark):
    from logspark.functions.levels import LEVEL_WORDS

    plain = {w: lvl for lvl, words in LEVEL_WORDS.items() for w in words}
    rnd = random.Random(1)
    words = [*plain, "odd", "É", "x" * 33, "", "  warn\n"]
    texts = [rnd.choice(["", " ", "\t"]) + rnd.choice([str.lower, str.upper, str.title])(rnd.choice(words)) for _ in range(400)]

    def want(t):
        u = t.strip().translate({c: c - 32 for c in range(97, 123)})
        low = u.translate({c: c + 32 for c in range(65, 91)})
        return plain.get(u, low if len(u.encode()) <= 32 else "info")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", normalise_level(F.col("t")).alias("l")).collect():
        assert r["l"] == want(texts[r["i"]])


def test_flexible_ts(spark):
    texts = ["2024-01-15T10:00:00Z", "2024-01-15 10:00:00", "2024/1/5 1:2:3", "2024-01-15t10:00:00.5+01:00", "15 Jan", "2024-13-01T00:00:00Z"]
    got = [r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(flexible_ts(F.col("t")).alias("x")).collect()]
    assert got == [T0, T0, T0.replace(day=5, hour=1, minute=2, second=3), T0 - timedelta(minutes=59, seconds=59, milliseconds=500), None, None]


def test_bodies(spark):
    def split(body):
        return [r["raw"] for r in split_bodies(spark.createDataFrame([(body, T0)], "body string, receive_ts timestamp")).collect()]

    assert split(' [{"a":1},null,2]') == ['{"a":1}', "2"]
    assert split('{"a": 1}') == ['{"a":1}']
    assert split('{"a":1}\n\n plain \r\nnull\n{"b":2}') == ['{"a":1}', "plain", '{"b":2}']
    assert split("[1,2") == ["[1,2"]


def test_gelf(raw):
    df = H.normalise_gelf(raw('{"host":"h","short_message":"s","level":"odd","_container_name":"/","facility":"f","full_message":"F","_x":{"y":1}}', '{"short_message":"s"}', "nope"))
    rows = df.collect()
    assert len(rows) == 2 and (rows[0]["level"], rows[0]["service"], rows[0]["ts"]) == ("odd", "f", T0)
    assert json.loads(rows[0]["attributes"]) == {"_container_name": "/", "facility": "f", "full_message": "F", "_x": {"y": 1}}
    assert rows[1]["level"] == "info"


def test_chunks(spark):
    t = spark.createDataFrame([("a", 1, 2, "B"), ("a", 0, 2, "A"), ("a", 0, 2, "A"), ("b", 0, 2, "x"), ("c", 2, 2, "x"), ("d", 0, 129, "x"), ("e", 0, 1, "x"), ("e", 0, 2, "x")], "msg_id string, seq int, total int, payload string")
    assert [tuple(r) for r in H.reassemble_chunks(t).collect()] == [("a", "AB")]
    assert H.reassemble_chunks(t, max_bytes=1).count() == 0


def test_hec(raw):
    two = '{"event":"a } { b","time":1.5,"fields":{"container_name":"/c","n":1}}\n {"event":{"line":{"x":1},"source":"stderr","attrs":{"q":"w"}},"sourcetype":"st","host":"h"}'
    rows = H.normalise_hec(raw(two)).collect()
    assert [(r["message"], r["level"], r["service"]) for r in rows] == [("a } { b", "info", "c"), ('{"x":1}', "error", "st")]
    assert H.normalise_hec(raw('{"event":"a"} {"event":')).count() == 0
    assert first(H.normalise_hec(raw("plain line")))["message"] == "plain line"


def test_forward_keeps_every_entry(raw):
    rows = H.normalise_forward(raw('["t",[[1,{"log":"a"}],[2,{"msg":"b","source":"stderr"}]]]', '["",5,{"message":"c","k":[1]}]', '["t",1,"no map"]')).collect()
    assert [(r["message"], r["service"], r["level"]) for r in rows] == [("a", "t", "info"), ("b", "t", "error"), ("c", "unknown", "info")]


def test_audit(raw):
    one = {"auditID": "i", "stage": "ResponseStarted", "verb": "watch", "requestURI": "/u", "level": "Request", "responseStatus": {"code": 503, "reason": "Busy"}}
    r = H.normalise_k8s_audit(raw(json.dumps(one)))
    assert first(r)["message"] == "watch /u → 503 (streaming response started)" and first(r)["level"] == "error" and attrs(r)["audit_level"] == "Request"
    assert H.normalise_k8s_audit(raw('{"items":[]}', '{"x":1}')).count() == 0
    assert H.normalise_k8s_audit(raw(json.dumps([one, {**one, "stage": "Panic"}])), ("ResponseStarted",)).first()["level"] == "fatal"


def test_spans_logs_metrics(raw):
    span = {"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "n", "startTimeUnixNano": "1705312800000000000", "endTimeUnixNano": 1705312800150000000, "kind": 2, "status": {"code": "STATUS_CODE_ERROR"}}, {"name": "m", "endTimeUnixNano": "5", "startTimeUnixNano": "9"}]}]}]}
    rows = O.normalise_spans(raw(json.dumps(span))).collect()
    a = [json.loads(r["attributes"]) for r in rows]
    assert (rows[0]["ts"], rows[0]["level"], a[0]["duration_ms"], a[0]["span_kind"]) == (T0, "error", 150.0, "SPAN_KIND_SERVER")
    assert (a[1]["duration_ms"], rows[1]["service"], "status_code" in a[1]) == (0.0, "unknown_service", False)
    log = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityNumber": "SEVERITY_NUMBER_FATAL", "body": {"arrayValue": {"values": [{"intValue": 1}]}}}, {"severityText": "Wrn"}]}]}]}
    assert [(r["level"], r["message"]) for r in O.normalise_otlp_logs(raw(json.dumps(log))).collect()] == [("fatal", "[1]"), ("warn", None)]
    metric = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "x", "histogram": {"dataPoints": [{"count": 4}]}}, {"name": "y", "gauge": {"dataPoints": [{"asInt": "7"}, {}]}}, {"name": "z"}]}]}]}
    rows = O.normalise_otlp_metrics(raw(json.dumps(metric))).collect()
    assert [(r["message"], json.loads(r["attributes"])["value"]) for r in rows] == [("x", 4.0), ("y", 7.0), ("y", 0.0)]


def test_error_events(raw):
    frames = [{"module": "lib", "function": "g", "filename": "g.py", "lineno": 1}, {"function": "f", "filename": "f.py", "in_app": True}]
    base = {"exception": {"values": [{"type": "A", "value": "1", "stacktrace": {"frames": frames}}, {"type": "B", "value": "2"}]}}
    moved = json.loads(json.dumps(base))
    moved["exception"]["values"][0]["stacktrace"]["frames"][0]["lineno"] = 99
    rows = X.normalise_error_events(raw(json.dumps(base), json.dumps(moved), '{"message":{"formatted":"hey"}}', "{}"), F.lit("web")).collect()
    assert rows[0]["message"] == "A: 1" and rows[0]["fingerprint"] == rows[1]["fingerprint"]
    assert json.loads(rows[0]["attributes"])["stack"] == "A: 1\nf @ f.py:? #\nlib.g @ g.py:1"
    assert [r["message"] for r in rows[2:]] == ["hey", "Unknown error"] and rows[3]["level"] == "error"


def test_beacons(raw, spark):
    ok = {"s": "shop", "ev": [{"e": "pageview", "u": "/a?utm_source=n", "r": "https://duckduckgo.com/"}, {"e": "custom", "n": "buy", "dt": 9000, "p": {"k": 1}}, {"e": "vital", "n": "LCP", "v": 1200.5}]}
    bad = ["", "x" * 20000, '{"ev":[{"e":"pageview"}]}', '{"s":" ","ev":[]}', '{"s":"a","ev":[{"e":"zap"}]}', '{"s":"a","ev":[{"e":"custom","n":"<b>"}]}', '{"s":"a","ev":[{"e":"pageview","u":"a"}]}',
           '{"s":"a","ev":[{"e":"vital","v":"1"}]}', json.dumps({"s": "a", "ev": [{"e": "custom", "p": {"k": "x" * 5000}}]}), json.dumps({"s": "a", "ev": [{"e": "custom"}] * 21})]
    reasons = [r["reject_reason"] for r in B.validate_beacons(raw(json.dumps(ok), *bad)).collect()]
    assert reasons == [None] + ["bad_payload"] * 9 + ["too_many_events"]
    env = B.envelopes(B.validate_beacons(raw(json.dumps(ok))), {"ua": F.lit("Firefox on Windows"), "origin": F.lit("https://shop.example/x"), "cc": F.lit("ID"), "internal": F.lit(True)})
    salts = spark.createDataFrame([(date(2024, 1, 15), "s1"), (date(2024, 1, 16), "s2")], "day date, salt string")
    rows = B.explode_beacons(env, salts).orderBy("event").collect()
    assert [(r["event"], r["ts"], r["source"], r["medium"], r["path"]) for r in rows] == [
        ("custom", T0 - timedelta(seconds=9), "direct", "direct", None), ("pageview", T0, "n", "campaign", "/a"), ("vital", T0, "direct", "direct", None)]
    assert {(r["hostname"], r["browser"], r["is_internal"], r["screen_w"], r["country"]) for r in rows} == {("shop.example", "Firefox", True, None, "ID")}
    assert len({r["visitor_id"] for r in rows}) == 1 and not any("10.0.0.9" in str(r) for r in rows)
    next_day = env.withColumn("receive_ts", F.lit(T0 + timedelta(days=1)))
    assert B.explode_beacons(next_day, salts).first()["visitor_id"] != rows[0]["visitor_id"]


def test_referrers_and_agents(spark):
    cases = [("", None, "direct", "direct"), ("https://SHOP.example/x", None, "direct", "direct"), ("https://www.google.de/", None, "google", "organic"), ("https://gemini.google.com/", None, "gemini", "ai"),
             ("https://t.me/c", None, "telegram", "social"), ("https://blog.example/", None, "blog.example", "referral"), ("https://t.co", {"source": "Mail", "medium": "email"}, "Mail", "email"), ("", {"source": "x", "medium": "odd"}, "x", "campaign")]
    df = spark.createDataFrame([(i, r, u) for i, (r, u, *_) in enumerate(cases)], "i int, r string, u map<string,string>")
    for row in df.select("i", W.classify_referrer(F.col("r"), F.col("u"), F.lit("shop.example")).alias("c")).collect():
        assert tuple(row["c"]) == cases[row["i"]][2:]


def test_geo_narrowest_range_and_fallback(spark):
    ranges = spark.createDataFrame([(167772160, 184549375, "US", None, None), (167772160, 167772415, "ID", "JK", "Jakarta")], "lo long, hi long, country string, region string, city string")
    rows = spark.createDataFrame([(1, "10.0.0.5", "ZZ"), (2, "10.9.0.1", "ZZ"), (3, "192.168.0.1", "ZZ"), (4, "bad", ""), (5, None, "FR")], "k int, ip string, cc string")
    out = {r["k"]: (r["country"], r["city"]) for r in N.geo_enrich(rows, ranges, "ip", F.col("k"), "cc").collect()}
    assert out == {1: ("ID", "Jakarta"), 2: ("US", None), 3: ("ZZ", None), 4: (None, None), 5: ("FR", None)}


def test_addresses_of_both_families(spark):
    import ipaddress

    from logspark.functions.web import address_key, network

    good = ["::", "::1", "2001:db8::8:800:200C:417A", "1:2:3:4:5:6:7:8", "1::", "::ffff:192.0.2.33", "64:ff9b::1.2.3.4", "fe80::1:0:0", "10.1.2.3", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1:2:3:4:5:6:7::"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "g::1", "12345::", "1.2.3", "::1.2.3", "::300.1.1.1", "1:2:3:4:5:6:7::8", "fe80::1%eth0", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "ip string").select("ip", address_key(F.col("ip")).alias("k")).collect()
    for r in rows:
        if r["ip"] not in good:
            assert r["k"] is None, r
            continue
        n, k = int(ipaddress.ip_address(r["ip"])), r["k"]
        assert (k["high"] if k["family"] == 4 else ((k["high"] % 2**64) << 64) | (k["low"] % 2**64)) == n
    cidrs = ["2001:db8::/32", "::/0", "0.0.0.0/0", "10.0.0.0/8", "ffff::/1", "1::/64", "1::/65", "1::8000:0:0:1/127", "10.0.0.0/33", "::/129", "1::/x", "1::/1/2"]
    found = {r["c"]: r["n"] for r in spark.createDataFrame([(t,) for t in cidrs], "c string").select("c", network(F.col("c")).alias("n")).collect()}
    assert [c for c in cidrs if found[c] is None] == cidrs[8:]
    assert found["::/0"]["p1"] == found["::/0"]["p2"] == 0 and found["10.0.0.0/8"]["p1"] == 10 and found["1::/65"]["p1"] == 1 << 48


def test_filters_read_computed_columns_only(spark, raw):
    """A filter that moved below the columns it reads would parse each record again."""
    body = '{"auditID":"a","verb":"get","s":"shop","ev":[{"e":"pageview","u":"/"}]}'
    salts = spark.createDataFrame([(date(2024, 1, 15), "x")], "day date, salt string")
    checked = B.validate_beacons(raw(body, "web_event"))
    frames = [H.normalise_k8s_audit(raw(body)), X.normalise_error_events(raw(body)), H.normalise_gelf(raw(body)), B.explode_beacons(B.envelopes(checked, {}), salts)]
    for df in frames:
        assert len(df.collect()) == 1
        filters = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in x and "day" not in x]
        assert filters and all("_row#" in x and len(x) < 200 for x in filters)


def test_kinds_of_values(spark):
    texts = ['"x"', "1", "1.5", "1e300", "true", '{"a":{"b":[1]}}', "[[1],{}]", "null", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(C.J.kind(F.try_parse_json("t"))).collect()]
    assert got == ["string", "integer", "number", "number", "boolean", "object", "array", "null", None]

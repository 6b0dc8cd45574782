import random
import re
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.functions import text as X
from logspark.operators import errors as C

LOG_DDL = "event_key long, ts timestamp, service string, level string, message string, fingerprint string, attributes string"


def logs(spark, *rows):
    data = [(i, T0 + timedelta(minutes=r.get("at", i)), r.get("service", "api"), r.get("level", "error"), r.get("msg", "boom"), r.get("fp", "f"),
             '{"stack":"%s"}' % r["stack"] if "stack" in r else "{}") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LOG_DDL)


def plain_normalise(s):
    out, quote = [], None
    for ch in s:
        if quote:
            if ch == quote:
                out.append("'S")
                quote = None
            elif ch == "\n":
                out.append(" ")
                quote = None
        elif ch in "\"'":
            quote = ch
        else:
            out.append(ch)
    words = " ".join("".join(out).split())

    def swap(m):
        w = m.group()
        if w.isdigit():
            return "N"
        return "H" if len(w) >= 8 and re.fullmatch("[0-9a-fA-F]+", w) else w

    return re.sub("[A-Za-z0-9_]+", swap, words)


def test_normalise_random_text(spark):
    rnd = random.Random(3)
    pieces = ['"', "'", "\n", " ", "\t", "42", "deadbeef", "DEADBEEF01", "a1", "x_9", "::", "é", "word", "0x1f", " ", ","]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 25))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", X.normalise_error_text(F.col("t")).alias("n")).collect():
        assert r["n"] == plain_normalise(texts[r["i"]]), texts[r["i"]]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_fingerprints(spark):
    lit = F.lit
    same = [X.message_fingerprint(lit("api"), lit(m)) for m in ('user 1 said "a"', 'user 22 said "bb"')]
    assert one(spark, same[0]) == one(spark, same[1]) != one(spark, X.message_fingerprint(lit("web"), lit('user 1 said "a"')))
    frames = F.array(F.struct(lit("m").alias("module"), lit("f").alias("function"), lit("a.py").alias("filename")))
    none = F.array().cast("array<struct<module:string,function:string,filename:string>>")
    assert one(spark, X.exception_fingerprint(lit("E"), lit("id 5"), frames)) == one(spark, X.exception_fingerprint(lit("E"), lit("id 6"), frames))
    assert one(spark, X.exception_fingerprint(lit("E"), lit("x"), frames)) != one(spark, X.exception_fingerprint(lit("E"), lit("x"), none))
    assert len(one(spark, X.client_fingerprint(F.array(lit("a"), lit("b"))))) == 16


def test_truncate_stack(spark):
    t = one(spark, X.truncate_stack(F.lit("a\nb\nc\nd"), 2, 100))
    assert (t["stack"], t["truncated"]) == ("a\nb", True)
    t = one(spark, X.truncate_stack(F.lit("abc\n"), 5, 2))
    assert (t["stack"], t["truncated"]) == ("ab", True)
    assert not one(spark, X.truncate_stack(F.lit("a\nb\n"), 2, 10))["truncated"]


def test_globs(spark):
    t = spark.createDataFrame([("a.b",), ("axb",), ("a%b",), ("a_b",)], "s string")
    assert {r["s"] for r in t.filter(X.glob_match(F.col("s"), "a?b")).collect()} == {"a.b", "axb", "a%b", "a_b"}
    assert {r["s"] for r in t.filter(X.glob_match(F.col("s"), "a.*")).collect()} == {"a.b"}
    assert {r["s"] for r in t.filter(F.col("s").like(X.glob_like("a%*"))).collect()} == {"a%b"}
    assert {r["s"] for r in t.filter(X.contains_ci(F.col("s"), "A_")).collect()} == {"a_b"}


def test_upsert_resolve_regress(spark):
    first = C.fold_error_groups(logs(spark, {"msg": "one", "stack": "s1"}))
    groups = C.new_groups(first)
    second = C.fold_error_groups(logs(spark, {"msg": "two", "at": 5, "stack": "s1"}))
    assert C.group_transitions(groups.limit(0), first).first()["transition"] == "created"
    assert C.group_transitions(groups, second).first()["transition"] == "updated"
    groups = C.merge_error_groups(groups, second)
    r = groups.first()
    assert (r["total_count"], r["title"], r["status"], len(r["samples"])) == (2, "one", "unresolved", 1)
    done = spark.createDataFrame([("f", "resolved", T0)], "fingerprint string, status string, at timestamp")
    groups = C.set_group_status(groups, done)
    assert groups.first()["resolved_at"] == T0
    third = C.fold_error_groups(logs(spark, {"level": "fatal", "at": 9}))
    assert C.group_transitions(groups, third).first()["transition"] == "regressed"
    assert C.group_transitions(groups, second, "fatal").count() == 0
    r = C.merge_error_groups(groups, third).first()
    assert (r["total_count"], r["status"], r["resolved_at"], r["level"]) == (3, "unresolved", None, "fatal")
    late = C.fold_error_groups(logs(spark, {"at": -60}))
    r = C.merge_error_groups(C.merge_error_groups(groups, third), late).first()
    assert r["first_seen"] == T0 - timedelta(hours=1) and r["level"] == "fatal"


def test_sample_rotation(spark):
    groups = None
    for i, name in enumerate(["one", "two", "three", "four", "two"][:4]):
        fold = C.fold_error_groups(logs(spark, {"stack": f"stack {name}", "at": i}))
        groups = C.new_groups(fold) if groups is None else C.merge_error_groups(groups, fold)
    r = groups.first()
    assert [s["stack"] for s in r["samples"]] == ["stack one", "stack three", "stack four"]
    assert [s["variant_hash"] for s in r["samples"]] == r["variant_hashes"]
    again = C.merge_error_groups(groups, C.fold_error_groups(logs(spark, {"stack": "stack one"}))).first()
    assert [s["stack"] for s in again["samples"]] == ["stack one", "stack three", "stack four"]


def test_fold_keeps_three_first_variants(spark):
    rows = [{"stack": f"v{chr(97 + i % 5)}"} for i in range(20)] + [{"level": "info", "stack": "z"}, {"fp": "", "stack": "q"}]
    r = C.fold_error_groups(logs(spark, *rows)).collect()
    assert len(r) == 1 and r[0]["count"] == 20 and [s["stack"] for s in r[0]["samples"]] == ["va", "vb", "vc"]


def test_reconcile_and_list(spark):
    base = C.new_groups(C.fold_error_groups(logs(spark, {}, {"fp": "g", "msg": "Other thing"})))
    groups = base.withColumn("total_count", F.lit(99).cast("long"))
    kept = logs(spark, {}, {}, {})
    counts = {r["fingerprint"]: r["total_count"] for r in C.reconcile_groups(groups, kept).collect()}
    assert counts == {"f": 3, "g": 99}
    now = T0 + timedelta(hours=1)
    assert C.list_groups(groups, now, text="other").first()["fingerprint"] == "g"
    assert C.list_groups(groups, now, status="resolved").count() == 0
    assert C.list_groups(groups, now, status="all").count() == 2
    assert C.list_groups(groups, now, window_seconds=60).count() == 0
    page = C.list_groups(groups, now, limit=1, offset=1).first()
    assert page["total_matched"] == 2
    detail = C.group_detail(groups, C.error_minutes(kept), "f", now).first()
    assert [p["count"] for p in detail["spark"]] == [1, 1, 1]
    gone = spark.createDataFrame([("g", "deleted", T0)], "fingerprint string, status string, at timestamp")
    assert C.set_group_status(groups, gone).count() == 1


def test_missing_fingerprints(spark):
    df = logs(spark, {"fp": None}, {"fp": None, "level": "info"}, {"fp": "given"})
    got = [r["fingerprint"] for r in C.with_fingerprint(df).orderBy("event_key").collect()]
    assert len(got[0]) == 16 and got[1:] == [None, "given"]

"""Alert rules: observed values, escalation, history, validation.

A rule is a dict::

    {"rule_id": 1, "name": "errors", "metric": "error_rate",
     "condition": {"type": "threshold", "window_secs": 300,
                   "thresholds": [{"comparator": ">=", "value": 0.1, "severity": "warning"}]}}

Condition types are threshold, count (with a ``filter`` predicate spec), error_group_threshold
and anomaly. Rules are configuration, so their number is small; all rules on one table are
answered by one pass over it.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from logspark.functions.levels import anomaly_rank
from logspark.operators.rollups import LATENCY_METRICS, SITE_METRIC, metric_columns
from logspark.plans.predicates import PredicateError, compile_predicate

COMPARATORS = (">", ">=", "<", "<=", "==", "=")
WINDOW_SECONDS = 300
COOLDOWN_SECONDS = 900
EQUAL_WITHIN = 1e-9
KINDS = ("threshold", "count", "error_group_threshold", "anomaly")
_RANKS = {"critical": 3, "high": 2, "medium": 1}

RULE_SCHEMA = (
    "rule_id bigint, name string, metric string, kind string, window_secs bigint, "
    "cooldown_secs bigint, min_severity string, subject string, "
    "entries array<struct<comparator:string,value:double,severity:string,text:string>>, error string"
)
STATE_SCHEMA = "rule_id bigint, last_severity string, last_fired_at timestamp"


def compare(value: Column, comparator: Column, limit: Column) -> Column:
    """NULL for an unknown comparator."""
    return (
        F.when(comparator == ">", value > limit)
        .when(comparator == ">=", value >= limit)
        .when(comparator == "<", value < limit)
        .when(comparator == "<=", value <= limit)
        .when(comparator.isin("==", "="), F.abs(value - limit) < EQUAL_WITHIN)
    )


def entries_of(condition: dict) -> list[dict]:
    """Escalation steps in order; a single limit counts as one step named ``alert``."""
    kind = condition["type"]
    steps = condition.get("thresholds") or []
    if kind == "error_group_threshold" or not steps:
        limit = condition.get("count" if kind == "count" else "value", 0.0)
        default = ">=" if kind in ("count", "error_group_threshold") else ""
        steps = [{"comparator": condition.get("comparator", default), "value": limit, "severity": "alert"}]
    return [
        {
            "comparator": s["comparator"],
            "value": float(s["value"]),
            "severity": s.get("severity", "alert"),
            "text": plain_number(float(s["value"])),
        }
        for s in steps
    ]


def plain_number(value: float) -> str:
    """The shortest exact decimal, without an exponent."""
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def known_metric(metric: str) -> bool:
    site = metric.removeprefix(SITE_METRIC)
    if metric.startswith(SITE_METRIC):
        return bool(site) and len(site) <= 64 and "'" not in site
    return metric in ("volume", "error_rate", *LATENCY_METRICS)


def validate_rule(rule: dict, log_schema: T.StructType | None = None, promoted=()) -> list[str]:
    """Problems of one rule; an empty list means it can be saved."""
    problems = []
    name = str(rule.get("name", "")).strip()
    if not 1 <= len(name) <= 128:
        problems.append("name must be 1..128 characters")
    condition = rule.get("condition") or {}
    kind = condition.get("type")
    if kind not in KINDS:
        return [*problems, f"unknown condition {kind!r}"]
    if kind != "anomaly":
        for i, step in enumerate(entries_of(condition)):
            if step["comparator"] not in COMPARATORS:
                problems.append(f"thresholds[{i}]: unknown comparator '{step['comparator']}'")
            if not str(step["severity"]).strip():
                problems.append(f"thresholds[{i}]: severity must not be empty")
    if kind == "count" and log_schema is not None:
        try:
            compile_predicate(condition.get("filter"), log_schema, promoted)
        except PredicateError as e:
            problems.append(f"invalid filter: {e}")
    if kind in ("threshold", "anomaly"):
        metric = str(rule.get("metric") or "").strip()
        if not metric:
            problems.append("metric is required")
        elif kind == "threshold" and not known_metric(metric):
            problems.append(f"unsupported metric '{metric}'")
    return problems


def validate_rules(spark: SparkSession, rules: list[dict], log_schema: T.StructType) -> DataFrame:
    rows = [(int(r["rule_id"]), r.get("name"), validate_rule(r, log_schema)) for r in rules]
    return spark.createDataFrame(rows, "rule_id bigint, name string, errors array<string>")


def rule_table(spark: SparkSession, rules: list[dict], log_schema: T.StructType, promoted=()) -> DataFrame:
    rows = []
    for r in rules:
        problems = validate_rule(r, log_schema, promoted)
        c = r.get("condition") or {}
        kind = c.get("type", "")
        subject = {
            "count": f"count of {c.get('filter')}",
            "error_group_threshold": f"events of group {c['fingerprint']}" if c.get("fingerprint") else "events of all error groups",
        }.get(kind, r.get("metric") or "")
        steps = [] if problems or kind == "anomaly" else entries_of(c)
        rows.append(
            (
                int(r["rule_id"]), r.get("name"), r.get("metric"), kind,
                int(c.get("window_secs", WINDOW_SECONDS)), int(c.get("cooldown_secs", COOLDOWN_SECONDS)),
                c.get("min_severity", "high"), subject,
                [(s["comparator"], s["value"], s["severity"], s["text"]) for s in steps],
                "; ".join(problems) or None,
            )
        )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _one_pass(table: DataFrame, values: dict[int, Column]) -> DataFrame:
    """(rule_id, value) rows from one aggregate per rule over a single scan."""
    if not values:
        return None
    one = table.agg(*[v.cast("double").alias(f"r{i}") for i, v in values.items()])
    pairs = F.array(
        *[F.struct(F.lit(i).cast("long").alias("rule_id"), F.col(f"r{i}").alias("value")) for i in values]
    )
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def _since(rule: dict, now: datetime) -> Column:
    return F.lit(now - timedelta(seconds=int(rule["condition"].get("window_secs", WINDOW_SECONDS))))


def observed_values(
    rules: list[dict], now: datetime, logs: DataFrame, rollup: DataFrame, web_rollup: DataFrame | None = None,
    promoted=(),
) -> DataFrame:
    """(rule_id, value) of every valid rule except anomaly rules."""
    metrics, sites, counts, windows = {}, {}, {}, [WINDOW_SECONDS]
    for r in rules:
        if validate_rule(r, logs.schema, promoted):
            continue
        c, i, since = r["condition"], int(r["rule_id"]), _since(r, now)
        inside = F.col("ts") >= since
        if c["type"] == "threshold" and r["metric"].startswith(SITE_METRIC):
            site = r["metric"].removeprefix(SITE_METRIC)
            hit = (F.col("bucket") >= since) & (F.col("site_id") == site)
            sites[i] = F.coalesce(F.sum(F.when(hit, F.col("pageviews"))), F.lit(0))
        elif c["type"] == "threshold":
            metrics[i] = metric_columns([r["metric"]], since)[r["metric"]]
        elif c["type"] == "count":
            counts[i] = F.count_if(inside & compile_predicate(c["filter"], logs.schema, promoted))
            windows.append(int(c.get("window_secs", WINDOW_SECONDS)))
        elif c["type"] == "error_group_threshold":
            levels = ["fatal"] if c.get("min_level") == "fatal" else ["error", "fatal"]
            hit = inside & F.col("fingerprint").isNotNull() & F.col("level").isin(levels)
            if c.get("fingerprint"):
                hit = hit & (F.col("fingerprint") == c["fingerprint"])
            counts[i] = F.count_if(hit)
            windows.append(int(c.get("window_secs", WINDOW_SECONDS)))
    recent = logs.filter(
        (F.col("ts") >= F.lit(now - timedelta(seconds=max(windows)))) & (F.col("ts") <= F.lit(now))
    )
    parts = [_one_pass(rollup, metrics), _one_pass(web_rollup, sites), _one_pass(recent, counts)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return logs.sparkSession.createDataFrame([], "rule_id bigint, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def escalate(rules: DataFrame, observed: DataFrame, state: DataFrame, now: datetime) -> DataFrame:
    """Severity of every rule now and whether it changed since the last firing.

    The last breached step wins, ``ok`` stands for none. Only a change fires, so a rule that
    stays bad stays silent.
    """
    breached = F.filter(
        "entries", lambda e: F.coalesce(compare(F.col("value"), e["comparator"], e["value"]), F.lit(False))
    )
    hit = F.try_element_at(breached, F.lit(-1))
    rows = (
        rules.filter(F.col("kind") != "anomaly")
        .join(observed, "rule_id", "left")
        .join(state, "rule_id", "left")
        .withColumn("hit", hit)
        .withColumn("severity", F.coalesce("hit.severity", F.lit("ok")))
        .withColumn("before", F.coalesce("last_severity", F.lit("ok")))
    )
    shown = F.format_string("%.3f", "value")
    window = F.col("window_secs").cast("string")
    measured = F.concat(F.col("subject"), F.lit(" was "), shown, F.lit(" in "), window, F.lit(" s"))
    recovered = F.concat(F.col("name"), F.lit(": ok after "), F.col("before"), F.lit("; "), measured)
    crossed = F.concat(
        F.col("name"), F.lit(": "), F.col("severity"), F.lit("; "), measured, F.lit(", limit "), F.col("hit.comparator"), F.lit(" "), F.col("hit.text"),
    )
    valid = F.col("error").isNull()
    fired = valid & F.col("value").isNotNull() & (F.col("severity") != F.col("before"))
    return rows.select(
        "rule_id", "name", "metric", F.lit(now).alias("ts"), "value",
        F.when(valid, F.col("severity")).alias("severity"),
        "before",
        F.coalesce(fired, F.lit(False)).alias("fired"),
        F.when(fired, F.when(F.col("severity") == "ok", recovered).otherwise(crossed)).alias("message"),
        "error",
    )


def anomaly_firings(rules: DataFrame, anomalies: DataFrame, state: DataFrame, now: datetime) -> DataFrame:
    """Anomaly rules: the newest finding of the window that is severe enough, after the cooldown."""
    wanted = rules.filter((F.col("kind") == "anomaly") & F.col("error").isNull())
    recent = wanted.join(anomalies.select("metric", F.col("ts").alias("seen"), "score",
                                          F.col("severity").alias("found")), "metric").filter(
        F.unix_micros(F.lit(now)) - F.unix_micros("seen") <= F.col("window_secs") * 1_000_000
    )
    newest = W.partitionBy("rule_id").orderBy(F.col("seen").desc(), F.col("score").desc())
    severe = (
        recent.filter(anomaly_rank(F.col("found")) >= anomaly_rank(F.col("min_severity")))
        .withColumn("nth", F.row_number().over(newest))
        .filter(F.col("nth") == 1)
        .groupBy("rule_id")
        .agg(F.min_by(F.struct("name", "metric", "window_secs", "cooldown_secs", "score", "found"), "nth").alias("a"))
        .select("rule_id", "a.*")
    )
    cool = F.col("last_fired_at").isNull() | (
        F.unix_seconds(F.lit(now)) - F.unix_seconds("last_fired_at") >= F.greatest("cooldown_secs", F.lit(0))
    )
    message = F.concat(
        F.col("metric"), F.lit(": "), F.col("found"), F.lit(" anomaly of score "), F.format_string("%.2f", "score"),
        F.lit(" in "), F.col("window_secs").cast("string"), F.lit(" s"),
    )
    return severe.join(state, "rule_id", "left").select(
        "rule_id", "name", "metric", F.lit(now).alias("ts"), F.col("score").alias("value"),
        F.col("found").alias("severity"), F.coalesce("last_severity", F.lit("ok")).alias("before"),
        F.coalesce(cool, F.lit(True)).alias("fired"), F.when(cool, message).alias("message"),
        F.lit(None).cast("string").alias("error"),
    )


def evaluate(
    spark: SparkSession, rules: list[dict], now: datetime, *, logs: DataFrame, rollup: DataFrame,
    web_rollup: DataFrame | None = None, anomalies: DataFrame | None = None,
    state: DataFrame | None = None, promoted=(),
) -> DataFrame:
    """One row per evaluated rule with its severity, message and error."""
    table = rule_table(spark, rules, logs.schema, promoted)
    state = state if state is not None else spark.createDataFrame([], STATE_SCHEMA)
    out = escalate(table, observed_values(rules, now, logs, rollup, web_rollup, promoted), state, now)
    if anomalies is not None:
        out = out.unionByName(anomaly_firings(table, anomalies, state, now))
    return out


def firing_rows(evaluated: DataFrame) -> DataFrame:
    """Rows to append to the alert history."""
    return evaluated.filter("fired").select(
        "rule_id", "ts", "metric", "value", "message", F.lit(False).alias("notified"), "error",
        F.lit(None).cast("string").alias("channel"), "severity",
    )


def next_state(state: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Rule state after an evaluation; ``ok`` is kept as NULL."""
    fired = evaluated.filter("fired").select(
        "rule_id", F.nullif("severity", F.lit("ok")).alias("s"), F.col("ts").alias("t"), F.lit(True).alias("f")
    )
    return state.join(fired, "rule_id", "full_outer").select(
        "rule_id",
        F.when(F.col("f"), F.col("s")).otherwise(F.col("last_severity")).alias("last_severity"),
        F.when(F.col("f"), F.col("t")).otherwise(F.col("last_fired_at")).alias("last_fired_at"),
    )


def severity_history(series: DataFrame, keys: list[str], entries: list[dict]) -> DataFrame:
    """Severity changes along a series (keys, ts, value) under one rule's steps.

    The first row of a series fires when it is not ``ok``.
    """
    severity = F.lit("ok")
    for e in entries:
        limit = F.lit(float(e["value"]))
        severity = F.when(compare(F.col("value"), F.lit(e["comparator"]), limit), F.lit(e["severity"])).otherwise(severity)
    by_time = W.partitionBy(*keys).orderBy("ts")
    return (
        series.withColumn("severity", severity)
        .withColumn("before", F.coalesce(F.lag("severity").over(by_time), F.lit("ok")))
        .filter(F.col("severity") != F.col("before"))
        .select(*keys, "ts", "value", "before", "severity")
    )


def rule_history(events: DataFrame, limit: int | None = None) -> DataFrame:
    """The firings of every rule, of each the newest ``limit`` if it is given."""
    if limit is None:
        return events
    newest = W.partitionBy("rule_id").orderBy(F.col("ts").desc(), "severity")
    return events.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= limit).drop("_nth")


def set_rule_status(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or reject pending rules; ``decisions`` has rule_id and approve."""
    picked = decisions.groupBy("rule_id").agg(F.bool_or("approve").alias("_approve"))
    pending = (F.col("status") == "pending_approval") & F.col("_approve").isNotNull()
    return (
        rules.join(picked, "rule_id", "left")
        .withColumn(
            "status",
            F.when(pending, F.when(F.col("_approve"), "active").otherwise("rejected")).otherwise(F.col("status")),
        )
        .drop("_approve")
    )

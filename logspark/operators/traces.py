"""Traces built from span rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logspark.operators.rollups import attribute, duration_ms
from logspark.plans.ranges import first_rows, in_log_range



def list_traces(
    logs: DataFrame, start: datetime, end: datetime, predicate: Column | None = None, limit: int | None = None
) -> DataFrame:
    """One row per trace, newest first. ``service`` and ``root_name`` are alphabetic minima.

    Spans are pre-aggregated before the shuffle, so one huge trace moves as few rows as others.
    """
    spans = logs.filter(
        (F.col("protocol") == "otlp_span")
        & (F.coalesce("trace_id", F.lit("")) != "")
        & in_log_range(F.col("ts"), start, end)
    )
    if predicate is not None:
        spans = spans.filter(predicate)
    return (
        spans.select("trace_id", "ts", "level", "service", "message", duration_ms().alias("d"))
        .groupBy("trace_id")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("span_count"),
            F.count_if(F.col("level") == "error").alias("error_count"),
            F.max("d").alias("duration_ms"),
            F.min("service").alias("service"),
            F.min("message").alias("root_name"),
        )
        .orderBy(F.col("start_ts").desc(), "trace_id")
        .transform(first_rows, limit)
    )


def trace_spans(logs: DataFrame, trace_id: str, limit: int | None = None) -> DataFrame:
    """Spans of one trace in start order with the span fields lifted."""
    keys = [c for c in ("event_key",) if c in logs.columns]
    return (
        logs.filter((F.col("protocol") == "otlp_span") & (F.col("trace_id") == trace_id))
        .orderBy("ts", *keys)
        .transform(first_rows, limit)
        .select(
            "ts", "service", "level", F.col("message").alias("name"), "span_id",
            attribute("parent_span_id").alias("parent_span_id"),
            attribute("span_kind").alias("span_kind"),
            attribute("status_code").alias("status_code"),
            duration_ms().alias("duration_ms"),
            "attributes",
        )
    )


def correlate_trace(web: DataFrame, logs: DataFrame, trace_id: str, limit: int | None = None) -> DataFrame:
    """Web events and logs that share a trace id, of each the first ``limit`` rows if it is given."""
    if not trace_id or len(trace_id) > 64:
        raise ValueError("bad trace id")
    text = F.lit(None).cast("string")

    def first(rows: DataFrame) -> DataFrame:
        keys = [c for c in ("event_key",) if c in rows.columns]
        return first_rows(rows.filter(F.col("trace_id") == trace_id).orderBy("ts", *keys), limit)

    events = first(web).select(
        F.lit("web_event").alias("kind"), "ts", "site_id", "event", "name", "path", "country",
        "device", text.alias("service"), text.alias("level"), text.alias("message"),
    )
    lines = first(logs).select(
        F.lit("log").alias("kind"), "ts", text.alias("site_id"), text.alias("event"),
        text.alias("name"), text.alias("path"), text.alias("country"), text.alias("device"),
        "service", "level", "message",
    )
    return events.unionByName(lines)

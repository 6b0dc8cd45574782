"""Records of log shippers: datagram logs, collector events, forwarded records, audit events,
container lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.levels import syslog_level
from logspark.functions.text import blank_to_null, glob_match
from logspark.functions.timestamps import epoch_ts, rfc3339_ts
from logspark.normalise.common import Promoted, as_input, log_rows, only

MAX_CHUNKS = 128
MAX_CHUNKED_BYTES = 8 * 1024 * 1024
# Fields of the datagram format that are not extras.
DATAGRAM_FIELDS = ["version", "host", "short_message", "full_message", "timestamp", "level"]
# Audit fields kept as attributes.
AUDIT_FIELDS = [
    "stage", "requestURI", "userAgent", "user", "impersonatedUser", "sourceIPs", "objectRef",
    "responseStatus", "requestObject", "responseObject", "annotations", "authenticationMetadata",
]
AUDIT_SERVICE = "kube-apiserver"


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _no_slash(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "^/+", ""), F.lit(""))


def _present(fields: Column, keys: list[str]) -> Column:
    return F.map_filter(fields, lambda k, v: J.one_of(k, keys) & (F.schema_of_variant(v) != "VOID"))


def _rows(df: DataFrame, fixed: dict[str, Column], extras: Column, promoted, drop_keys, keep) -> DataFrame:
    """Fixed fields plus extras (an extra of the same name wins), finished as log rows."""
    fields = J.merge(extras, J.object_of(fixed))
    return log_rows(df.withColumn("fields", fields), promoted, drop_keys, True, keep)


# -- datagram logs ---------------------------------------------------------


def normalise_gelf(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=()) -> DataFrame:
    df = only(as_input(raw).withColumn("g", J.parse_fields(F.col("raw"))), F.col("g").isNotNull())
    g = F.col("g")
    number = F.when(J.kind(g["level"]) == "integer", F.try_variant_get(g["level"], "$", "bigint")).when(
        J.kind(g["level"]) == "number", F.lit(6)
    )
    level = F.coalesce(syslog_level(number), blank_to_null(J.as_text(g["level"])), F.lit("info"))
    service = F.coalesce(_no_slash(J.as_text(g["_container_name"])), J.as_text(g["facility"]))
    stamp = F.when(
        J.kind(g["timestamp"]).isin("integer", "number"), g["timestamp"]
    ).otherwise(_iso(F.col("receive_ts")).cast("variant"))
    fixed = {
        "message": F.coalesce(J.as_text(g["short_message"]), F.lit("")),
        "level": level,
        "service": service,
        "host": F.when(J.kind(g["host"]) != "null", g["host"]),
        "ts": stamp,
    }
    full = J.object_of({"full_message": blank_to_null(J.as_text(g["full_message"]))})
    return _rows(df, fixed, J.merge(full, J.without(g, DATAGRAM_FIELDS)), promoted, drop_keys, keep)


def reassemble_chunks(
    chunks: DataFrame, max_total: int = MAX_CHUNKS, max_bytes: int = MAX_CHUNKED_BYTES
) -> DataFrame:
    """(msg_id, seq, total, payload) to whole messages (msg_id, payload).

    Chunks of a bad shape are ignored; a message with parts missing, with two declared totals
    or above the byte limit gives no row. Duplicates of a part are folded before the shuffle,
    so a message gathers at most ``max_total`` parts.
    """
    good = chunks.filter(
        F.col("total").between(1, max_total) & (F.col("seq") >= 0) & (F.col("seq") < F.col("total"))
    )
    parts = good.groupBy("msg_id", "seq").agg(
        F.max("payload").alias("payload"), F.min("total").alias("t0"), F.max("total").alias("t1")
    )
    return (
        parts.groupBy("msg_id")
        .agg(
            F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length("payload")).alias("bytes"),
            F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("p"),
        )
        .filter((F.col("t0") == F.col("t1")) & (F.col("n") == F.col("t0")) & (F.col("bytes") <= max_bytes))
        .select("msg_id", F.array_join(F.transform("p", lambda x: x["payload"]), "").alias("payload"))
    )


# -- collector events ------------------------------------------------------


def split_objects(body: Column) -> Column:
    """Concatenated JSON objects as an array of texts.

    Objects are split where a closing brace meets an opening one; pieces that do not parse are
    joined back to their neighbours, so braces inside strings do no harm.
    """
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    pieces = F.split(F.regexp_replace(trimmed, r"\}(\s*)\{", "}\u0001$1{"), "\u0001")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        def taken(whole: Column) -> Column:
            closed = F.struct(F.concat(acc["done"], F.array(whole)).alias("done"), F.lit("").alias("open"))
            return F.when(J.parse(whole).isNotNull(), closed).otherwise(F.struct(acc["done"].alias("done"), whole.alias("open")))

        return J.let(F.concat(acc["open"], piece), taken)

    many = J.let(
        F.aggregate(pieces, start, step),
        lambda folded: F.when((folded["open"] == "") & (F.size(folded["done"]) > 0), folded["done"]),
    )
    return F.when(J.parse(trimmed).isNotNull(), F.array(trimmed)).otherwise(many)


def _hec_time(v: Column) -> Column:
    seconds = F.coalesce(F.trim(J.as_text(v)).try_cast("double"), J.as_number(v))
    return J.let(seconds, lambda x: F.when(x >= 0, epoch_ts(x)))


def normalise_hec(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=()) -> DataFrame:
    """Bodies of concatenated collector events.

    A body that is no JSON at all is one plain event; a body that breaks off after some
    events is rejected as a whole.
    """
    df = as_input(raw)
    plain = ~F.col("raw").rlike(r"^\s*[\[{]")
    texts = F.when(plain, F.array(F.lit(None).cast("string"))).otherwise(split_objects(F.col("raw")))
    each = df.select("*", F.explode(texts).alias("event_text"))
    each = each.withColumn("h", F.coalesce(J.parse_fields(F.col("event_text")), F.create_map().cast(J.FIELDS)))
    h = F.col("h")
    # Columns of their own, so that each is computed once however many fields are read from it.
    each = each.withColumns({"event": h["event"], "inner_event": J.object_fields(h["event"]), "own_fields": J.object_fields(h["fields"])})
    event, inner = F.col("event"), F.col("inner_event")
    kind = J.kind(event)
    line = F.when(J.kind(inner["line"]) != "null", J.as_json(inner["line"]))
    message = (
        F.when(F.col("event_text").isNull(), F.col("raw"))
        .when(kind == "object", F.coalesce(line, F.lit("")))
        .when(kind == "null", F.lit(""))
        .otherwise(F.coalesce(J.as_json(event), F.lit("")))
    )
    about = J.object_of({k: J.as_text(inner[k]) for k in ("source", "tag")})
    hec = J.object_of({f"hec_{k}": J.as_text(h[k]) for k in ("source", "sourcetype", "index")})
    extras = J.merge(
        F.col("own_fields"), J.merge(hec, J.merge(J.object_fields(inner["attrs"]), about))
    )
    each = each.withColumns({"extras": extras, "text": message})
    e = F.col("extras")
    service = F.coalesce(
        blank_to_null(J.as_text(h["sourcetype"])),
        F.regexp_replace(J.as_text(F.col("own_fields")["container_name"]), "^/+", ""),
    )
    fixed = {
        "message": F.col("text"),
        "level": F.when(J.as_text(e["source"]) == "stderr", "error").otherwise("info"),
        "service": service,
        "ts": _iso(F.coalesce(_hec_time(h["time"]), F.col("receive_ts"))),
        "host": J.as_text(h["host"]),
    }
    return _rows(each, fixed, e, promoted, drop_keys, keep)


# -- forwarded records -----------------------------------------------------


def normalise_forward(raw: DataFrame, promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=()) -> DataFrame:
    """``[tag, time, record, option]`` and ``[tag, [[time, record], ...], option]`` as JSON.

    Every entry of a batch becomes a row.
    """
    df = as_input(raw).withColumn("parts", F.try_variant_get(J.parse(F.col("raw")), "$", "array<variant>"))
    second = F.get("parts", 1)
    pair = lambda t, r: F.struct(t.alias("time"), r.alias("record"))
    batch = F.transform(
        F.try_variant_get(second, "$", "array<variant>"),
        lambda e: pair(
            F.try_variant_get(e, "$[0]", "variant"), F.try_variant_get(e, "$[1]", "variant")
        ),
    )
    single = F.array(pair(second, F.get("parts", 2)))
    entries = F.when(J.kind(second) == "array", batch).otherwise(single)
    each = df.select("*", F.explode(entries).alias("entry")).withColumn("r", J.object_fields(F.col("entry.record")))
    each = only(each, F.col("r").isNotNull())
    r = F.col("r")
    tag = F.coalesce(blank_to_null(J.as_text(F.get("parts", 0))), F.lit(""))
    text = lambda k: F.when(J.kind(r[k]) != "null", J.as_json(r[k]))
    fixed = {
        "message": F.coalesce(text("log"), text("message"), text("msg"), F.lit("")),
        "level": F.when(J.as_text(r["source"]) == "stderr", "error").otherwise("info"),
        "service": F.coalesce(_no_slash(J.as_text(r["container_name"])), F.nullif(tag, F.lit("")), F.lit("unknown")),
        "ts": _iso(F.coalesce(epoch_ts(J.as_number(F.col("entry.time"))), F.col("receive_ts"))),
    }
    tagged = J.object_of({"fluentd_tag": F.nullif(tag, F.lit(""))})
    extras = J.merge(tagged, J.without(r, ["log", "message", "msg"]))
    return _rows(each, fixed, extras, promoted, drop_keys, keep)


# -- audit events ----------------------------------------------------------


def normalise_k8s_audit(
    raw: DataFrame, omit_stages: tuple[str, ...] = (), promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=()
) -> DataFrame:
    """Audit events from an event list, an array or a single object."""
    v = J.parse(F.col("raw"))
    df = as_input(raw).withColumn("v", v)
    items = F.try_variant_get("v", "$.items", "array<variant>")
    top = F.when(J.kind(F.col("v")) == "array", F.try_variant_get("v", "$", "array<variant>"))
    one = F.when(
        F.try_variant_get("v", "$.auditID", "variant").isNotNull()
        | F.try_variant_get("v", "$.verb", "variant").isNotNull(),
        F.array("v"),
    )
    each = df.select("*", F.explode(F.coalesce(items, top, one)).alias("ev"))
    each = only(each.withColumn("a", J.object_fields(F.col("ev"))), F.col("a").isNotNull())
    a = F.col("a")
    stage = F.coalesce(J.as_text(a["stage"]), F.lit(""))
    if omit_stages:
        each = each.filter(~stage.isin(list(omit_stages)))
    # Columns of their own, so that each is computed once however many fields are read from it.
    each = each.withColumns({"status": J.object_fields(a["responseStatus"]), "ref": J.object_fields(a["objectRef"]), "stage_name": stage})
    status, ref, stage = F.col("status"), F.col("ref"), F.col("stage_name")
    of_code = F.when(J.kind(status["code"]) == "integer", F.try_variant_get(status["code"], "$", "bigint"))
    parts = [F.coalesce(J.as_text(ref[k]), F.lit("")).alias(k) for k in ("apiGroup", "resource", "namespace", "name")]
    each = each.withColumns({"code": of_code, "parts": F.struct(*parts)})
    code = F.col("code")
    part = lambda k: F.col("parts")[k]
    target = F.when(
        ref.isNotNull(),
        F.concat(
            F.when(part("apiGroup") != "", F.concat(part("apiGroup"), F.lit("/"))).otherwise(""),
            part("resource"),
            F.when(part("namespace") != "", F.concat(F.lit(" "), part("namespace"), F.lit("/")))
            .when(part("name") != "", F.lit(" "))
            .otherwise(""),
            part("name"),
        ),
    ).otherwise(F.coalesce(J.as_text(a["requestURI"]), F.lit("?")))
    message = F.concat(
        F.coalesce(J.as_text(a["verb"]), F.lit("unknown")), F.lit(" "), target,
        F.when(code.isNotNull(), F.concat(F.lit(" → "), code.cast("string"))).otherwise(""),
        F.when(stage == "ResponseStarted", F.lit(" (streaming response started)")).otherwise(""),
    )
    level = F.when(stage == "Panic", "fatal").when(code >= 500, "error").when(code >= 400, "warn").otherwise("info")
    stamp = F.coalesce(
        rfc3339_ts(F.coalesce(J.as_text(a["stageTimestamp"]), J.as_text(a["requestReceivedTimestamp"]))),
        F.col("receive_ts"),
    )
    ips = F.try_variant_get(a["sourceIPs"], "$", "array<variant>")
    fixed = {
        "message": message, "level": level, "service": F.lit(AUDIT_SERVICE), "ts": _iso(stamp),
        "trace_id": J.as_text(a["auditID"]), "host": J.as_text(F.try_element_at(ips, F.lit(-1))),
        "audit_level": F.when(J.kind(a["level"]) != "null", a["level"]),
        "response_reason": blank_to_null(J.as_text(status["reason"])),
    }
    return _rows(each, fixed, _present(a, AUDIT_FIELDS), promoted, drop_keys, keep)


# -- container lines -------------------------------------------------------


def normalise_container_lines(
    lines: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
    promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=(),
) -> DataFrame:
    """Lines with their container's labels.

    Columns: receive_ts, protocol, raw and any of container_id, name, image, stream (container
    engines) and namespace, pod, container, node (clusters). Containers are kept when they match
    an ``include`` glob (all when there is none) and no ``exclude`` glob.
    """
    have = set(lines.columns)
    none = F.lit(None).cast("string")
    col = lambda n: blank_to_null(F.col(n)) if n in have else none
    owner = F.coalesce(col("pod"), col("name"))
    keep_row = F.lit(not include)
    for g in include:
        keep_row = keep_row | glob_match(owner, g)
    for g in exclude:
        keep_row = keep_row & ~glob_match(owner, g)
    df = as_input(lines.filter((F.col("raw") != "") & keep_row))
    if "source_addr" not in have:
        df = df.withColumn("source_addr", F.lit(""))
    prefix = F.substring_index("raw", " ", 1)
    stamp = F.when(F.contains("raw", F.lit(" ")), rfc3339_ts(prefix))
    text = F.when(stamp.isNotNull(), F.substring("raw", F.length(prefix) + 2, F.length("raw"))).otherwise(F.col("raw"))
    fixed = {
        "message": text,
        "level": F.when(col("stream") == "stderr", "error").otherwise("info"),
        "service": owner,
        "ts": _iso(F.coalesce(stamp, F.col("receive_ts"))),
        "host": col("node"),
    }
    labels = ["container_id", "image", "stream", "namespace", "pod", "container", "node"]
    return _rows(df, fixed, J.object_of({k: col(k) for k in labels}), promoted, drop_keys, keep)

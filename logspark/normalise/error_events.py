"""Exception events of client libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions import json as J
from logspark.functions.text import (
    ascii_lower,
    client_fingerprint,
    exception_fingerprint,
    message_fingerprint,
    truncate_stack,
    variant_hash,
)
from logspark.functions.timestamps import epoch_ts, rfc3339_ts
from logspark.normalise.common import Promoted, as_input, log_rows, only
from logspark.functions.json import get, items

#: Stands for no limit.
LONGEST = (1 << 31) - 1
# Event members kept under the ``sentry`` attribute.
CONTEXT_FIELDS = [
    "event_id", "user", "request", "tags", "extra", "environment", "release", "dist",
    "server_name", "transaction", "logger", "platform", "sdk", "contexts", "breadcrumbs",
    "modules",
]


def event_level(word: Column) -> Column:
    low = ascii_lower(word)
    return (
        F.when(low == "warning", "warn")
        .when(low.isin("fatal", "critical"), "fatal")
        .when(low.isin("info", "debug"), low)
        .otherwise("error")
    )


def event_ts(v: Column) -> Column:
    return J.let(
        J.kind(v),
        lambda k: F.when(k == "string", rfc3339_ts(J.as_text(v))).when(
            J.one_of(k, ["integer", "number"]), epoch_ts(F.try_variant_get(v, "$", "double"))
        ),
    )


def _text(v: Column, default: str, *path: str) -> Column:
    return F.coalesce(J.as_text(get(v, *path)), F.lit(default))


def _member(frame: Column, default: str, name: str) -> Column:
    return F.coalesce(J.as_text(frame[name]), F.lit(default))


def _first_text(frame: Column, *names: str) -> Column:
    """Text of the first member that is present at all."""
    return J.as_text(F.coalesce(*[frame[n] for n in names]))


def _in_app(frame: Column) -> Column:
    flag = J.let(frame["in_app"], lambda v: F.when(J.kind(v) == "boolean", F.try_variant_get(v, "$", "boolean")))
    return F.coalesce(flag, F.lit(False))


def newest_first(stacktrace: Column) -> Column:
    """The members of each frame; NULL for a frame that is no object."""
    return F.transform(F.reverse(items(stacktrace, "frames")), J.object_fields)


def stack_text(stacktrace: Column, max_frames: int | None = None, max_bytes: int | None = None) -> Column:
    """Frames newest first as ``module.function @ file:line``, application frames marked; whole unless a length is given."""

    def line(f: Column) -> Column:
        function, module = _member(f, "?", "function"), _member(f, "", "module")
        what = J.let(module, lambda m: F.when(m == "", function).otherwise(F.concat(m, F.lit("."), function)))
        file = F.coalesce(_first_text(f, "abs_path", "filename"), F.lit("?"))
        row = J.let(f["lineno"], lambda v: F.when(J.kind(v) == "integer", F.try_variant_get(v, "$", "string")))
        mark = F.when(_in_app(f), " #").otherwise("")
        return F.concat(what, F.lit(" @ "), file, F.lit(":"), F.coalesce(row, F.lit("?")), mark)

    lines = F.array_join(F.transform(newest_first(stacktrace), line), "\n")
    if max_frames is not None or max_bytes is not None:
        lines = truncate_stack(lines, max_frames or LONGEST, max_bytes or LONGEST)["stack"]
    return F.coalesce(lines, F.lit(""))


def fingerprint_frames(stacktrace: Column) -> Column:
    """The newest five application frames, or the newest five of any kind."""
    chosen = J.let(newest_first(stacktrace), lambda frames: J.let(F.filter(frames, _in_app), lambda own: F.when(F.size(own) > 0, own).otherwise(frames)))
    return F.transform(
        F.slice(chosen, 1, 5),
        lambda f: F.struct(
            _member(f, "", "module").alias("module"),
            _member(f, "", "function").alias("function"),
            F.coalesce(_first_text(f, "filename", "abs_path"), F.lit("")).alias("filename"),
        ),
    )


def service_of(project: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for key, name in names.items():
        out = out.when(project == key, F.lit(name))
    return out.when(project.rlike("^[0-9]+$"), F.concat(F.lit("project-"), project)).otherwise(project)


def normalise_error_events(
    raw: DataFrame, project: Column | None = None, projects: dict[str, str] | None = None,
    max_frames: int | None = None, max_bytes: int | None = None,
    promoted: tuple[Promoted, ...] = (), drop_keys=(), keep=(),
) -> DataFrame:
    """JSON exception events to log rows; ``project`` names the sending application."""
    project = project if project is not None else F.lit("")
    df = as_input(raw).withColumns(
        {"ev": J.parse_fields(F.col("raw")), "svc": service_of(project, projects or {})}
    )
    df = only(df, F.col("ev").isNotNull())
    ev = F.col("ev")

    def choice(values: Column) -> Column:
        with_stack = F.filter(values, lambda x: get(x, "stacktrace").isNotNull())
        return F.coalesce(F.try_element_at(with_stack, F.lit(-1)), F.try_element_at(values, F.lit(-1)))

    chosen = J.let(items(ev["exception"], "values"), choice)
    thread = F.get(items(ev["threads"], "values"), 0)
    df = df.withColumn("exc", chosen).withColumn(
        "st",
        F.when(F.col("exc").isNotNull(), get(F.col("exc"), "stacktrace")).otherwise(
            F.coalesce(ev["stacktrace"], get(thread, "stacktrace"))
        ),
    )
    exc, found = F.col("exc"), F.col("exc").isNotNull()
    plain = F.coalesce(J.as_text(ev["message"]), J.as_text(get(ev["message"], "formatted")), F.lit(""))
    own = F.filter(F.transform(items(ev["fingerprint"], ), lambda v: J.as_text(v)), lambda t: t.isNotNull())
    # Columns of their own, so that each is computed once however often it is read.
    df = df.withColumns(
        {
            "exc_kind": _text(exc, "UnknownError", "type"), "exc_value": _text(exc, "", "value"),
            "frames": stack_text(F.col("st"), max_frames, max_bytes), "plain_text": plain, "own": own,
        }
    )
    kind, value, frames, plain, own = (F.col(n) for n in ("exc_kind", "exc_value", "frames", "plain_text", "own"))
    title = (
        F.when(found & (value == ""), kind)
        .when(found, F.concat(kind, F.lit(": "), value))
        .when(plain == "", "Unknown error")
        .otherwise(plain)
    )
    stack = F.when(found & (frames != ""), F.concat(kind, F.lit(": "), value, F.lit("\n"), frames)).otherwise(frames)
    df = df.withColumns({"title": title, "stack": stack, "kind": F.when(found, kind), "value": value})
    fingerprint = (
        F.when(F.size(own) > 0, client_fingerprint(own))
        .when(found, exception_fingerprint(kind, value, fingerprint_frames(F.col("st"))))
        .when(F.col("stack") != "", variant_hash(F.col("stack")))
        .otherwise(message_fingerprint(F.col("svc"), F.col("title")))
    )
    context = F.map_filter(ev, lambda k, v: J.one_of(k, CONTEXT_FIELDS) & (F.schema_of_variant(v) != "VOID"))
    fields = J.object_of(
        {
            "ts": F.date_format(F.coalesce(event_ts(ev["timestamp"]), F.col("receive_ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
            "service": F.col("svc"),
            "level": event_level(J.as_text(ev["level"])),
            "msg": F.col("title"),
            "fingerprint": fingerprint,
            "exception_type": F.col("kind"),
            "stack": F.col("stack"),
            "sentry": F.to_variant_object(context),
        }
    )
    return log_rows(df.withColumn("fields", fields), promoted, drop_keys, keep=keep)

"""Keyed state with timers: severities of alert rules, and chunked messages that time out.

Both need the RocksDB state store (``prepare_state``). State is kept per rule or bucket of messages, changes are
written to the query's checkpoint, and nothing is rewritten for keys without new rows or due timers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logspark.normalise.shippers import MAX_CHUNKED_BYTES, MAX_CHUNKS
from logspark.operators.alerts import EQUAL_WITHIN, entries_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ms(column: str):
    return F.unix_millis(F.col(column))


# -- alert severities ----------------------------------------------------------

SEVERITY_DDL = "rule_id long, ts timestamp, value double, before string, severity string"


def severity_of(value: float | None, entries: list[dict]) -> str:
    """The last step that the value breaches, ``ok`` without one."""
    out = "ok"
    for e in entries if value is not None else []:
        limit = e["value"]
        hit = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit,
               "==": abs(value - limit) < EQUAL_WITHIN, "=": abs(value - limit) < EQUAL_WITHIN}
        out = e["severity"] if hit.get(e["comparator"], False) else out
    return out


class SeverityKeeper(StatefulProcessor):
    """Observations of one rule wait for their time; then a change of severity is a firing.

    After a firing other than a recovery the rule is quiet for its cooldown, a timer of its own.
    """

    def __init__(self, entries: dict[int, list[dict]], cooldowns: dict[int, int]):
        self.entries, self.cooldowns = entries, cooldowns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "severity string")
        self.quiet = handle.getValueState("quiet", "until long")
        self.waiting = handle.getMapState("waiting", "at long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for at, value in zip(part["at_ms"].tolist(), part["value"].tolist()):
                if at == at:
                    self.waiting.updateValue((int(at),), (None if value != value else value,))
                    self.handle.registerTimer(int(at))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, rule = expiredTimerInfo.getExpiryTimeInMs(), int(key[0])
        if self.quiet.exists() and self.quiet.get()[0] <= at:
            self.quiet.clear()
        if not self.waiting.containsKey((at,)):
            return
        value = self.waiting.getValue((at,))[0]
        self.waiting.removeKey((at,))
        before = self.last.get()[0] if self.last.exists() else "ok"
        now = severity_of(value, self.entries.get(rule, []))
        if now == before or (self.quiet.exists() and now != "ok"):
            return
        self.last.update((now,))
        cooldown = self.cooldowns.get(rule, 0) * 1000
        if cooldown and now != "ok":
            self.quiet.update((at + cooldown,))
            self.handle.registerTimer(at + cooldown)
        yield pd.DataFrame({"rule_id": [rule], "ts": [pd.Timestamp(at, unit="ms")], "value": [value], "before": [before], "severity": [now]})

    def close(self) -> None:
        pass


def severity_stream(observed: DataFrame, rules: list[dict], lateness: str = "10 minutes", cooldown: bool = False) -> DataFrame:
    """Severity changes of rules from a stream of (rule_id, ts, value), in append mode.

    A rule's values are judged in order of their time, whatever order they arrive in, once the
    watermark has passed them. Of two values of a rule at one time the later one counts. With
    ``cooldown`` a rule that fired says nothing but its recovery for its ``cooldown_secs``.
    """
    prepare_state(observed.sparkSession)
    entries = {int(r["rule_id"]): entries_of(r["condition"]) for r in rules}
    quiet = {int(r["rule_id"]): int(r["condition"].get("cooldown_secs", 0)) if cooldown else 0 for r in rules}
    rows = observed.withWatermark("ts", lateness).select("rule_id", "ts", F.col("value").cast("double").alias("value"), _ms("ts").alias("at_ms"))
    return rows.groupBy("rule_id").transformWithStateInPandas(
        SeverityKeeper(entries, quiet), outputStructType=SEVERITY_DDL, outputMode="Append", timeMode="EventTime"
    )


# -- chunked messages ------------------------------------------------------------

MESSAGE_BUCKETS = 4096
MESSAGE_DDL = "msg_id string, payload string, complete boolean, received int, total int"


class ChunkKeeper:
    """Parts of messages from their first part on; what is not whole when the time is up is reported as such.

    The open messages of a hash bucket share a state value, which Spark hands over with the bucket's rows and
    takes back once a batch: neither parts nor messages cost calls of their own. A message stays until its time
    is up, so a bucket holds no more than its share of the messages of ``timeout_ms`` and the lateness.
    """

    def __init__(self, timeout_ms: int, max_bytes: int):
        self.timeout_ms, self.max_bytes = timeout_ms, max_bytes

    def _take(self, msg: dict | None, msg_id: str, at: int, seq: int, total: int, payload: str | None) -> tuple[dict, list[tuple]]:
        if msg is None:
            msg = {"first": at, "total": total, "bytes": 0, "received": 0, "done": False, "parts": {}, "later": []}
        if at >= msg["first"] + self.timeout_ms:
            msg["later"] = [x for x in msg["later"] if x[:2] != [at, seq]] + [[at, seq, total, payload]]
            return msg, []
        msg["first"] = min(msg["first"], at)
        if msg["total"] != total:
            msg["total"] = -1  # two shapes under one id: never whole
        elif not msg["done"] and str(seq) not in msg["parts"]:
            msg["bytes"] += len((payload or "").encode())
            msg["received"] += 1
            msg["parts"][str(seq)] = payload or ""
        if msg["done"] or msg["total"] != total or msg["received"] != total or msg["bytes"] > self.max_bytes:
            return msg, []
        text = "".join(p for _, p in sorted((int(k), p) for k, p in msg["parts"].items()))
        msg.update(parts={}, done=True)
        return msg, [(msg_id, text, True, msg["received"], total)]

    def __call__(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_messages, found, fresh = json.loads(state.get[0]) if state.exists else {}, [], []
        for part in rows:
            fresh += zip(*(part[c].tolist() for c in ("at_ms", "seq", "total", "msg_id", "payload")))
        for at, seq, total, msg_id, payload in sorted(fresh, key=lambda r: r[:2]):
            open_messages[msg_id], out = self._take(open_messages.get(msg_id), msg_id, at, seq, total, payload)
            found += out
        now = state.getCurrentWatermarkMs()
        due = [m for m, msg in open_messages.items() if msg["first"] + self.timeout_ms <= now]
        for msg_id in due:
            msg = open_messages.pop(msg_id)
            while msg is not None and msg["first"] + self.timeout_ms <= now:
                if not msg["done"]:
                    found.append((msg_id, None, False, msg["received"], msg["total"]))
                waiting, msg = sorted(msg["later"], key=lambda r: r[:2]), None
                for row in waiting:
                    msg, out = self._take(msg, msg_id, *row)
                    found += out
            if msg is not None:
                open_messages[msg_id] = msg
        if open_messages:
            state.update((json.dumps(open_messages),))
            state.setTimeoutTimestamp(min(msg["first"] for msg in open_messages.values()) + self.timeout_ms)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["msg_id", "payload", "complete", "received", "total"])


def chunk_messages(
    chunks: DataFrame, timeout_seconds: float = 5, lateness: str = "5 seconds",
    max_total: int = MAX_CHUNKS, max_bytes: int = MAX_CHUNKED_BYTES, buckets: int = MESSAGE_BUCKETS,
) -> DataFrame:
    """(receive_ts, msg_id, seq, total, payload) to messages, in append mode: whole ones at once, others when their time is up.

    A message's time begins with its earliest part. ``complete`` tells whole messages (with their
    ``payload``) from those with parts missing, too many bytes or two declared totals (total -1). A part
    that comes after the time begins the message anew. Repeated parts count once. ``buckets`` stays as it
    is for the life of a checkpoint; with few messages at a time most buckets are empty.
    """
    prepare_state(chunks.sparkSession)
    good = chunks.filter(F.col("total").between(1, max_total) & (F.col("seq") >= 0) & (F.col("seq") < F.col("total")) & F.col("msg_id").isNotNull())
    rows = good.withWatermark("receive_ts", lateness).select(
        F.pmod(F.xxhash64("msg_id"), F.lit(buckets)).alias("bucket"), "msg_id", "receive_ts", "seq", "total", "payload", _ms("receive_ts").alias("at_ms")
    )
    keeper = ChunkKeeper(int(timeout_seconds * 1000), max_bytes)

    def step(key, parts, state):
        yield from keeper(key, parts, state)

    return rows.groupBy("bucket").applyInPandasWithState(step, MESSAGE_DDL, "messages string", "append", GroupStateTimeout.EventTimeTimeout)

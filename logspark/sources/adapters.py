"""Maps of the driver's ``events`` table onto the log and web-event schemas.

Only fixed expressions of each row are used, so the adapters scale with the table and can be
restated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.functions.text import message_fingerprint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("event_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with an ``event_key`` for stable ordering."""
    kind, value, k, user = F.col("event_type"), F.col("value"), F.col("k"), F.col("user_id")
    level = (
        F.when((kind == "error") & (value > 150), "fatal")
        .when(kind == "error", "error")
        .when(value > 100, "warn")
        .otherwise("info")
    )
    message = (
        F.when(
            kind == "error",
            F.concat(
                F.lit('Error in handler "h'), (k % 5).cast("string"), F.lit('" code '),
                (k % 3).cast("string"), F.lit(" of step"), (k % 7).cast("string"),
                F.lit(" user "), user.cast("string"),
            ),
        )
        .when(kind == "purchase", F.lit("checkout.amount"))
        .otherwise(
            F.concat(kind, F.lit(" took "), value.cast("string"), F.lit(" ms on /p/"), (k % 20).cast("string"))
        )
    )
    span = F.lower(F.lpad(F.hex("event_key"), 16, "0"))
    attributes = F.concat(
        F.lit('{"duration_ms":'), value.cast("string"), F.lit(',"event":"'), kind,
        F.lit('","k":'), k.cast("string"),
        F.when(kind == "purchase", F.concat(F.lit(',"value":'), value.cast("string"))).otherwise(""),
        F.when(
            kind == "view",
            F.concat(
                F.lit(',"span_kind":"SPAN_KIND_SERVER","status_code":"STATUS_CODE_OK","parent_span_id":"p'),
                (k % 3).cast("string"), F.lit('"'),
            ),
        ).otherwise(""),
        F.when(kind == "error", F.concat(F.lit(',"exception_type":"E'), (k % 5).cast("string"),
                                         F.lit('","stack":"at step '), (k % 4).cast("string"), F.lit(' of run"'))).otherwise(""),
        F.lit("}"),
    )
    base = _events(spark, sf_dir).select(
        "event_key",
        "ts",
        (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("insert_ts"),
        F.concat(F.lit("host-"), (user % 16).cast("string")).alias("source_host"),
        F.concat(F.lit("svc-"), (user % 8).cast("string")).alias("service"),
        level.alias("level"),
        message.alias("message"),
        F.md5(
            F.concat(user.cast("string"), F.lit("|"), F.floor(F.unix_seconds("ts") / 3600).cast("string"))
        ).alias("trace_id"),
        span.alias("span_id"),
        attributes.alias("attributes"),
        F.when(user % 4 == 0, "DE").when(user % 4 == 1, "US").when(user % 4 == 2, "ID").alias("geo_country"),
        F.when(kind == "view", "otlp_span").when(kind == "purchase", "otlp_metric").otherwise("http_json").alias("protocol"),
        "user_id",
    )
    return base.withColumns(
        {
            "raw_len": (F.length("message") + F.length("attributes")).cast("int"),
            "fingerprint": F.when(
                F.col("level").isin("error", "fatal"), message_fingerprint(F.col("service"), F.col("message"))
            ),
        }
    )


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events without session ids, with an ``event_key``."""
    kind, value, k, user = F.col("event_type"), F.col("value"), F.col("k"), F.col("user_id")
    event = (
        F.when(kind == "view", "pageview")
        .when((kind == "click") & (k < 50), "outbound")
        .when((kind == "click") & (k < 70), "download")
        .when(kind == "click", "engagement")
        .when(kind == "error", "error")
        .when((kind == "purchase") & (k >= 60), "vital")
        .otherwise("custom")
    )
    ev = F.col("event")
    name = (
        F.when(ev == "outbound", F.concat(F.lit("ext"), (k % 6).cast("string"), F.lit(".example.com")))
        .when(ev == "custom", kind)
        .when(ev == "vital", F.when(k % 3 == 0, "LCP").when(k % 3 == 1, "INP").otherwise("CLS"))
        .when(ev == "error", F.concat(F.lit("E"), (k % 5).cast("string")))
    )
    path = (
        F.when(ev.isin("pageview", "error", "vital"), F.concat(F.lit("/p/"), (k % 20).cast("string")))
        .when(ev == "outbound", F.concat(F.lit("/out/"), (k % 7).cast("string")))
        .when(ev == "download", F.concat(F.lit("/files/"), (k % 4).cast("string"), F.lit(".pdf")))
    )
    amount = (
        F.when(ev == "engagement", value * 100)
        .when((ev == "vital") & (k % 3 == 0), value * 40)
        .when((ev == "vital") & (k % 3 == 1), value * 4)
        .when(ev == "vital", value / 500)
    )
    text = {
        "source": F.when(user % 5 == 0, "google").when(user % 5 == 1, "direct").when(user % 5 == 2, "twitter").when(user % 5 == 3, "news"),
        "medium": F.when(user % 5 == 0, "organic").when(user % 5 == 1, "direct").when(user % 5 == 2, "social").when(user % 5 == 3, " "),
        "country": F.when(user % 4 == 0, "DE").when(user % 4 == 1, "US").when(user % 4 == 2, "ID"),
        "region": F.when(user % 4 == 0, "BE").when(user % 4 == 1, "CA"),
        "city": F.when(user % 4 == 0, "Berlin").when(user % 4 == 1, "Oakland"),
        "device": F.when(user % 3 == 0, "desktop").when(user % 3 == 1, "mobile").otherwise("tablet"),
        "browser": F.when(user % 4 == 0, "Chrome").when(user % 4 == 1, "Firefox").when(user % 4 == 2, "Safari").otherwise(""),
        "os": F.when(user % 3 == 0, "Windows").when(user % 3 == 1, "Android").otherwise("iPadOS"),
    }
    return (
        _events(spark, sf_dir)
        .withColumn("event", event)
        .select(
            "event_key",
            "ts",
            (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("insert_ts"),
            F.concat(F.lit("site-"), (user % 3).cast("string")).alias("site_id"),
            "event",
            name.alias("name"),
            amount.alias("value"),
            path.alias("path"),
            (user + 1).alias("visitor_id"),
            F.when(user % 7 == 0, user + 1000).alias("user_id"),
            (user % 29 == 0).alias("is_internal"),
            (user % 23 == 0).alias("is_bot"),
            (320 * (1 + user % 5)).cast("int").alias("screen_w"),
            F.when(
                k % 10 == 0,
                F.create_map(
                    F.lit("source"), F.lit("mail"), F.lit("medium"), F.lit("email"),
                    F.lit("campaign"), F.concat(F.lit("c"), (k % 3).cast("string")),
                ),
            ).alias("utm"),
            *[c.alias(n) for n, c in text.items()],
            F.md5(
                F.concat(user.cast("string"), F.lit("|"), F.floor(F.unix_seconds("ts") / 3600).cast("string"))
            ).alias("trace_id"),
        )
    )

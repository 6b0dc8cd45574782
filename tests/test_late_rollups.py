from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from logspark.operators import sessions as S, visit_store as V, web_rollups as W
from logspark.streaming import jobs as J

GAP = 1800


def lines(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def odd(web):
    """Visitors over midnight, a busy one, bots, events without a visitor or a site."""
    rows = [{"v": 1 + i % 7, "at": 37 * i, "event": ["pageview", "engagement", "custom"][i % 3], "value": i * 1.25, "path": f"/{i % 4}", "country": ["ID", None][i % 2]} for i in range(150)]
    rows += [{"v": 50, "at": 830 + i / 4, "path": f"/{i % 9}"} for i in range(60)] + [{"v": 0, "at": 3 * i} for i in range(20)] + [{"v": 3, "at": 5 * i, "bot": True} for i in range(9)]
    rows += [{"v": None, "at": 4}, {"v": None, "at": 2000, "site": None}, {"v": 4, "at": 9, "site": None}, {"v": 4, "at": 11, "site": "t"}]
    return web(*rows)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1_000, 1])
def test_daily_values_from_visits(spark, odd, hot_rows):
    want = W.daily_values(S.stamp_sessions(odd, GAP), S.sessionize(odd, GAP))
    assert lines(W.daily_values_of_visits(odd, V.cut(odd, GAP), GAP, hot_rows)) == lines(want)


def test_daily_values_shuffle_events_once(spark, odd, tmp_path):
    calm = odd.filter("visitor_id <> 0 AND site_id IS NOT NULL")
    V.cut(calm, GAP).write.parquet(str(tmp_path / "v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = W.daily_values_of_visits(calm, spark.read.parquet(str(tmp_path / "v")), GAP)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # events, visits, the list of busy visitors, and one row a task for each value
    assert plan.count("Exchange hashpartitioning") == 4


def test_days_are_written_in_few_files(spark, odd, tmp_path):
    src, root = str(tmp_path / "in"), tmp_path / "web"
    odd.filter("visitor_id IS NOT NULL").repartition(16).write.parquet(src)
    source = spark.readStream.schema(odd.schema).parquet(src)
    J.web_rollup_stream(source, str(root), str(tmp_path / "cp"), GAP, 2).trigger(availableNow=True).start().awaitTermination()
    days = odd.filter("visitor_id IS NOT NULL").select(F.to_date("ts")).distinct().count()
    assert len(list((root / "events").glob("part_day=*/batch_id=0/*.parquet"))) == days > 3
    assert T0 + timedelta(days=3) < odd.agg(F.max("ts")).first()[0]

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logspark.session import local_session, prepare  # noqa: E402

T0 = datetime(2024, 1, 15, 10)


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("LOGSPARK_DRIVER_MEMORY", "4g")
    s = local_session("tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    return prepare(s)


@pytest.fixture
def raw(spark):
    def make(*bodies, protocol="http_json", source="10.0.0.9"):
        rows = [(T0, source, protocol, b) for b in bodies]
        return spark.createDataFrame(rows, "receive_ts timestamp, source_addr string, protocol string, raw string")

    return make


WEB_DDL = (
    "event_key long, ts timestamp, insert_ts timestamp, site_id string, visitor_id long, user_id long, "
    "event string, path string, name string, value double, source string, medium string, country string, "
    "region string, city string, device string, browser string, os string, is_internal boolean, is_bot boolean"
)


@pytest.fixture
def web(spark):
    def make(*events):
        """Events as dicts with ``at`` minutes from T0; a running key and plain defaults."""
        rows = []
        for i, e in enumerate(events):
            ts = T0 + timedelta(minutes=e.get("at", 0))
            event = e.get("event", "pageview")
            rows.append((
                i, ts, ts, e.get("site", "s"), e.get("v", 1), e.get("user"), event,
                e.get("path", "/a" if event == "pageview" else None), e.get("name"), e.get("value"),
                e.get("source"), e.get("medium"), e.get("country", "ID"), e.get("region"), e.get("city"),
                e.get("device", "desktop"), e.get("browser", "Chrome"), e.get("os", "Linux"),
                e.get("internal", False), e.get("bot", False),
            ))
        return spark.createDataFrame(rows, WEB_DDL)

    return make

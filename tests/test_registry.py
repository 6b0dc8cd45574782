import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["B1_normalise_json", "C5_fold_error_groups", "D6_groups", "E1_search_logs", "F1_rollup_minute", "H1_sessionize", "H12_funnel", "I5_anomaly_cycle"]


def test_every_query_has_sql():
    import registry.all  # noqa: F401
    from registry.core import ORACLE, QUERIES

    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["bucket", "service", "errors", "total", "rate"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_rows_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "pages", "orders", "lineitem", "customer", "supplier", "nation", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want.fetchall())

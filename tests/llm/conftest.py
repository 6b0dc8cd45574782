import pytest

from logspark.llm.common import prepare


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


@pytest.fixture(scope="module")
def texts(sp):
    def make(rows, extra=False):
        """(doc_id, text) rows, on demand with columns whose names clash with those used inside."""
        df = sp.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS marks", "'z' AS _found", "0 AS rid", "'w' AS words") if extra else df

    return make

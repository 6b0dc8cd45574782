"""The driver's entry points without the training-data package."""

import sys

import __spark_entry__


def test_other_queries_stay_without_training_data(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = __spark_entry__.queries()
    assert "F6_error_rate" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)

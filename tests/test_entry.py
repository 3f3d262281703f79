"""What the driver calls."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id"] and out.count() >= 0

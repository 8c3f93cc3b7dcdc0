"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0

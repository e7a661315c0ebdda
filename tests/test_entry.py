"""The driver's contract."""

import __spark_entry__ as e


def test_every_sql_has_a_query():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_flagship(spark):
    df = e.entry(spark)
    assert df.columns == ["id", "score"] and df.count() > 0

"""The driver's contract."""

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "barcode", "primer", "dupcount", "seq"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())

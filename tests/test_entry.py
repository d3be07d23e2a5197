"""Driver contract: entry runs, every oracle key has a query."""
import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() >= 1
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
    assert set(E.catalog.queries()) <= set(qs)

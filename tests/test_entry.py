import __spark_entry__ as entry


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() > 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 50

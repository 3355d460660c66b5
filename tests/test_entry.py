import __spark_entry__ as entry


def test_every_check_has_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 90


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer_id", "risk_score", "risk_level"] and df.count() == 150

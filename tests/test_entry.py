import __spark_entry__ as registry


def test_entry(spark):
    df = registry.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())

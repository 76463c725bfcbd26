import __spark_entry__ as e


def test_queries_and_sql_go_together(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 25

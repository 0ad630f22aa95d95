import __spark_entry__ as entry


def test_contract(spark):
    flagship = entry.entry(spark)
    assert {"event_id", "window_id"} <= set(flagship.columns) and flagship.count() > 0
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    assert set(names) - set(sql) <= set(entry.LLM_QUERIES)

import __spark_entry__ as e


def test_every_twin_is_text_of_a_query():
    found = e.oracle_sql()
    assert set(found) <= set(e.queries())
    assert [n for n, sql in found.items() if not isinstance(sql, str)] == []

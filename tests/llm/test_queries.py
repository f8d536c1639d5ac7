import __spark_entry__ as contract


def test_oracles_are_sql():
    for name, sql in contract.oracle_sql().items():
        assert isinstance(sql, str) and "select" in sql.lower(), name

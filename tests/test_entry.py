"""The functions that a driver calls: the flagship query, the registered queries and their SQL."""

import __spark_entry__ as entry


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() == 15 and {"query_id", "id", "final_rank"} <= set(got.columns)


def test_registry():
    known, sql = entry.queries(), entry.oracle_sql()
    assert len(known) >= 50 and all(map(callable, known.values())) and set(sql) <= set(known) and all(sql.values())

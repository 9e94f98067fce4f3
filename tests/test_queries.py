"""Each registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from clausewright.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name not in ORACLES:
        return
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = db.sql(ORACLES[name]).df()[list(got.columns)]
    order = list(got.columns)
    got, want = (x.sort_values(order).reset_index(drop=True).astype(object) for x in (got, want))
    assert len(got) == len(want)
    for c in order:
        a, b = got[c].where(got[c].notna(), None), want[c].where(want[c].notna(), None)
        assert a.tolist() == b.tolist(), c

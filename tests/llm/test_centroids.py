"""Centroid clustering against brute force, on odd rows, ties and empty tables."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from clausewright.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, x string, cluster long"


def brute(rows, k, rounds, dims):
    kept = [(i, np.array([int(np.floor(256 * v)) for v in e])) for i, e in rows if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x.tolist()) for i, x in kept)[:k]
    c = [np.array(x) for _, x in first]
    near = lambda x: min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            if got := [x for (_, x), o in zip(kept, own, strict=True) if o == j]:
                c[j] = np.array([sum(map(int, v)) // len(got) for v in zip(*got, strict=True)])
    out = [(i, *near(x)[::-1]) for i, x in kept]
    by = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((-1 if i is None else i), j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for i, j, d in out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, e, "z", 9) for i, e in rows], SCHEMA)
    got = C.cluster_vectors(df, **how).select(F.coalesce("vec_id", F.lit(-1)), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted(map(tuple, got))


def test_walks_equal_brute_force_with_ties():
    rng = np.random.default_rng(5)
    for k, d, size in ((1, 3, 4), (7, 2, 3), (40, 4, 2), (40, 8, 300)):
        c = rng.integers(-size, size + 1, (k, d))
        x = rng.integers(-size, size + 1, (2000, d))
        at, best = C.Orchard(c).nearest(x)
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (best == full.min(axis=1)).all() and (at == full.argmin(axis=1)).all()


def test_walks_leave_out_far_centroids():
    """In well-parted clusters few centroids are measured: the stop is what bounds the work."""
    rng = np.random.default_rng(6)
    c = rng.integers(-10_000, 10_000, (200, 3))
    o, measured = C.Orchard(c), 0
    x = np.repeat(c, 5, axis=0) + rng.integers(-50, 50, (1000, 3))
    o.c = CountingRows(o.c)
    o.nearest(x)
    measured = o.c.rows
    assert measured < 1000 * 200 / 3


class CountingRows:
    def __init__(self, a):
        self.a, self.rows = a, 0

    def __len__(self):
        return len(self.a)

    def __getitem__(self, i):
        self.rows += np.size(i)
        return self.a[i]


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, [0.1, -0.1, 2.0, 3.0]), (None, [0.5] * 4), (None, [0.5] * 4)]
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [float("inf"), 1.0, 1.0, 1.0])]
    for k in (1, 6, 40):
        assert run(spark, rows + odd, k=k, dims=4) == brute(rows + odd, k, 5, 4)


def test_few_rows_and_none(spark):
    two = [(1, [1.0, 2.0]), (2, [-1.0, 0.25])]
    assert run(spark, two, dims=2) == brute(two, 40, 5, 2)
    assert run(spark, [(1, None), (2, [1.0])], dims=2) == []
    assert run(spark, [(1, [0.0, 0.0])] * 3, dims=2) == brute([(1, [0.0, 0.0])] * 3, 40, 5, 2)
    huge = run(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])], k=1, rounds=0, dims=2)
    assert [r[2] for r in huge] == [0, (2 * C._edge(2)) ** 2] or [r[2] for r in huge] == [(2 * C._edge(2)) ** 2, 0]


def test_query_equals_sql(spark):
    got = C.op11_centroids(spark, "/root/testdata/sf0.01").toPandas()
    db = duckdb.connect()
    db.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = db.sql(C.OP11_SQL).df()[list(got.columns)]
    assert len(got) and got.sort_values("vec_id").to_numpy().tolist() == want.sort_values("vec_id").to_numpy().tolist()

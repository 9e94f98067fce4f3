"""Ranked search against brute force, on odd rows, ties, blocks of items and small buckets."""

import math
import random
import re

import duckdb
import pytest

from clausewright.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [m.translate(LOW) for m in TERM.findall(text or "")]


def brute(docs, items, k=20):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, all_ = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        rows = []
        for i, t in own:
            m, s = 75 + 25 * len(t) * n // all_, 0
            for x in terms(text):
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if s > 0:
                rows.append((-s, i is None, i))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, at, i, -s) for at, (s, _, i) in enumerate(rows[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item string").repartition(5)
    q = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id long, text string, score long, doc_id string")
    got = X.search_documents(d, q, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def test_terms():
    text = "Ab-c1 ÄÖ\x85x\xa0y_ß'q 日本\n\tÇa"
    assert [t.decode() for p in X.terms_of(text) for t in p] == terms(text)
    long = "abc " * 1_000_000 + "x" * 3_000_000
    assert sum(len(p) for p in X.terms_of(long)) == 1_000_001


@pytest.mark.parametrize("small", [False, True])
def test_rows_equal_brute_force(spark, small, monkeypatch):
    if small:  # many buckets and several blocks of items
        for name, value in (("BLOCK_BYTES", 300), ("BUCKET", 8), ("LEAST", 2), ("CHUNK", 200)):
            monkeypatch.setattr(X, name, value)
    rng, pool = random.Random(3), [f"w{int(i**1.5)}" for i in range(60)] + ["Été", "straße", "日本"]
    docs = [(i, words(rng, rng.randint(1, 60), pool)) for i in range(120)]
    docs += [(3, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (None, None), (501, ""), (502, " .,\n"), (503, "w0 " * 5000), (504, "nowhere asked")]
    items = [(i, words(rng, rng.randint(1, 25), pool)) for i in range(12)] + [(1, "w0 w0 w0 w1"), (1, "w0 w0 w0 w1"), (None, "été Été w8"), (90, None), (91, ""), (92, "unknown words only")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == [] and run(spark, [(1, "a b")], [(1, None)]) == []


def test_bounds_leave_out_documents():
    """Once the best are known, few documents are scored."""
    import numpy as np

    rng = np.random.default_rng(4)
    items = X.Items([(0, "t1 t2 t3 t4 t5 t6")])
    size, weights = 20, np.full(6, 900, np.int64)
    lemp = X.Lemp(items, weights, 5000, 5000 * size, 5)
    at, terms_, tf = [0], [], []
    for d in range(5000):
        own = np.arange(6) if d < 10 else rng.choice(6, 2, replace=False)
        terms_.append(np.sort(own))
        tf.append(np.ones(len(own), np.int64))
        at.append(at[-1] + len(own))
    lemp.chunk(np.arange(5000), np.zeros(5000, bool), np.full(5000, size), np.array(at), np.concatenate(terms_), np.concatenate(tf))
    assert sorted(lemp.best.docs[0].tolist()) == list(range(5)) and lemp.scored < 1000


def test_query_equals_sql(spark):
    got = X.op12_lexical(spark, "/root/testdata/sf0.001").toPandas()
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = db.sql(X.OP12_SQL).df()[list(got.columns)]
    order = ["item_id", "rank"]
    assert len(got) and got.sort_values(order).to_numpy().tolist() == want.sort_values(order).to_numpy().tolist()

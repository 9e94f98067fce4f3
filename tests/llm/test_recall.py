"""Near duplicates of all rows of sf0.1 against all pairs: an exact join by the rarest shingles, so no link is missed by the comparison."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from clausewright.llm import registry

DATA = "/root/testdata/sf0.1"


def all_links(sets, percent):
    """Pairs at or above the likeness: two such sets share one of their len - ceil(percent * len) + 1 rarest members."""
    often = Counter(x for s in sets.values() for x in s)
    holds, links = defaultdict(list), []
    for d, s in sorted(sets.items(), key=lambda p: len(p[1])):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(percent * len(s) / 100) + 1]
        for e in {e for x in rare for e in holds[x]}:
            t = sets[e]
            if 100 * len(t) >= percent * len(s) and 100 * (both := len(s & t)) >= percent * (len(s) + len(t) - both):
                links.append((d, e))
        for x in rare:
            holds[x].append(d)
    return links


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


def test_near_recall_on_every_row(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        if w:
            sets[d] = frozenset(hash(tuple(w[i : i + 3])) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([hash(tuple(w))])
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            root[d] = d = root[root[d]]
        return d

    links = all_links(sets, 85)
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op6_near_dup"](spark, DATA).collect()}
    assert len(links) > 1000 and got == {d: (len(sets.get(d, ())), find(d)) for d in texts}

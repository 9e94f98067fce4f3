"""The pipeline's run against a brute-force version of all its stages, and its stages' columns."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline as cp
from clausewright.llm import toxicity
from clausewright.llm.common import table
from clausewright.llm.packing import default_tokenizer

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def is_toxic(model, t):
    """Noisy-or of the sentences' scores, as the model's weights say."""
    rest = 1.0
    for part in re.findall(r"[^.!?\n]+", t.lower()):
        found = set(re.findall(r"[^\W\d_]+", part))
        if found:
            z = model.bias + sum(model.weights.get(f, 0.0) for w in found for f in toxicity.features(w))
            rest *= 1 - 1 / (1 + math.exp(-z))
    return 1 - rest >= 0.5


def without_lines(docs):
    keys = {d: [lower(x.strip(SPACE)) for x in t.split("\n")] for d, t in docs.items()}
    n = Counter(k for ks in keys.values() for k in set(ks))
    return {d: "\n".join(x for x, k in zip(t.split("\n"), keys[d], strict=True) if k == "" or n[k] < 10) for d, t in docs.items()}


def without_copies(docs):
    sets = {}
    for d, t in docs.items():
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: t for d, t in docs.items() if find(d) == d}


def mixed(docs, sources):
    """How often each document is in the mix."""
    size = {d: len(words(t)) for d, t in docs.items()}
    total = Counter()
    for d in docs:
        total[sources[d]] += size[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = 3 * total[s] if full else rate * weight[s]
        if not full:
            break
        left -= sum(3 * total[s] for s in full)
        open_ -= full
    copies = {}
    for s in names:
        if not total[s]:
            continue
        budget = math.floor(target[s] + 0.5)
        epochs, rest = divmod(budget, total[s])

        def key(d):
            t = docs[d]
            junk = "0123456789|#{}<>[]_=*~^@\\/$%&+"
            q = max(0.05, sum(c not in junk for c in t) / len(t)) if t else 1.0
            u = (int(hashlib.md5(f"mix:{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / q, d

        for d in sorted((d for d in docs if sources[d] == s), key=key):
            part = min(size[d], rest)
            rest -= part
            if size[d] and (n := math.floor((epochs * size[d] + part) / size[d] + 0.5)):
                copies[d] = n
    return copies


def test_run_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet'").fetchall()
    docs, sources = {d: t or "" for d, t, _ in rows}, {d: s for d, _, s in rows}
    model = toxicity.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    clean = {d: t for d, t in docs.items() if not is_toxic(model, t)}
    left = without_copies(without_lines(clean))
    copies = mixed(left, sources)
    assert len(docs) > len(clean) > len(left) >= len(copies) > 0
    stock = Tokenizer.from_file(default_tokenizer())
    ids = {d: [*stock.encode(left[d], add_special_tokens=False).ids, 1] for d in copies}

    got = cp.run(spark, DATA).toPandas()
    tokens, starts = defaultdict(int), Counter()
    for r in got.itertuples():
        tokens[r.doc_id] += r.length
        starts[r.doc_id] += r.start == 0
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(array("I", ids[r.doc_id][r.start : r.start + r.length]).tobytes())
    assert starts == copies and tokens == {d: n * len(ids[d]) for d, n in copies.items()}
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum()[:-1]] and bin(seq["length"].sum()).count("1") == 1


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents")
    schema = docs.schema
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.dtypes == [(f.name, f.dataType.simpleString()) for f in schema], name


def test_stages_on_odd_rows(spark):
    """Null ids, null texts, repeated rows, extra columns of the operators' own names, an empty table."""
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(3, text, "en", "a", 1), (None, text, "en", "a", 1), (None, other, None, None, None), (4, None, "en", "b", 0), (4, "", "en", "b", 0), (5, other + " x", "en", "a", 1), (5, other + " x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 AS __t", "2 AS __score", "3 AS key", "4 AS node", "5 AS h", "6 AS kept_text", "7 AS size")
    # one of the two copies with an id stays for each text; rows without words are in no group
    near = sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in cp.near_duplicates(spark, extra, DATA).collect())
    assert near == [(3, "word0"), (4, ""), (4, ""), (5, "other")]
    assert cp.line_dedup(spark, extra, DATA).count() == 7
    kept = cp.mixing(spark, extra, DATA).collect()
    assert all(r["text"] for r in kept) and {r["doc_id"] for r in kept} <= {3, 5, None}
    packed = cp.packing(spark, docs, DATA).toPandas()
    assert packed["length"].sum() == packed[packed["start"] == 0]["doc_tokens"].sum() and (packed["start"] == 0).sum() == 7
    assert cp.toxicity(spark, extra, DATA).columns == cp.COLUMNS
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, DATA).count() == 0

"""Ranked lexical search: impact vectors in buckets of like length, pruned by bounds, survivors scored exactly in whole numbers.

A document is a vector of impacts, one for each of its terms that some item asks for; an item is a vector of counts, and a score their inner product. Documents of
a chunk are put in order of their vectors' lengths and cut into buckets. For an item whose k-th best score so far is known, a bucket can be left out if the product of both
lengths (Cauchy-Schwarz) or the sum of the item's counts times the bucket's largest impacts is below it. Inside a bucket, documents are candidates if they hold one of the terms without which
the score isn't reached, and they survive if what these terms give and a bound on the others, by coordinates and by what is left of both lengths, comes up to it. Only survivors are scored.

Texts are read once for each block of items: items are dealt into blocks of bounded size, and a block's terms and counts are sent to all tasks. What is written of a document are the
numbers and counts of such terms. Tasks hold chunks of bounded size and the best k an item, which two windows join: of some tasks each, then of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.llm.common import LOWER, UPPER, cut, discard, small_batches, table, with_python

TOP = 20
BLOCK_BYTES = 2**24  # of the texts of one block of items
CHUNK = 2**21  # counts that a task holds at once; one document may have more
PIECE = 2**20  # bytes that are split into terms at once
BUCKET, LEAST, RATIO = 2048, 256, 0.8  # most and least documents of a bucket, and its least length by its largest
SALTS = 64  # windows an item, each over the best of some tasks, before the one over all
SLACK = 1 + 1e-9  # for bounds in doubles

#: What the query contract fixes: terms are runs of ASCII letters and digits and of all other characters that aren't ASCII; only A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded length (but for one long term)."""
    data = text.encode().translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items as counts of numbered terms; an item without terms stays empty."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for _, text in rows:
            mine: dict[int, int] = {}
            for piece in terms_of(text or ""):
                for t in piece:
                    i = self.number.setdefault(t, len(self.number))
                    mine[i] = mine.get(i, 0) + 1
            self.terms.append(np.array(list(mine), np.int64))
            self.counts.append(np.array(list(mine.values()), np.int64))
        self.length = np.array([math.sqrt(float((c.astype(np.float64) ** 2).sum())) for c in self.counts])


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """w * ((1000000000 * tf) div (1000 * tf + 12 * m)) with m = 100 - 25 + ((25 * n * N) div L)."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + 25 * n * n_docs // all_terms)))


class Best:
    """The best k documents of each item so far: scores, and places of ids in a list that grows by chunks."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * items
        self.docs = [np.zeros(0, np.int64)] * items
        self.void = [np.zeros(0, bool)] * items  # documents without an id come after all others
        self.floor = np.ones(items, np.int64)  # least score that is of use

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, void: np.ndarray) -> None:
        s, d, v = (np.concatenate(p) for p in ((self.scores[item], scores), (self.docs[item], docs), (self.void[item], void)))
        order = np.lexsort((d, v, -s))[: self.k]
        self.scores[item], self.docs[item], self.void[item] = s[order], d[order], v[order]
        if len(order) == self.k:
            self.floor[item] = s[order[-1]]


class Bucket:
    """Documents (CSR rows) of like length, with the lists of their terms."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, impact: np.ndarray, length: np.ndarray) -> None:
        """at: where documents begin in terms and impact, and the end."""
        self.at, self.terms, self.impact, self.length = at, terms, impact, length
        order = np.argsort(terms, kind="stable")
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[order]
        self.by_term, sorted_ = impact[order], terms[order]
        begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
        self.known = sorted_[begin]
        self.ends = np.append(begin, len(sorted_))
        self.most = np.maximum.reduceat(self.by_term, begin) if len(begin) else np.zeros(0, np.int64)

    def survivors(self, terms: np.ndarray, counts: np.ndarray, floor: int) -> np.ndarray:
        """Documents whose score may reach the floor."""
        place = np.searchsorted(self.known, terms)
        place[place == len(self.known)] = 0
        there = self.known[place] == terms if len(self.known) else np.zeros(len(terms), bool)
        place, counts = place[there], counts[there]
        upper = counts * self.most[place]
        if upper.sum() < floor:
            return np.zeros(0, np.int64)
        order = np.argsort(upper, kind="stable")
        rest = int(np.searchsorted(np.cumsum(upper[order]), floor))  # so many terms alone stay below the floor
        left, need = order[:rest], order[rest:]
        docs = np.concatenate([self.doc[self.ends[p] : self.ends[p + 1]] for p in place[need]])
        times = np.repeat(counts[need], self.ends[place[need] + 1] - self.ends[place[need]]).astype(np.float64)
        own = np.concatenate([self.by_term[self.ends[p] : self.ends[p + 1]] for p in place[need]]).astype(np.float64)
        n = len(self.length)
        got, square = np.bincount(docs, own * times, n), np.bincount(docs, own * own, n)
        found = np.zeros(n, bool)
        found[docs] = True
        others = math.sqrt(float((counts[left].astype(np.float64) ** 2).sum())) * np.sqrt(np.maximum(self.length**2 * SLACK - square, 0.0))
        bound = (got + np.minimum(others, float(upper[left].sum()))) * SLACK
        return np.flatnonzero(found & (bound >= floor))


class Lemp:
    """A block of items against chunks of documents."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, all_terms: int, k: int) -> None:
        self.items, self.weights, self.n_docs, self.all_terms = items, weights, n_docs, all_terms
        self.best = Best(len(items.ids), k)
        self.scored = 0
        self.dense = np.zeros(len(weights), np.int64)

    def chunk(self, docs: np.ndarray, void: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """docs and void: ids, and where there is none; n: their numbers of terms; at: where their terms begin, and the end."""
        impact = impacts(self.weights[terms], tf, np.repeat(n, np.diff(at)), self.n_docs, self.all_terms)
        of = np.repeat(np.arange(len(docs)), np.diff(at))
        length = np.sqrt(np.bincount(of, impact.astype(np.float64) ** 2, len(docs)))
        order = np.argsort(-length, kind="stable")
        begin = 0
        while begin < len(order) and length[order[begin]] > 0:
            end = min(begin + BUCKET, len(order))
            alike = int(np.searchsorted(-length[order[begin:end]], -RATIO * length[order[begin]], side="right"))
            end = min(end, begin + max(LEAST, alike))
            self._bucket(order[begin:end], docs, void, at, terms, impact, length)
            begin = end

    def _bucket(self, rows: np.ndarray, docs: np.ndarray, void: np.ndarray, at: np.ndarray, terms: np.ndarray, impact: np.ndarray, length: np.ndarray) -> None:
        take, begins = _ranges(at, rows)
        b = Bucket(begins, terms[take], impact[take], length[rows])
        near = np.flatnonzero(self.items.length * (length[rows[0]] * SLACK) >= self.best.floor)
        for i in near:
            wanted, counts = self.items.terms[i], self.items.counts[i]
            left = b.survivors(wanted, counts, int(self.best.floor[i]))
            if not len(left):
                continue
            self.scored += len(left)
            self.dense[wanted] = counts
            take, begins = _ranges(b.at, left)
            score = np.add.reduceat(self.dense[b.terms[take]] * b.impact[take], begins[:-1])  # survivors have terms
            self.dense[wanted] = 0
            good = score >= self.best.floor[i]
            self.best.add(i, score[good], docs[rows[left[good]]], void[rows[left[good]]])


def _ranges(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all the rows' entries, where each row's begin among them and the end) where row i has the entries at[i] to at[i + 1]."""
    size = at[rows + 1] - at[rows]
    begins = np.append(0, np.cumsum(size))
    return np.arange(begins[-1]) - np.repeat(begins[:-1] - at[rows], size), begins


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with terms: n counts all, terms and tf are those that the items ask for."""
    shared = docs.sparkSession.sparkContext.broadcast(items.number)  # the terms of BLOCK_BYTES of text

    def run(texts: list[str]) -> dict:
        get, ns, sizes, terms, tf = shared.value.get, [], [0], [], []
        for t in texts:
            n, found = 0, []
            for piece in terms_of(t):
                n += len(piece)
                ids = np.fromiter(map(get, piece, repeat(-1)), np.int32, len(piece))
                found.append(ids[ids >= 0])
            own, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
            ns.append(n)
            sizes.append(len(own))
            terms.append(own)
            tf.append(times.astype(np.int32))
        at = pa.array(np.cumsum(sizes, dtype=np.int32))
        flat = lambda parts: pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))
        return {"n": ns, "terms": flat(terms), "tf": flat(tf)}

    return with_python(docs, "t", run, "n long, terms array<int>, tf array<int>").filter("n > 0")


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    """(item, doc_id, score, rank) of a block's items, as a written table; None if no document has terms."""
    spark = docs.sparkSession
    vectors = cut(_vectors(docs, items), "impacts")
    n_docs, all_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        discard(vectors)
        return None
    weights = np.zeros(max(1, len(items.number)), np.int64)
    for t, df in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # the items' terms
        weights[t] = term_weight(n_docs, df)
    shared = spark.sparkContext.broadcast((items, weights))
    id_type = vectors.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, w = shared.value
        lemp = Lemp(found, w, n_docs, all_terms, k)
        held, size = [], 0

        def flush() -> None:
            b = pa.concat_batches(held)
            lists = b.column("terms")
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = b.column("doc_id")
            void = ids.is_null().to_numpy(zero_copy_only=False)
            flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lemp.chunk(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), void, b.column("n").to_numpy(), at - at[0], flat("terms"), flat("tf"))

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= CHUNK:
                flush()
                held, size = [], 0
        if held:
            flush()
        best = lemp.best
        counts = [len(s) for s in best.scores]
        ids, void = np.concatenate(best.docs), np.concatenate(best.void)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(found.ids, counts)), pa.array(ids, mask=void), pa.array(np.concatenate(best.scores))], names=["item", "doc_id", "score"])

    hits = small_batches(vectors).mapInArrow(run, "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = hits.withColumn("some", F.spark_partition_id() % SALTS)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "some").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    out = cut(ranked.select("item", F.col("doc_id").cast(id_type), "score", "rank"), "ranked")
    discard(vectors)
    shared.unpersist()
    return out


def search_documents(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items its k documents of the highest score above 0, ties by doc_id.

    Texts that are null or have no terms have no part: such documents don't count, such items get no rows. Each row of items is one item, so repeated
    ids or rows are ranked each by itself; repeated documents take a rank each, ones without an id after others of their score. Ids are whole numbers. Other columns go, whatever
    their names. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    asked = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("t")), "items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = []
    for i in range(blocks):  # one after another: each reads all texts for its items
        rows = asked.filter((F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) & F.col("t").isNotNull()).select("item", "t").orderBy("item").collect()
        block = Items([(r["item"], r["t"]) for r in rows])
        if len(block.number) and (hits := _search_block(ready, block, k)) is not None:
            found.append(hits)
    kinds = StructType([asked.schema["item_id"], ready.schema["doc_id"]])
    if not found:
        discard(asked)
        return spark.createDataFrame([], kinds).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    all_ = found[0]
    for other in found[1:]:
        all_ = all_.unionByName(other)
    return all_.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark, sf_dir):
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), i AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
t AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, {_TERMS} AS term FROM d) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r), total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, total GROUP BY term),
s AS (SELECT item, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM (SELECT item, {_TERMS} AS term FROM i) JOIN t USING (term) JOIN w USING (term) JOIN n USING (r), total GROUP BY item, r)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN i USING (item) JOIN d USING (r) WHERE score > 0) WHERE rank <= {TOP}"""

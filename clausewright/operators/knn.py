"""Nearest neighbours: exact for a query set of any size against all rows, and approximate by inverted lists.

Few queries are sent to where the vectors are, which then aren't moved at all. Beyond a checked number, vectors are dealt into parts of bounded size, and the queries, as the smaller side,
are sent to each part. A task then holds its part and reads the queries as a stream: blocks of them meet the part in one matrix product and keep the best k a query, and a window takes
the best of those. Neither the driver nor a task holds all queries.

The inverted lists are those of a coarse k-means, fitted in Spark rounds on a bounded sample; every row is in a list. A query meets the rows of the lists nearest to it, with exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clausewright.sources.tables import cut, discard, small_batches


class KnnBackend(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class BackendUnavailable(RuntimeError):
    """A search backend that isn't there; nothing else is used in its place."""


def usable(rows: DataFrame, name: str, wide: int) -> DataFrame:
    """rows with a vector e: those without one (null or empty) go; one of another size than `wide`, or with null or infinite components or none that are numbers, fails the job by its id."""
    bad = (F.size("e") != wide) | F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    said = F.concat(F.lit(f"vector of {name} "), F.coalesce(F.col(name).cast("string"), F.lit("null")), F.lit(f" isn't {wide} finite numbers"))
    return rows.filter(F.size("e") > 0).filter(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def width(rows: DataFrame) -> int:
    """The size of the first vector that is there; 0 if there is none."""
    first = rows.filter(F.size("e") > 0).select(F.size("e")).first()
    return first[0] if first else 0


def matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def best_of(scores: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best k of each row of scores, best first, ties by place."""
    least = max(0, scores.shape[1] - k)
    row, col = np.nonzero(scores >= np.partition(scores, least, axis=1)[:, least, None])
    best = np.lexsort((place[col], -scores[row, col], row))
    row, col = row[best], col[best]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def places(ids: pa.Array) -> np.ndarray:
    return np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")


SCORES = 2**19  # numbers of one product, which is held some times over
QUERIES = 2**10  # queries of one product with vectors that stay in their partitions
HELD = 2**23  # numbers of the vectors that a task holds


def _found(asks: pa.RecordBatch, own: pa.Array, scores: np.ndarray, place: np.ndarray, k: int) -> pa.RecordBatch:
    row, col = best_of(scores, place, k)
    return pa.RecordBatch.from_arrays([asks.column("query_id").take(pa.array(row)), asks.column("kind").take(pa.array(row)), own.take(pa.array(col)), pa.array(scores[row, col])], names=["query_id", "kind", "id", "score"])


def search_parts(dealt: DataFrame, k: int, found: StructType) -> DataFrame:
    """The best k of each query in each part. dealt: (part, side, id, query_id, kind, e), a part's vectors (side 0) before its queries (side 1) in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, blocks, own = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, side = batch.column("part").to_numpy(), batch.column("side").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (side[1:] != side[:-1]), [True]])).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                rows = batch.slice(a, b - a)
                if part[a] != now:
                    now, ids, blocks, own = part[a], [], [], None
                if side[a] == 0:
                    ids.append(rows.column("id"))
                    blocks.append(matrix(rows))
                    continue
                if not ids:
                    continue
                if own is None:
                    own, vectors = pa.concat_arrays(ids), np.concatenate(blocks).T
                    blocks.clear()
                    place, step = places(own), max(1, SCORES // len(own))
                for at in range(0, rows.num_rows, step):
                    asks = rows.slice(at, min(step, rows.num_rows - at))
                    yield _found(asks, own, matrix(asks) @ vectors, place, k)

    return small_batches(dealt).mapInArrow(run, found)


def ranked(local: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sides(held: DataFrame, sent: DataFrame) -> DataFrame:
    """Vectors (part, id, e) and queries (part, query_id, kind, e) as one table for search_parts()."""
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (*held.dtypes, *sent.dtypes)}
    return held.select("part", F.lit(0).alias("side"), "id", none["query_id"], none["kind"], "e").unionByName(sent.select("part", F.lit(1).alias("side"), none["id"], "query_id", "kind", "e"))


def fields(rows: DataFrame, queries: DataFrame) -> StructType:
    return StructType([queries.schema["query_id"], queries.schema["kind"], rows.schema["id"], StructField("score", DoubleType())])


class FlatIndex:
    """Scores every vector. rows: id, embedding; queries: query_id, kind, embedding.

    Rows and queries without a vector take no part; vectors of a wrong size or with components that aren't finite are an error, see usable(). With fewer than k rows all are found.
    """

    SENT = 2**20  # numbers of the queries that are sent to where the vectors are

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, kind, id, score, rank): inner products, best first, ties by id."""
        vectors, asked = self.rows.select("id", F.col("embedding").alias("e")), queries.select("query_id", "kind", F.col("embedding").cast("array<double>").alias("e"))
        wide = width(vectors)
        if not wide:
            return ranked(self.rows.sparkSession.createDataFrame([], fields(vectors, asked)), k)
        vectors, asked = usable(vectors, "id", wide), usable(asked, "query_id", wide)
        most = max(1, self.SENT // wide)
        few = asked.limit(most + 1).toArrow()
        return ranked(self._sent(vectors, asked, few, k) if few.num_rows <= most else self._dealt(vectors, asked, wide, k), k)

    def _sent(self, vectors: DataFrame, asked: DataFrame, few: pa.Table, k: int) -> DataFrame:
        """Vectors stay in their partitions. A task hands on the best k a query so far of each block, so later blocks add few."""
        shared = self.rows.sparkSession.sparkContext.broadcast(few.combine_chunks())  # SENT numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared.value.num_rows:
                return
            asks = shared.value.to_batches()[0]
            q, some = matrix(asks), min(asks.num_rows, QUERIES)
            top, step = np.full((len(q), k), -np.inf), max(1, SCORES // some)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    rows = batch.slice(at, min(step, batch.num_rows - at))
                    own, vectors = rows.column("id"), matrix(rows).T
                    place = places(own)
                    for first in range(0, len(q), some):
                        scores, least = q[first : first + some] @ vectors, top[first : first + some]
                        hit = np.flatnonzero(scores.max(axis=1) >= least[:, 0])  # queries that get anything from this block
                        if not len(hit):
                            continue
                        scores = scores[hit]
                        row, col = best_of(scores, place, k)
                        good = scores[row, col] >= least[hit[row], 0]
                        row, col = row[good], col[good]
                        best = np.concatenate([least[hit], np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, -k:]], axis=1)
                        least[hit] = np.sort(best, axis=1)[:, -k:]
                        at_row = pa.array(first + hit[row])
                        yield pa.RecordBatch.from_arrays([asks.column("query_id").take(at_row), asks.column("kind").take(at_row), own.take(pa.array(col)), pa.array(scores[row, col])], names=["query_id", "kind", "id", "score"])

        return small_batches(vectors).mapInArrow(run, fields(vectors, asked))

    def _dealt(self, vectors: DataFrame, asked: DataFrame, wide: int, k: int) -> DataFrame:
        n = vectors.count()
        parts = max(-(-n * wide // HELD), min(n, int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
        held = vectors.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", F.col("e").cast("array<double>").alias("e"))
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "kind", "e")
        flow = sides(held, sent).repartitionById(parts, "part").sortWithinPartitions("part", "side")
        return search_parts(flow, k, fields(vectors, asked))


class ListIndex:
    """Inverted lists: every vector is in the list of the centroid nearest to it, and a query meets the rows of the `probes` lists whose centroids are nearest to it.

    Centroids come from `rounds` of k-means on some SAMPLE vectors a list, chosen by a hash; each round is a Spark job. Scores of what is met are exact; what
    lies in other lists is missed. The lists are written to the shared folder, in their order, so a search reads only files that may hold its lists; large lists are dealt into parts. close() deletes them.
    """

    SAMPLE = 256

    def __init__(self, rows: DataFrame, lists: int = 64, probes: int = 16, rounds: int = 6) -> None:
        self.probes = min(probes, lists)
        vectors = rows.select("id", F.col("embedding").cast("array<double>").alias("e"))
        self.wide = width(vectors)
        vectors = usable(vectors, "id", self.wide)
        self.centroids = self._fit(vectors, lists, rounds)
        self.table = cut(self._assigned(vectors).repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list"), "lists")
        self.sizes = dict(self.table.groupBy("list").count().collect())  # a row a list

    def close(self) -> None:
        discard(self.table)

    def _fit(self, vectors: DataFrame, lists: int, rounds: int) -> np.ndarray:
        n = vectors.count()
        share = min(1.0, self.SAMPLE * lists / max(1, n))
        some = cut(vectors.filter(F.xxhash64("id").bitwiseAND(2**31 - 1) < int(share * 2**31)), "sample")
        c = np.array([r["e"] for r in some.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(lists).collect()], np.float64).reshape(-1, max(1, self.wide))
        for _ in range(rounds if len(c) else 0):
            shared = vectors.sparkSession.sparkContext.broadcast(c)  # lists x dimensions

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
                for batch in batches:
                    x = matrix(batch)
                    own = _nearest(x, shared.value)
                    np.add.at(total, own, x)
                    count += np.bincount(own, minlength=len(count))
                here = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(count[here]), pa.array(total[here].tolist(), pa.list_(pa.float64()))], names=["list", "n", "s"])

            part = some.select("e").mapInArrow(run, "list long, n long, s array<double>")
            for r in part.groupBy("list").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(self.wide)]).alias("s")).collect():
                c[r["list"]] = np.array(r["s"]) / r["n"]
            shared.unpersist()
        discard(some)
        return c

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _nearest(matrix(batch), shared.value) if len(shared.value) else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("e"), pa.array(own.astype(np.int32))], names=["id", "e", "list"])

        return vectors.mapInArrow(run, StructType([vectors.schema["id"], vectors.schema["e"], *StructType.fromDDL("list int").fields]))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, kind, id, score, rank) of what the probed lists hold: inner products, best first, ties by id."""
        spark = self.table.sparkSession
        asked = queries.select("query_id", "kind", F.col("embedding").cast("array<double>").alias("e"))
        if not self.wide:
            return ranked(spark.createDataFrame([], fields(self.table, asked)), k)
        asked = usable(asked, "query_id", self.wide)
        probes, shared = self.probes, spark.sparkContext.broadcast(self.centroids)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = shared.value
                far = (c**2).sum(axis=1)[None] - 2 * matrix(batch) @ c.T
                n = min(probes, len(c))
                near = np.argpartition(far, n - 1, axis=1)[:, :n]
                row = np.repeat(np.arange(batch.num_rows), n)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(pa.array(row)) for x in ("query_id", "kind", "e")), pa.array(near.reshape(-1).astype(np.int32))], names=["query_id", "kind", "e", "list"])

        lists = asked.mapInArrow(probed, StructType([*asked.schema.fields, *StructType.fromDDL("list int").fields]))
        parts = {c: -(-n * self.wide // HELD) for c, n in self.sizes.items()}
        first, at = {}, 0
        for c in sorted(parts):
            first[c], at = at, at + parts[c]
        of = spark.createDataFrame([(c, first[c], parts[c]) for c in first], "list int, first int, parts int")  # a row a list
        held = self.table.join(F.broadcast(of), "list").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"), "id", "e")
        sent = lists.join(F.broadcast(of), "list").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("part"), "query_id", "kind", "e")
        return ranked(search_parts(sides(held, sent).repartition("part").sortWithinPartitions("part", "side"), k, fields(self.table, asked)), k)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def create_index(rows: DataFrame, backend: str = "flat", **how: int) -> KnnBackend:
    """backend: `flat` scores all rows, `lists` those of the nearest inverted lists."""
    kinds = {"flat": FlatIndex, "lists": ListIndex}
    if backend not in kinds:
        raise BackendUnavailable(f"no search backend {backend!r}")
    return kinds[backend](rows, **how)

"""Centroid clustering by Orchard search: exact k-means on whole numbers, with lists of neighbours for each centroid.

Every centroid has a list of the others by distance. A vector begins at one centroid and walks its list; where it finds a closer centroid it goes on
in that one's list, and it ends where the list's next centroid lies strictly beyond twice the distance at hand, since by the triangle inequality nothing there or
later is closer or as close. Centroids that it has met are marked and not measured twice. All rows of a batch walk at once.

Each round is one job: tasks assign their rows and hand on at most a row for each centroid, so only sums are shuffled, and the driver holds the k centroids.
Nothing is kept between rounds, so a lost executor costs the tasks that it ran.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import small_batches, table

K, ROUNDS, SALT, DIMS, SCALE = 40, 5, "2", 64, 256


class Orchard:
    """Centroids (k x d, whole numbers) with each one's list of neighbours, nearest first."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = np.asarray(centroids, np.int64)
        between = np.array([((self.c - one) ** 2).sum(axis=1) for one in self.c], np.int64)
        self.order = np.argsort(between, axis=1, kind="stable")
        # A list's member lies beyond twice the distance d when its square is over 4 d^2, so when d^2 is at most this.
        self.quarter = np.take_along_axis((between - 1) // 4, self.order, axis=1)
        self.first = int(np.argmin(between.astype(np.float64).sum(axis=1)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the centroid nearest to each row of x; of equally near ones the smallest number."""
        n, k = len(x), len(self.c)
        at = np.full(n, self.first)
        best = ((x - self.c[self.first]) ** 2).sum(axis=1)
        place = np.zeros(n, np.int64)
        met = np.zeros((n, k), bool)
        met[:, self.first] = True
        live = np.arange(n)
        while len(live):
            live = live[best[live] > self.quarter[at[live], place[live]]]
            next_ = self.order[at[live], place[live]]
            place[live] += 1
            new = ~met[live, next_]
            row, cand = live[new], next_[new]
            met[row, cand] = True
            d = ((x[row] - self.c[cand]) ** 2).sum(axis=1)
            closer = (d < best[row]) | ((d == best[row]) & (cand < at[row]))
            row = row[closer]
            at[row], best[row], place[row] = cand[closer], d[closer], 0
            live = live[place[live] < k]
        return at, best


def _edge(dims: int) -> int:
    """Largest size of a component for which squared distances are 64-bit whole numbers."""
    return isqrt(2**60 // dims)


def whole_vectors(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors of dims components, none null or non-finite, as floor(scale * component).

    Others go, null vectors too. Components beyond +-2^27 (for 64 of them) count as that, so that distances are 64-bit numbers.
    """
    edge = float(_edge(dims))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    number: Column = F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), v.cast("double") * scale))).cast("int"))
    return rows.filter((F.size(vector) == dims) & F.forall(vector, finite)).select(F.col(vec_id).alias("vec_id"), number.alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the least sha256 of `salt:vec_id`, ids in decimal (a null one empty); of one id by their components."""
    named = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    return np.array([r["x"] for r in named.orderBy("h", "x").limit(k).collect()], np.int64)


def _sums(vectors: DataFrame, search: Broadcast, dims: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, rows, sum of each component) of the clusters that have rows: k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o: Orchard = search.value
        k = len(o.c)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            own = (o.nearest(x)[0] == np.arange(k)[:, None]).astype(np.int64)
            n += own.sum(axis=1)
            total += own @ x
        here = np.flatnonzero(n)
        flat = pa.array(total[here].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(n[here]), pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * dims), flat)], names=["cluster", "n", "s"])

    part = vectors.select("x").mapInArrow(run, "cluster int, n long, s array<long>")
    rows = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)]).alias("s")).collect()
    return [(r["cluster"], r["n"], r["s"]) for r in rows]


def _spread(vectors: DataFrame, search: Broadcast, dims: int) -> dict[int, int]:
    """Sum of squared distances of each cluster that has rows: k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = search.value.nearest(_matrix(batch, dims))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(d)], names=["cluster", "distance"])

    rows = vectors.select("x").mapInArrow(run, "cluster int, distance long").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    return {r["cluster"]: int(r["d"]) for r in rows}


def cluster_vectors(rows: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = SALT, dims: int = DIMS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid and centroid_sha256 for each of whole_vectors(rows).

    Rows are taken as they are: null and repeated ids give a row each, and equal vectors go to one cluster. Vectors as near to several centroids go to
    the one of the smallest number; a centroid that loses all its vectors stays where it is. With fewer than k vectors each is a centroid; without any
    the result is empty. Other columns go, whatever their names. Sums of distances beyond 64 bits are null.
    """
    vectors, sc = small_batches(whole_vectors(rows, dims, scale, vec_id, vector)), rows.sparkSession.sparkContext
    centroids = first_centroids(vectors, k, salt).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        search = sc.broadcast(Orchard(centroids))  # k x d and k x k numbers
        for c, n, s in _sums(vectors, search, dims):
            centroids[c] = [v // n for v in s]
        search.unpersist()
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(f.split(None, 1)[1]).alias(n) for n, f in zip(names, fields.split(", "), strict=True)])
    search = sc.broadcast(Orchard(centroids))
    spread = _spread(vectors, search, dims)
    long = lambda v: v if v < 2**63 else None
    own = pa.array([long(spread.get(c, 0)) for c in range(len(centroids))], pa.int64())
    total = long(sum(spread.values()))
    digest = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    listed = pa.array(centroids.tolist(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = search.value.nearest(_matrix(batch, dims))
            here = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), here, pa.array(d), own.take(here), pa.array([total] * len(at), pa.int64()), listed.take(here), digest.take(here)], names=["vec_id", *names])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, {fields}")


def op11_centroids(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """The same by holding every vector against every centroid."""
    near = lambda c: f"SELECT v.r, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c.c}}) AS b FROM v, {c} c GROUP BY v.r"
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{SALT}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v) ORDER BY h, x LIMIT {k})",
    ]
    for i in range(1, rounds + 1):
        ctes += [
            f"a{i} AS MATERIALIZED ({near(f'c{i - 1}')})",
            f"s{i} AS (SELECT b.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {DIMS + 1}) t(i) GROUP BY b.c, i)",
            f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY c)",
            f"c{i} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i - 1} o LEFT JOIN m{i} m ON m.c = o.c)",
        ]
    return f"""WITH {", ".join(ctes)}, a AS MATERIALIZED ({near(f"c{rounds}")})
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.b.c"""


OP11_SQL = _sql()

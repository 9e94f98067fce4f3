"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and grouping.

Documents with equal shingle sets form a class, and only a class's first document goes on, so thousands of copies
cost one row. Classes whose signatures agree in a band share a bucket. A bucket isn't paired out: in
each round one member, the hub, is compared with the others that aren't in its component yet, on full shingle sets, so
rounds cost rows in proportion to the buckets' sizes, and found links merge components. What large buckets still hold in
several components after the rounds is compared block by block, on signatures first; pairs whose signatures come near the limit are
verified on full sets where they meet. So no link that banding shows is left out, and no group meets in one task.

Banding follows the likeness asked for: 32 bands of 7 of 224 positions find a pair at 0.85 with probability 0.999996, 37 bands of 6 one at 0.8 with
0.99998. Pairs in blocks whose signatures agree in fewer positions than the asked likeness by SIGMAS standard deviations aren't verified; such a pair is a link with probability under 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from clausewright.llm.common import cut, discard, free, in_groups, join_keys, table, with_python
from clausewright.llm.components import connected

M = 224  # positions of a signature
MISSED = 1e-4  # most of the links at the limit that no band may show
SIGMAS = 5.0
ROUNDS = 2  # rounds of hubs in buckets of more than SMALL classes, before blocks
SMALL, BLOCK_Y, BLOCK_X, CHUNK = 16, 128, 512, 128
SENT = 20_000  # buckets that join_keys sends out at most
PAIRS = 4096  # pairs of signatures that are compared at once
LANES = np.uint64(0x0101010101010101)
NO_ID = 2**63 - 1
MUL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MUL[3]
    x = (x ^ (x >> np.uint64(29))) * MUL[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words, A-Z lower-cased; of all words where there are fewer; empty without words."""
    words = text.encode().lower().split()
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    if len(w) < n:
        n = len(w)
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = _mix(h * MUL[1] + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def super_minhash(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """SuperMinHash of each set, the last byte of each position's winner (uint8, sets x m); zeros for an empty set.

    Element e's value at position p is its rank of p in a random permutation of its own plus a random fraction. Ranks are dealt level
    by level for all elements at once; a set is done when every position holds a value of the levels dealt so far, as later ones are larger.
    Large sets so end after one level.
    """
    count = np.array([len(s) for s in sets])
    best = np.full(len(sets) * m, np.uint64(2**63))
    e = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    d = np.repeat(np.arange(len(sets)), count)
    perm = None
    for level in range(m):
        rnd = _mix(e + np.uint64(int(MUL[2]) * (level + 1) % 2**64))
        k = (level + (rnd & np.uint64(0xFFFFFFFF)) % np.uint64(m - level)).astype(np.int64)
        if perm is None:
            place = k
        else:
            rows = np.arange(len(e))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, level]
            perm[rows, level] = place
        np.minimum.at(best, d * m + place, np.uint64(level << 32) | (rnd >> np.uint64(32)))
        busy = best.reshape(-1, m).max(axis=1) >= np.uint64((level + 1) << 32)
        on = busy[d]
        if not on.any():
            break
        if perm is None:
            e, d, k = e[on], d[on], k[on]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
            rows = np.arange(len(e))
            perm[rows, 0] = k
            perm[rows, k] = 0
        elif not on.all():
            e, d, perm = e[on], d[on], perm[on]
    return (best.reshape(-1, m) & np.uint64(0xFF)).astype(np.uint8)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """docs with n_shingles, c1, c2, sig for the column t: set size, 128 bits that name the set, and the signature."""

    def run(texts: list[str]) -> dict:
        sets = [shingles(t, n) for t in texts]
        names = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]
        return {"n_shingles": [len(s) for s in sets], "c1": [x[0] for x in names], "c2": [x[1] for x in names], "sig": [x.tobytes() for x in super_minhash(sets)]}

    return with_python(docs, "t", run, "n_shingles long, c1 long, c2 long, sig binary", rows=64)


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets have 100 * |intersection| >= percent * |union|.

    u's pairs are dealt out in chunks, each with u's text once, so a hub of any degree stays in bounds.
    """
    chunks = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "u").withColumn("salt", F.expr("pmod(xxhash64(v), chunks)")).select("u", "v", "salt")
    rest = dealt.join(texts, dealt["v"] == texts["node"]).select("u", "salt", "node", "t", F.lit(False).alias("hub"))
    hubs = dealt.select("u", "salt").distinct().join(texts, F.col("u") == texts["node"]).select("u", "salt", "node", "t", F.lit(True).alias("hub"))

    def run(part: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, is_hub, texts = part.column("node").to_numpy(), part.column("hub").to_pylist(), part.column("t")
        us, vs, hub = [], [], None
        for a, b in pairwise(begin.tolist()):
            for i in range(a, b):  # the hub comes first
                s = shingles(texts[i].as_py(), n)
                if is_hub[i]:
                    hub, u = s, node[i]
                elif _alike(hub, s, percent):
                    us.append(u)
                    vs.append(node[i])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    rows = hubs.unionByName(rest).withColumn("after", (~F.col("hub")).cast("int"))
    return in_groups(rows, ["u", "salt"], run, "u long, v long", ["after"])


def banding(percent: int) -> tuple[int, int]:
    """(bands, positions in each): as many positions as leave a pair at the limit unseen with probability MISSED at most."""
    rows = next((r for r in range(16, 1, -1) if (1 - (percent / 100) ** r) ** (M // r) <= MISSED), 1)
    return M // rows, rows


def _near(percent: int) -> float:
    """Least share of agreeing positions with which a pair is verified."""
    p = percent / 100
    return p - SIGMAS * (p * (1 - p) / M) ** 0.5


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union|, for sets as sorted arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _near_pairs(sy: np.ndarray, cy: np.ndarray, sx: np.ndarray, cx: np.ndarray, band: int, near: float, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of other components whose signatures agree in `near` of their positions, and in no band before this one."""
    found_i, found_j = [], []
    step = max(1, PAIRS // max(1, len(sx)))
    for at in range(0, len(sy), step):
        same = sy[at : at + step, None] == sx[None]
        # eight counters a word, each up to M / 8; their sum stays under 256
        agree = (same.view(np.uint64).sum(axis=2) * LANES) >> np.uint64(56)
        i, j = np.nonzero((cy[at : at + step, None] != cx[None]) & (agree >= near * M))
        if len(i):
            first = same[i, j][:, : bands * rows].reshape(len(i), bands, rows).all(axis=2)
            ok = first.any(axis=1) & (first.argmax(axis=1) == band)
            found_i.append(i[ok] + at)
            found_j.append(j[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _block_links(live: DataFrame, texts: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a table it wrote, links): links between different components that share a bucket and whose signatures agree in `near` of their positions.

    live: node, bucket, band, component, sig. Members of a bucket's largest component meet only the others, block by block of bounded size.
    A first pass over signatures tells which members have such partners; only these get their texts, in
    a second pass that verifies each pair in the first band it shares. Pairs never become rows.
    """
    near, shape = _near(percent), banding(percent)
    per = live.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    top = top.select("bucket", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK_Y).cast("int").alias("ys"), F.ceil(F.col("all") / BLOCK_X).cast("int").alias("xs"))
    rows = live.join(top, "bucket").withColumn("minor", F.col("component") != F.col("main"))
    own_y, own_x = F.expr("cast(pmod(xxhash64(node, 1), ys) as int)"), F.expr("cast(pmod(xxhash64(node, 2), xs) as int)")
    y = rows.filter("minor").withColumns({"yb": own_y, "xb": F.explode(F.sequence(F.lit(0), F.col("xs") - 1)), "right": F.lit(0)})
    x = rows.withColumns({"xb": own_x, "yb": F.explode(F.sequence(F.lit(0), F.col("ys") - 1)), "right": F.lit(1)})
    block = ["bucket", "yb", "xb"]
    pick = [*block, "band", "right", "node", "component", "sig"]

    def near_in(part: pa.RecordBatch, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block, the rows of the batch that make near pairs: of y, of x."""
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, M)
        component, band, right = part.column("component").to_numpy(), part.column("band").to_numpy(), part.column("right").to_numpy()
        middle = np.add.reduceat(1 - right, begin[:-1]) + begin[:-1]
        for a, m, b in zip(begin[:-1].tolist(), middle.tolist(), begin[1:].tolist(), strict=True):
            if a < m < b:
                i, j = _near_pairs(sig[a:m], component[a:m], sig[m:b], component[m:b], band[a], near, *shape)
                yield i + a, j + m

    def involved(part: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(part.num_rows, bool)
        for i, j in near_in(part, begin):
            hit[i] = hit[j] = True
        yield part.filter(pa.array(hit))

    def verified(part: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, component, texts = part.column("node").to_numpy(), part.column("component").to_numpy(), part.column("t")
        us, vs = [], []
        for ii, jj in near_in(part, begin):
            root: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:  # noqa: B023
                    c = up
                return c

            for i, j in zip(ii.tolist(), jj.tolist(), strict=True):
                if (p := find(component[i])) == (q := find(component[j])):
                    continue
                a, b = (sets[k] if k in sets else sets.setdefault(k, shingles(texts[k].as_py(), n)) for k in (i, j))
                if _alike(a, b, percent):
                    root[p] = q
                    us.append(node[i])
                    vs.append(node[j])
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    some = y.select(pick).unionByName(x.select(pick))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields)
    some = cut(in_groups(some, block, involved, kinds, ["right"]), "involved")
    return some, in_groups(some.join(texts, "node").select(*pick, "t"), block, verified, "u long, v long", ["right"])


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable over links), kept (one row of each component, of that id).

    Linked are documents whose sets of n-word shingles have 100 * |intersection| >= percent * |union|, and equal sets. Texts without words, null texts
    too, have the empty set and no link, and are kept. Each row is a document, whether its id is repeated or null; ids are integers. A component
    without any id has a null component_id. An empty table gives an empty result.
    """
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"), F.monotonically_increasing_id().alias("row"))
    return _groups(ready, n, percent).drop("row")


def _groups(ready: DataFrame, n: int, percent: int) -> DataFrame:
    """near_groups with the column row for (doc_id, t, row). Numbers of rows and classes count once they are written in `signed` and `classes`."""
    signed = cut(_signed(ready.withColumn("h", F.xxhash64("t")), n), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "h")).alias("first")
    classes = signed.filter("n_shingles > 0").groupBy("c1", "c2").agg(first, F.first("sig").alias("sig"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    bands, rows = banding(percent)
    buckets = classes.select("node", F.posexplode(F.array(*[F.substring("sig", rows * b + 1, rows) for b in range(bands)])).alias("band", "key"))
    buckets = buckets.select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "sizes")
    live = cut(join_keys(buckets, sizes, ["bucket"], SENT), "live")
    nodes = cut(live.groupBy("node").agg(F.sum("size").alias("degree")), "nodes")
    # a class's text is that of its first row, by id and text hash, as ready's own row numbers aren't written
    key = lambda c: F.coalesce(c, F.lit(NO_ID)).alias("key")
    wanted = classes.join(nodes.select("node"), "node").select("node", key(F.col("first.doc_id")), F.col("first.h").alias("h"))
    texts = cut(ready.select(key(F.col("doc_id")), F.xxhash64("t").alias("h"), "t").join(wanted, ["key", "h"]).select("node", "t").dropDuplicates(["node"]), "texts")

    parts = nodes.select("node", "degree", F.col("node").alias("component"))
    tested, done = None, [signed, classes, sizes, live, nodes, texts]  # done: tables that go at the end

    def merged(parts: DataFrame, found: DataFrame) -> DataFrame:
        """parts after the links found: what is contracted are the components, so edges are as few as merges."""
        of = parts.select("node", "component")
        ends = found.join(of.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u").join(of.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v")
        into = connected(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
        out = cut(parts.join(into, "component", "left").select("node", "degree", F.coalesce("into", "component").alias("component")), "parts")
        done.append(out)
        discard(into)
        return out

    large = live.filter(F.col("size") > SMALL)
    for turn in range(ROUNDS if not large.isEmpty() else 1):
        now = cut((large if turn else live).join(parts.select("node", "degree", "component"), "node"), "now")
        rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("degree")
        hubs = cut(now.groupBy("bucket").agg(F.max(F.struct(rank, "node", "component")).alias("hub"), F.count("*").alias("n")), "hubs")
        pairs = join_keys(now, hubs, ["bucket"], SENT).filter("component <> hub.component").select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        done += [pairs, now, hubs]
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = cut(_verify(pairs, texts, n, percent), "links")
        done.append(found)
        if not found.isEmpty():
            parts = merged(parts, found)
    some, links = _block_links(live.join(parts, "node").join(classes.select("node", "sig"), "node"), texts, n, percent)
    found = cut(links, "links")
    done += [some, found]
    if not found.isEmpty():
        parts = merged(parts, found)

    own = classes.select("c1", "c2", "copies", "first", "node").join(parts.select("node", "component"), "node", "left")
    own = cut(own.withColumn("component", F.coalesce("component", "node")), "own")
    heads = cut(own.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n")), "heads")
    named = cut(join_keys(own, heads, ["component"], SENT).select("c1", "c2", "head", F.col("copies").alias("n")), "named")
    done += [own, heads, named]
    rows = signed.select("row", "doc_id", "n_shingles", "c1", "c2")
    grouped = join_keys(rows.filter("n_shingles > 0"), named, ["c1", "c2"], SENT).select("row", "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("kept"))
    alone = rows.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = grouped.unionByName(alone)
    out = cut(out, "groups")
    discard(*done)
    return out


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, one with the least id; columns stay. The rows are written once with a number each.

    Rows count by themselves: of repeated rows one stays, rows without an id are compared like others and lose to rows with one, and ties are settled by the
    rows' numbers. Null and empty texts and texts without words are in no group and all stay. An empty table stays empty.
    """
    row = free(docs, "__row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ready = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"), F.col(row).alias("row"))
    out = _groups(ready, n, percent).filter(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(out, row, "left_anti").drop(row)


def op6_near_dup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), n=3, percent=85)

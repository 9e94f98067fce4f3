"""Document fingerprints from closed syncmers, and their likeness to an edited text and to the next document.

A k-mer of bytes is a closed syncmer if its least s-mer, by a fixed hash, is its first or its last. That depends on the
k-mer alone, so equal passages give equal anchors whatever stands around them. All anchors of a text are kept with their places, and
texts are matched by position: runs of anchors with equal hashes and equal distances are passages that both texts hold, however
small a part of them. Likeness is the share of anchors in such runs. The fingerprint, the least hashes of a text's anchors, is a short
name for where there is no room for all of them; likeness and passages aren't made from it.

Documents need their successor in order of id. Rows are cut into cells in that order at quantiles; the first document of each
cell is also sent to the cell before it. So texts are shuffled once, and each cell is read in order as a stream that holds
some hundred kilobytes of text, or two texts, at a time. An id that many rows share is cut into cells by the hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import IntegerType

from clausewright.llm.common import quantile_cells, small_batches, table

S, K, KEEP = 8, 15, 64  # bytes of an s-mer and a k-mer; hashes in a fingerprint
SLICE = 2**17  # bytes whose hashes are held at once
CHUNK = 2**17  # characters of the texts that are matched together, beyond one text's
LONGEST = 16  # anchors of the longest runs that get names
LEAST = -(2**63)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * A
    x ^= x >> np.uint64(29)
    x *= B
    x ^= x >> np.uint64(32)
    return x


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, byte place in it, 32-bit hash) of all closed syncmers of the texts, in order.

    A text shorter than a k-mer is one anchor, an empty one has none.
    """
    size = np.array([len(t) for t in texts], np.int64)
    long = np.where(size > 0, np.maximum(size, K), 0)
    end = np.cumsum(long)
    begin = end - long
    data = b"".join(t if len(t) >= K else t and t.ljust(K, b"\0") for t in texts)
    short = begin[(size > 0) & (size < K)]
    w, found, hashes = K - S + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(data) - K + 1, SLICE):
        n = min(SLICE + K - 1, len(data) - at)
        h = _mix(np.ndarray((n - S + 1,), "<u8", data, at, (1,)))
        low, span = h, 1
        while span < w:  # running minimum over w places by doubling
            step = min(span, w - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        flag = (low == h[: len(low)]) | (low == h[w - 1 :])
        flag[short[(short >= at) & (short < at + len(flag))] - at] = True
        here = np.flatnonzero(flag)
        found.append(here + at)
        hashes.append(h[here] + C * h[here + w - 1])
    at, h = np.concatenate(found), np.concatenate(hashes)
    own = np.searchsorted(end, at, side="right")
    ok = at + K <= end[own] if len(at) else np.zeros(0, bool)
    at, h, own = at[ok], h[ok], own[ok]
    brief = size[own] < K
    h[brief] += size[own[brief]].astype(np.uint64) * B
    return own, at - begin[own], (_mix(h) >> np.uint64(32)).astype(np.uint32)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte places, 32-bit hashes) of one text's closed syncmers."""
    return anchors_of([data])[1:]


def fingerprints(own: np.ndarray, h: np.ndarray, n: int, keep: int = KEEP) -> list[np.ndarray]:
    """For each of n texts the least `keep` distinct of its anchors' hashes, ascending."""
    key = np.sort(own.astype(np.uint64) << np.uint64(32) | h)
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    edges = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = key.astype(np.uint32)
    return [low[a : min(b, a + keep)] for a, b in pairwise(edges.tolist())]


def _cover(start: np.ndarray, long: int) -> np.ndarray:
    """For each anchor the latest run of `long` anchors that begins at a start and holds it, or -1."""
    at = np.arange(len(start))
    last = np.maximum.accumulate(np.where(start, at, -1))
    return np.where(last + long > at, last, -1)


def _among(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether y has each name of x, where y has it first, whether x has each name of y); names of y at the places `known` are in x too."""
    order = np.argsort(y)
    ranked = y[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    first = np.minimum.reduceat(order, np.flatnonzero(new))
    group = np.empty(len(y), np.int64)
    group[order] = np.cumsum(new) - 1
    names = ranked[new]
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    hit = names[at] == x
    held = np.zeros(len(names), bool)
    held[at[hit]] = True
    held[group[known]] = True
    return hit, first[at], held[group]


def match_pairs(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(likeness of each of n pairs of texts, passages), from (pair, place, hash) of the first and of the second texts' anchors.

    A passage is (pair, place in x, place in y, anchors), its anchors being next to each other at one offset. Runs of 2, 4, 8... anchors get
    64-bit names from the hashes and distances in them. An anchor is matched if it lies in a run of two that the other text has. Runs at
    the same place in both texts are taken as they are; else an anchor takes the offset of the longest named run found around it, so repeats go
    where most of their surroundings are. Likeness is the anchors matched, of the text that has fewer of them, by all of both. A text of one anchor matches as it
    is; two without any are alike.
    """
    (cx, px, hx), (cy, py, hy) = x, y
    nx, ny = np.bincount(cx, minlength=n), np.bincount(cy, minlength=n)
    like = np.where((nx == 0) & (ny == 0), 1.0, 0.0)
    none = np.zeros((0, 4), np.int64)
    if not len(cx) or not len(cy):
        return like, none
    fx, fy = (np.minimum(np.searchsorted(c, np.arange(n)), len(c) - 1) for c in (cx, cy))
    single = (nx == 1) & (ny == 1) & (hx[fx] == hy[fy])
    like[single] = 1.0
    whole = np.stack([np.flatnonzero(single), *np.zeros((2, single.sum()), np.int64), np.ones(single.sum(), np.int64)], axis=1)

    def joined(name: np.ndarray, place: np.ndarray, i: np.ndarray, long: int) -> np.ndarray:
        return _mix(_mix(name[i] + C) ^ (name[i + long] * B + (place[i + long] - place[i]).astype(np.uint64) * A))

    def starts(c: np.ndarray, long: int) -> np.ndarray:
        """Whether a run of `long` anchors that begins here stays in its pair."""
        return np.append(c[long - 1 :] == c[: len(c) - long + 1], np.zeros(min(long - 1, len(c)), bool))[: len(c)] if len(c) >= long else np.zeros(len(c), bool)

    gx, gy = (_mix(h + c.astype(np.uint64) * B) for h, c in ((hx, cx), (hy, cy)))
    okx, oky = starts(cx, 2), starts(cy, 2)
    # runs at the same place
    kx, ky = ((c << 40) | p for c, p in ((cx, px), (cy, py)))
    to = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
    same = (ky[to] == kx) & (hx == hy[to])
    still = okx & same & np.append(same[1:] & (to[1:] == to[:-1] + 1), False)
    ix, iy = np.flatnonzero(okx & ~still), np.flatnonzero(oky)
    hit, goes, back = still.copy(), np.where(still, to, 0), np.zeros(len(cy), bool)
    off, held = np.zeros(len(cx), np.int64), np.zeros(len(cx), bool)
    if len(iy):
        place = np.empty(len(cy), np.int64)
        place[iy] = np.arange(len(iy))
        nx2, ny2 = gx.copy(), gy.copy()
        nx2[ix], ny2[iy] = joined(gx, px, ix, 1), joined(gy, py, iy, 1)
        h, f, b = _among(nx2[ix], ny2[iy], place[to[still]])
        hit[ix[h]], goes[ix[h]] = True, iy[f[h]]
        back[iy[b]] = True
        run = _cover(hit, 2)
        held = run >= 0
        off[held] = (py[goes] - px)[run[held]]
        mx, my = np.bincount(cx[held], minlength=n), np.bincount(cy[_cover(back, 2) >= 0], minlength=n)
        m = np.minimum(mx, my)
        like = np.where(m > 0, m / np.maximum(1, nx + ny - m), like)
        hit[still] = False
        long = 2
        while long < LONGEST:
            ix = np.flatnonzero(hit[:-long] & hit[long:] & starts(cx, 2 * long)[:-long])
            iy = np.flatnonzero(back[:-long] & back[long:] & starts(cy, 2 * long)[:-long])
            if not len(ix) or not len(iy):
                break
            vx, vy = joined(nx2, px, ix, long), joined(ny2, py, iy, long)
            h, f, b = _among(vx, vy, np.zeros(0, np.int64))
            nx2[ix], ny2[iy] = vx, vy
            hit, back = np.zeros(len(cx), bool), np.zeros(len(cy), bool)
            hit[ix[h]], back[iy[b]] = True, True
            goes[ix[h]] = iy[f[h]]
            long *= 2
            run = _cover(hit, long)
            on = run >= 0
            off[on] = (py[goes] - px)[run[on]]
        off[_cover(still, 2) >= 0] = 0
    apart = (off[1:] != off[:-1]) | (cx[1:] != cx[:-1])
    begin = np.flatnonzero(held & np.append(True, ~held[:-1] | apart))
    stop = np.flatnonzero(held & np.append(~held[1:] | apart, True)) + 1
    return like, np.concatenate([whole, np.stack([cx[begin], px[begin], px[begin] + off[begin], stop - begin], axis=1)])


def matched(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """(likeness, passages) of two texts from their anchors; see match_pairs."""
    like, found = match_pairs(*((np.zeros(len(p), np.int64), p, h) for p, h in (a, b)), 1)
    return float(like[0]), found[:, 1:]


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_hashes (in the fingerprint),
    anchor_hashes, anchor_places (of all anchors, 32 bits each), passages_edited, passages_next (of the text in the edited and in the next one).

    Places are bytes of UTF-8 from 0; in `other` those of the other text.
    The edited text loses its last third (rounded down) to as many first code points of the next document, or all of it, in descending order of
    id; after the last comes the first. A null text counts as empty, a null id as the least; rows of
    one id follow each other in order of their text's hash. A single row is its own next. An empty table gives an empty result. Ids are integers.
    parts: cells that the rows are cut into, by default four for each of spark.sql.shuffle.partitions.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), F.coalesce(text, F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends, cells = quantile_cells(rows.select("k"), parts or 4 * n)
    base = np.cumsum(cells[::-1])[::-1] - cells  # the greatest ids come first

    @arrow_udf(IntegerType())
    def cell(k: pa.Array, h: pa.Array) -> pa.Array:
        at = np.searchsorted(ends, k.to_numpy(), side="left")
        share = np.clip((h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64, 0, 1 - 2**-53)
        return pa.array((base[at] + np.floor(share * cells[at])).astype(np.int32))

    rows = rows.withColumn("c", cell("k", "h"))
    order = F.struct(F.bitwise_not("k").alias("r"), F.col("h"))
    heads = sorted((r["c"], r["o"]["r"], r["o"]["h"]) for r in rows.groupBy("c").agg(F.min(order).alias("o")).collect())  # one a cell
    sent = [(heads[i - 1][0], ~r, h) for i, (_, r, h) in enumerate(heads)]
    to = F.broadcast(docs.sparkSession.createDataFrame(sent, "c int, k long, h long"))
    one = rows.drop("c").join(to, ["k", "h"]).groupBy("c").agg(*(F.first(x).alias(x) for x in ("doc_id", "k", "t", "h")))
    both = rows.withColumn("extra", F.lit(False)).unionByName(one.withColumn("extra", F.lit(True)))
    dealt = both.select("doc_id", "k", "t", "h", "c", "extra").repartitionById(n, F.pmod(F.col("c"), F.lit(n))).sortWithinPartitions("c", "extra", F.desc("k"), "h")
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        items: list[tuple] = []  # (doc_id, text, cell, extra); the next document of the last one isn't there yet
        chars = 0
        for batch in batches:
            id_type = id_type or batch.column("doc_id").type
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                for item in zip(*(piece.column(x).to_pylist() for x in ("doc_id", "t", "c", "extra")), strict=True):
                    items.append(item)
                    chars += len(item[1])
                    if chars >= CHUNK and len(items) > 1:
                        yield _rows(items, id_type)
                        items = [] if item[3] else [item]
                        chars = len(item[1]) if items else 0
        if len(items) > 1:
            yield _rows(items, id_type)

    return small_batches(dealt).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, anchor_hashes array<int>, anchor_places array<int>, " + ", ".join(f"passages_{x} array<struct<place: int, other: int, anchors: int>>" for x in ("edited", "next")))


def _rows(items: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """The result rows of all items that have their next document behind them."""
    pairs = np.array([i for i, (x, y) in enumerate(pairwise(items)) if not x[3] and x[2] == y[2]], np.int64)
    texts = [x[1].encode() for x in items]
    edited = [(items[i][1][: len(items[i][1]) - (m := len(items[i][1]) // 3)] + items[i + 1][1][:m]).encode() for i in pairs.tolist()]
    n = len(pairs)
    own, place, h = anchors_of(texts)
    edge = np.searchsorted(own, np.arange(len(texts) + 1))
    e_own, e_place, e_h = anchors_of(edited)

    def of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the texts `first`, numbered by pair."""
        many = edge[first + 1] - edge[first]
        stop = np.cumsum(many)
        at = np.arange(stop[-1] if n else 0) + np.repeat(edge[first] - stop + many, many)
        return np.repeat(np.arange(n), many), place[at], h[at]

    x = of(pairs)
    near_edited, in_edited = match_pairs(x, (e_own, e_place, e_h), n)
    near_next, in_next = match_pairs(x, of(pairs + 1), n)

    def hexes(f: list[np.ndarray]) -> list[str]:
        flat, stop = np.concatenate([np.zeros(0, np.uint32), *f]).astype(">u4").tobytes().hex(), np.cumsum([0, *map(len, f)]) * 8
        return [flat[a:b] for a, b in pairwise(stop.tolist())]

    def passages(found: np.ndarray) -> pa.Array:
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        edges = np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int32()) for c in found[:, 1:].astype(np.int32).T], names=["place", "other", "anchors"]))

    prints = fingerprints(x[0], x[2], n)
    edges = np.searchsorted(x[0], np.arange(n + 1)).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([items[i][0] for i in pairs.tolist()], id_type), "n_chars": pa.array([len(items[i][1]) for i in pairs.tolist()], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), "fingerprint": pa.array(hexes(prints), pa.string()),
        "edited_fingerprint": pa.array(hexes(fingerprints(e_own, e_h, n)), pa.string()), "near_edited": pa.array(near_edited, pa.float64()), "near_next": pa.array(near_next, pa.float64()),
        "n_hashes": pa.array([len(f) for f in prints], pa.int64()), "anchor_hashes": pa.ListArray.from_arrays(edges, pa.array(x[2].view(np.int32))), "anchor_places": pa.ListArray.from_arrays(edges, pa.array(x[1].astype(np.int32))),
        "passages_edited": passages(in_edited), "passages_next": passages(in_next),
    })


def op4_fingerprints(spark, sf_dir):
    out = fingerprint_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shared = lambda x: F.aggregate(x, F.lit(0), lambda s, p: s + p["anchors"]).cast("long")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("anchor_places").cast("long").alias("n_anchors"),
        shared("passages_edited").alias("anchors_in_edited"), shared("passages_next").alias("anchors_in_next"), "passages_edited", "passages_next",
    )

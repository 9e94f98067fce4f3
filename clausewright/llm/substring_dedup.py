"""Repeated passages across documents, by recompression of word sequences.

A round rewrites every document's sequence: maximal runs of a symbol become one symbol, then pairs become one where the left
symbol's class is 0 and the right one's is 1. Names and classes are hashes of what a symbol stands for, so all tasks of a round give a run or a pair the same
name over the whole corpus, and equal passages get equal symbols except near their ends. Each Spark job does some rounds and writes the sequences, which shrink by a
quarter a round, for the next. Symbols of the later rounds stand for long passages: one that a document with a smaller id holds too settles every window
in it by one comparison.

What is left are windows across the borders of such symbols, and text that isn't repeated at length. There a window of words is named by the least hash
of the symbols of two rounds whose surroundings, which are known, lie in it, so equal windows have equal names; windows without such a symbol are named by their own
words. Names seen in one document only are settled. For the others, the stretch of windows that share one symbol is a segment; segments agree as a whole
inside a repeat, so one hash verifies many windows, and only the windows of segments at a repeat's ends are compared one by one. A window's first document
never has it settled by a symbol, so leaving settled windows out changes no result.

Every count combines on the map side. Symbols, segments and windows that many rows hold are joined by sending them out, see join_keys; copies and long passages have
no windows left by then, so names are joined by a shuffle. Names are dealt in slices by their hash, and
what a slice needed goes before the next, which bounds the disk in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from clausewright.llm.common import cut, discard, join_keys, small_batches, table

WINDOW, NEAR = 13, 2  # words of a window; rounds of the symbols that name windows
FIRST, STEP, JOBS = 6, 3, 3  # rounds of the first job, of each later one, and how many of these
SENT = 20_000  # names that join_keys sends out at most
SLICES = 2  # of the names, one after another: the disk that shuffles and their inputs take is that of one
BATCH = 64  # rows that are parsed at once
NO_ID = 2**63 - 1
#: What tells rows apart: node, the id or NO_ID; h, a 64-bit hash of the text; and g, 64 more bits where rows have no id (else 0, which takes no room).
KEY = ["node", "h", "g"]
KEY_FIELDS = "node long, h long, g long"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
C1, C2, C3, C4 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C1
    x = (x ^ (x >> np.uint64(29))) * C2
    return x ^ (x >> np.uint64(32))


def one_round(name: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of the new symbols, where each begins among the old ones); owner: numbers of the documents, whose borders no symbol crosses."""
    begin = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]))[: len(name)])  # runs
    length = np.diff(np.append(begin, len(name))).astype(np.uint64)
    letter = name[begin]
    run = _mix(letter + length * C3 + np.uint64(level))
    kind = (_mix(letter ^ C4) >> np.uint64(40)) & np.uint64(1)
    own = owner[begin]
    pair = np.append((kind[:-1] == 0) & (kind[1:] == 1) & (own[:-1] == own[1:]), False)[: len(run)]
    second = np.append(False, pair[:-1])[: len(run)]
    new = np.where(pair, _mix(run * C4 + np.append(run[1:], run[:1])), run)
    return new[~second], begin[~second]


def rounds(name: np.ndarray, owner: np.ndarray, size: np.ndarray, first: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, owner, words) of the symbols after `many` rounds from number `first`."""
    for level in range(first, first + many):
        if not len(name):
            break
        name, at = one_round(name, owner, level)
        owner, size = owner[at], np.add.reduceat(size, at)
    return name, owner, size


def near_symbols(w: np.ndarray, owner: np.ndarray, levels: int = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, last) of the symbols after some rounds; words first to last (exclusive) are all that a symbol's name and ends depend on.

    What would reach beyond all words has -1 or len(w) + 1 there. Borders between documents count as words that no window holds.
    """
    name, own, n = w, owner, len(w)
    first, last = np.arange(n), np.arange(1, n + 1)
    for level in range(levels if n else 0):
        name, at = one_round(name, own, level)
        own = own[at]
        left = np.concatenate(([-1], first))[at]  # from the old symbol before to the one after
        right = np.append(last, n + 1)[np.append(at[1:], len(first))]
        first, last = left, right
    return name, first, last


def _hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the document) of all words."""
    size = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(size.sum())), np.repeat(np.arange(len(words)), size)


class Parse:
    """What the words of some documents say about their windows: names, hashes, and the segments of equal names.

    The documents are parsed as one sequence with a word of its own between any two, so the work on arrays is shared.
    No window spans such a word. `settled` are (documents, first words, numbers of words) of symbols; windows in them are left out.
    """

    def __init__(self, texts: list[str], window: int = WINDOW, settled: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.words = [t.encode().split() for t in texts]
        size = np.array([len(w) for w in self.words], np.int64)
        start = np.cumsum(np.append(0, size + 1))[:-1]
        n = int(size.sum()) + max(0, len(size) - 1)
        w, owner = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        between = np.ones(n, bool)
        between[start[1:] - 1] = False
        w[between], _ = _hashes(self.words)
        w[~between] = _mix(np.arange(max(0, len(size) - 1), dtype=np.uint64) + C4)
        count = np.maximum(0, size - window + 1)
        edges = np.cumsum(np.append(0, count))
        self.doc = np.repeat(np.arange(len(size)), count)
        at = np.repeat(start - edges[:-1], count) + np.arange(edges[-1])
        if settled is not None and len(settled[0]):
            doc, first, many = settled
            depth = np.zeros(n + 1, np.int64)
            np.add.at(depth, start[doc] + first, 1)
            np.add.at(depth, start[doc] + first + many - window + 1, -1)
            left = np.cumsum(depth)[at] == 0
            at, self.doc = at[left], self.doc[left]
        power = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(_BASE))))
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(_INVERSE))))
        self.sums = np.append(np.uint64(0), np.cumsum(w * power[:-1]))
        self.window = _mix(self.span(at, at + window))
        self.name = _mix(self.window ^ C4)  # stays for windows that hold no symbol with all that it depends on
        name, first, last = near_symbols(w, owner)
        inside = (first >= 0) & (last <= n)
        first, last = first[inside], last[inside]
        low, many = _mix(self.span(first, last) ^ (name[inside] * C3)), 1
        lo, hi = np.searchsorted(first, at), np.searchsorted(last, at + window, side="right")
        while len(low):  # least hash of the symbols lo to hi, from least hashes of 1, 2, 4, 8 neighbours
            some = np.flatnonzero((hi - lo >= many) & (hi - lo < 2 * many))
            self.name[some] = np.minimum(low[lo[some]], low[hi[some] - many])
            if 2 * many > window:
                break
            low, many = np.minimum(low[:-many], low[many:]), 2 * many
        new = np.append(True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1]) | (at[1:] != at[:-1] + 1))[: len(self.name)]
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(self.name))[: len(self.begin)]
        self.segment = _mix(self.span(at[self.begin], at[self.end - 1] + window) + self.name[self.begin] * C3)
        self.place = at - start[self.doc]  # of each window among its document's words

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a to b, wherever they stand."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * C4


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(flat: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), flat)


def _keys(part: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    """The columns KEY of some rows."""
    at = pa.array(rows)
    return [part.column(k).take(at) for k in KEY]


def _in_batches(df: DataFrame, fn, fields: str) -> DataFrame:
    """fn on some rows at a time, all of whose columns it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield fn(batch.slice(at, BATCH))

    return small_batches(df).mapInArrow(run, fields)


def _distinct(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of each equal (doc, value)."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    return order[np.append(True, (d[1:] != d[:-1]) | (v[1:] != v[:-1]))[: len(order)]]


def _owned(part: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """(all elements of a column of lists, numbers of their rows); a null is an empty list."""
    lists = part.column(column)
    size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return lists.flatten(), np.repeat(np.arange(part.num_rows), size)


SEQUENCE = f"{KEY_FIELDS}, names array<long>, sizes array<int>"


def _sequence(part: pa.RecordBatch, name: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    rows = part.num_rows
    lists = [_lists(_signed(name), owner, rows), _lists(pa.array(size.astype(np.int32)), owner, rows)]
    return pa.RecordBatch.from_arrays([*map(part.column, KEY), *lists], names=[*KEY, "names", "sizes"])


def first_rounds(docs: DataFrame, window: int, many: int) -> DataFrame:
    """The rows (KEY, t) with their words after the first rounds; rows without a window go."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        name, owner = _hashes([t.encode().split() for t in part.column("t").to_pylist()])
        return _sequence(part, *rounds(name, owner, np.ones(len(name), np.int64), 0, many))

    return _in_batches(docs.select(*KEY, "t"), run, SEQUENCE).filter(F.aggregate("sizes", F.lit(0), lambda s, x: s + x) >= window)


def more_rounds(sequences: DataFrame, first: int, many: int) -> DataFrame:
    """The sequences after further rounds."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, owner = _owned(part, "names")
        size = _owned(part, "sizes")[0].to_numpy(zero_copy_only=False).astype(np.int64)
        return _sequence(part, *rounds(flat.to_numpy(zero_copy_only=False).view(np.uint64), owner, size, first, many))

    return _in_batches(sequences.select(*KEY, "names", "sizes"), run, SEQUENCE)


def _high(sequences: DataFrame, window: int, last: bool = False) -> DataFrame:
    """(name, KEY, first, words) of the symbols that stand for a window or more; after the last round also of each whole sequence."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, owner = _owned(part, "names")
        size = _owned(part, "sizes")[0].to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        edge = np.append(0, upto)[np.searchsorted(owner, np.arange(part.num_rows))]
        some = np.flatnonzero(size >= window)
        name, of, first, words = flat.to_numpy(zero_copy_only=False).view(np.uint64)[some], owner[some], upto[some] - size[some] - edge[owner[some]], size[some]
        if last:
            begin = np.searchsorted(owner, np.arange(part.num_rows))
            place = (np.arange(len(owner)) - begin[owner]).astype(np.uint64)
            whole = np.add.reduceat(_mix(flat.to_numpy(zero_copy_only=False).view(np.uint64) + _mix(place + C2)), begin)
            rows = np.arange(part.num_rows)
            name, of = np.append(name, _mix(whole ^ C1)), np.append(of, rows)
            first, words = np.append(first, 0 * rows), np.append(words, np.add.reduceat(size, begin))
        columns = [_signed(name), *_keys(part, of), pa.array(first.astype(np.int32)), pa.array(words.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["name", *KEY, "first", "words"])

    return _in_batches(sequences.select(*KEY, "names", "sizes"), run, f"name long, {KEY_FIELDS}, first int, words int")


def settled_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(KEY, settled): for rows (KEY, t), the passages (first word, words) whose symbol a row with a smaller node holds too."""
    level, tables = FIRST, [cut(first_rounds(docs, window, FIRST), "rounds")]
    for _ in range(JOBS):
        tables.append(cut(more_rounds(tables[-1], level, STEP), "rounds"))
        level += STEP
    high = cut(reduce(DataFrame.unionByName, [_high(t, window, t is tables[-1]) for t in tables[2:]]), "high")  # symbols of earlier rounds are mostly shorter than two windows
    discard(*tables)
    least = cut(high.groupBy("name", "words").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least < most"), "least")
    found = join_keys(high, least, ["name", "words"], SENT).filter("node > least")
    out = cut(found.groupBy(*KEY).agg(F.collect_set(F.struct("first", "words")).alias("settled")), "settled")
    discard(high, least)
    return out


def _settled(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, owner = _owned(part, "settled")
    return owner, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "words"))


def _names(docs: DataFrame, window: int) -> DataFrame:
    """(name, KEY): the distinct names of each row's windows."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        p = Parse(part.column("t").to_pylist(), window, _settled(part))
        one = _distinct(p.doc[p.begin], p.name[p.begin])
        of = p.doc[p.begin[one]]
        return pa.RecordBatch.from_arrays([_signed(p.name[p.begin[one]]), *_keys(part, of)], names=["name", *KEY])

    return _in_batches(docs.select(*KEY, "t", "settled"), run, f"name long, {KEY_FIELDS}")


def _within(p: Parse, at: np.ndarray, value: np.ndarray, part: pa.RecordBatch, column: str) -> np.ndarray:
    """Whether each value, of a window or segment that begins at window `at`, is in its row's list."""
    flat, owner = _owned(part, column)
    known = flat.to_numpy(zero_copy_only=False).view(np.uint64)
    of, ok = p.doc[at], np.zeros(len(at), bool)
    edges, lists = np.searchsorted(of, np.arange(part.num_rows + 1)), np.searchsorted(owner, np.arange(part.num_rows + 1))
    for i in np.unique(owner).tolist():
        own = slice(edges[i], edges[i + 1])
        ok[own] = np.isin(value[own], known[lists[i] : lists[i + 1]])
    return ok


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """(KEY, name, segment, windows): the distinct segments whose name is in the row's list `shared`, with their windows' hashes."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        p = Parse(part.column("t").to_pylist(), window, _settled(part))
        one = np.flatnonzero(_within(p, p.begin, p.name[p.begin], part, "shared"))
        one = one[_distinct(p.doc[p.begin[one]], p.segment[one])]
        a, b = p.begin[one], p.end[one]
        offsets = np.append(0, np.cumsum(b - a))
        flat = p.window[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
        of = p.doc[a]
        columns = [*_keys(part, of), _signed(p.name[a]), _signed(p.segment[one]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(flat))]
        return pa.RecordBatch.from_arrays(columns, names=[*KEY, "name", "segment", "windows"])

    return _in_batches(docs.select(*KEY, "t", "settled", "shared"), run, f"{KEY_FIELDS}, name long, segment long, windows array<long>")


def _without(docs: DataFrame, id_type: str, window: int) -> DataFrame:
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, (doc, first, many) = part.column("t").to_pylist(), _settled(part)
        some = np.flatnonzero(part.column("gone").is_valid().to_numpy(zero_copy_only=False))  # only these have windows to look for
        number = np.full(len(texts), -1)
        number[some] = np.arange(len(some))
        own = number[doc] >= 0
        p = Parse([texts[i] for i in some.tolist()], window, (number[doc[own]], first[own], many[own]))
        few = part.take(pa.array(some))
        hit = _within(p, np.arange(len(p.window)), p.window, few, "gone") | np.repeat(_within(p, p.begin, p.segment, few, "gone"), p.end - p.begin)
        parsed = dict(zip(some.tolist(), p.words, strict=True))
        every = [parsed[i] if i in parsed else t.encode().split() for i, t in enumerate(texts)]
        size = np.array([len(w) for w in every], np.int64)
        start = np.cumsum(np.append(0, size))
        edge = np.zeros(start[-1] + 1, np.int64)
        at = start[some[p.doc[hit]]] + p.place[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        at = start[doc] + first
        np.add.at(edge, at, 1)
        np.add.at(edge, at + many, -1)
        left = np.cumsum(edge)[:-1] == 0
        n_kept = np.add.reduceat(np.append(left, False).astype(np.int64), start)[:-1] * (size > 0)
        kept = [b" ".join(words if n == len(words) else compress(words, left[a : a + len(words)].tolist())).decode() for words, a, n in zip(every, start.tolist(), n_kept.tolist(), strict=False)]
        columns = [part.column("doc_id"), pa.array(size), pa.array(size - n_kept), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return _in_batches(docs.select("doc_id", "t", "settled", "gone"), run, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")


def row_keys(rows: DataFrame) -> DataFrame:
    """rows (node, t) with what tells them apart: equal keys only for equal texts, but for a chance of 2^-64 a pair of one id, 2^-128 a pair without one."""
    return rows.withColumns({"h": F.xxhash64("t"), "g": F.when(F.col("node") == NO_ID, F.xxhash64(F.lit(7), "t")).otherwise(F.lit(0)).cast("long")})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words, one blank between).

    Removed is each word covered by a window of `window` words that also starts in a document with a smaller id. Windows are judged on
    the input. A null text has no words; a null id counts as the largest. Rows of one id, rows without one also, remove nothing from each other; they are told
    apart by 64 bits of hashes of their texts, rows without an id by 128, and equal ones share their results. Ids are integers. Other columns go, whatever their names. An empty table gives an empty result.
    """
    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("node"), F.coalesce(text, F.lit("")).alias("t"))
    ready, key = row_keys(ready), KEY
    slices = [F.pmod("name", F.lit(SLICES)) == k for k in range(SLICES)]
    settled = settled_passages(ready, window)
    known = ready.join(settled, key, "left")

    named, hits = cut(_names(known, window), "names"), []
    for own in slices:
        shared = cut(named.filter(own).groupBy("name").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("name"), "shared")
        hits.append(cut(named.filter(own).join(shared, "name").select(*KEY, "name"), "hits"))
        discard(shared)
    discard(named)
    lists = cut(reduce(DataFrame.unionByName, hits).groupBy(*key).agg(F.collect_set("name").alias("shared")), "lists")
    discard(*hits)
    segments = cut(_segments(known.join(lists, key), window), "segments")
    discard(lists)

    gone = []
    for own in slices:
        first = cut(segments.filter(own).groupBy("name", "segment").agg(F.min("node").alias("least"), F.count("*").alias("n")), "first")
        judged = join_keys(segments.filter(own), first, ["name", "segment"], SENT)
        judged = cut(judged.select(*key, "name", "segment", F.when(F.col("node") == F.col("least"), F.col("windows")).alias("windows")), "judged")
        whole = judged.filter("windows is null").select(*key, F.col("segment").alias("hash"))
        # Windows of a segment's first document; of those, the ones that an earlier document has in another segment.
        told = judged.filter("windows is not null").select(*key, "name", F.explode("windows").alias("hash"))
        least = cut(told.groupBy("name", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least < most"), "least")
        single = join_keys(told, least, ["name", "hash"], SENT).filter("node > least").select(*key, "hash")
        gone.append(cut(whole.unionByName(single), "gone"))
        discard(first, judged, least)
    discard(segments)
    rows = gone
    gone = cut(reduce(DataFrame.unionByName, rows).groupBy(*key).agg(F.collect_set("hash").alias("gone")), "gone")
    discard(*rows)
    id_type = ready.schema["doc_id"].dataType.simpleString()
    return _without(known.join(gone, key, "left"), id_type, window)


def op5_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

"""What the corpus operators share: table access, word rules and written cut points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from clausewright.sources.tables import BATCH_BYTES, cut, discard, shared_dir, small_batches  # noqa: F401

#: ASCII white space, and a word as a run of anything else (fixed by the query contracts).
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, unlike lower(), which follows Unicode."""
    return F.translate(text, UPPER, LOWER)


def quantile_cells(keys: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper ends of ranges of the column k, cells of each range and of the one beyond the last end), about `parts` cells of like size.

    Ends are quantiles. A value that is at several quantiles is a range by itself, of as many cells. What comes to the driver is bounded by parts.
    """
    cuts = keys.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    value, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    cells = {int(v): int(n) + (n > 1) for v, n in zip(value, times, strict=True)}
    for v in [v for v, n in cells.items() if n > 1 and v > -(2**63)]:
        cells.setdefault(v - 1, 1)
    ends = np.array(sorted(cells), np.int64)
    return ends, np.array([*(cells[v] for v in ends.tolist()), 1], np.int64)


def slices(sizes: np.ndarray, rows: int, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of at most `rows` values whose sizes come to at most `most`, or of one value that is larger."""
    upto, at = np.append(0, np.cumsum(sizes)), 0
    while at < len(sizes):
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1))
        yield at, end
        at = end


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Keys that are sent to every task at most.
SENT_KEYS = 200_000


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], most: int = SENT_KEYS) -> DataFrame:
    """rows joined with keys (on, n, ...) on the columns `on`; keys is a written table, n says how many rows have a key.

    Keys that hold at least 1 / most of all such rows are sent to every task; by arithmetic there are at most `most`. Rows of other keys
    are joined by a shuffle, in which no key has more than that share. Few keys are all sent.
    """
    kinds, total = keys.agg(F.count("*"), F.sum("n")).first()
    if kinds <= most:
        return rows.join(F.broadcast(keys.drop("n")), on)
    is_hot = F.col("n") * most >= total
    hot, rest = keys.filter(is_hot).drop("n"), keys.filter(~is_hot).drop("n")
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(cold.join(rest, on))


def with_python(df: DataFrame, text: str, fn: Callable[[list[str]], dict[str, Any]], fields: str, rows: int = 128, most: int = BATCH_BYTES) -> DataFrame:
    """Replaces the column text by the columns of the DDL string fields, which fn makes from lists of texts.

    Other columns pass through as Arrow arrays, so null ids and nested types stay what they are. fn sees at most `rows` texts and `most` bytes at a
    time, or one longer text, which bounds a worker's memory where texts are long.
    """
    added = StructType.fromDDL(fields)
    keep = [f for f in df.schema.fields if f.name != text]
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), rows, most):
                part = batch.slice(at, end - at)
                made = fn(part.column(text).to_pylist())
                arrays = [part.column(f.name) for f in keep] + [x if isinstance(x := made[n], pa.Array) else pa.array(x, kind) for n, kind in arrow]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in keep] + [n for n, _ in arrow])
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return small_batches(df).mapInArrow(run, StructType(keep + added.fields))


def in_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], fields: str, order: list[str] | None = None) -> DataFrame:
    """Runs fn on whole groups of equal keys (integers, not null), many small groups at a time; for groups that are bounded.

    fn gets a batch that holds groups one after another, sorted by `order` within each, and the row numbers where groups begin, with
    the batch's length at the end. A conversion for each group would cost more than most groups' work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.concat_batches([*rest, batch])
            cols = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
            begin = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))
            if begin[-1]:
                yield from fn(part.slice(0, begin[-1]), begin)
            rest = [part.slice(begin[-1])]
        if rest:
            yield from fn(rest[0], np.array([0, rest[0].num_rows]))
        rest.clear()
        pa.default_memory_pool().release_unused()  # workers stay for later tasks

    return small_batches(df).repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, fields)

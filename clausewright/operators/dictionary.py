"""Which terms of a dictionary texts contain: one automaton walk a text, in time that follows its length and not the number of terms.

Terms and texts come in groups (a document's own terms for its clauses, or a slice of a dictionary for all texts): rows of a group flow through one task, terms
first, and a task holds one group's automaton. A dictionary of any size is dealt into slices of bounded size; a single one is sent to where the texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from clausewright.sources.tables import cut, small_batches

#: Bytes of the terms of one slice: its automaton takes some tens of times as much.
SLICE_BYTES = 2**22


class Matcher:
    """Places of the terms that a text contains, in order. Terms and texts are compared as given; empty terms are in no text."""

    def __init__(self, terms: Iterable[str]) -> None:
        places: dict[str, list[int]] = {}
        for i, t in enumerate(terms):
            if t:
                places.setdefault(t, []).append(i)
        self.automaton = ahocorasick.Automaton() if places else None
        for t, own in places.items():
            self.automaton.add_word(t, own)
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        if not text or self.automaton is None:
            return []
        return sorted({i for _, own in self.automaton.iter(text) for i in own})


def match_flow(flow: DataFrame, by: str, side: str, term: str, key: str, text: str, into: str) -> DataFrame:
    """The rows of a flow that are texts (side 1), with the terms of their group that they contain as the array `into`.

    flow: partitions hold whole groups (`by`, not null), each group's terms (side 0) before its texts. Terms are found by their lower-case form
    `key` in the text's lower-case form, and given as `term`, in the order in which they came. The columns side, term and key go. A task holds the terms of one group and one batch of rows.
    """
    keep = [f for f in flow.schema.fields if f.name not in (side, term, key)]
    out = StructType([*keep, StructField(into, ArrayType(StringType()))])
    kind = to_arrow_type(ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms, keys, find = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, sides = batch.column(by).to_numpy(zero_copy_only=False), batch.column(side).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (sides[1:] != sides[:-1]), [True]])).tolist()
            found: list[list[str]] = []
            for a, b in zip(edges, edges[1:], strict=False):
                if group[a] != now:
                    now, terms, keys, find = group[a], [], [], None
                if sides[a] == 0:
                    terms += batch.column(term).slice(a, b - a).to_pylist()
                    keys += batch.column(key).slice(a, b - a).to_pylist()
                    find = None
                else:
                    find = find or Matcher(keys)
                    found += [[terms[i] for i in find(t.lower())] if terms and t else [] for t in batch.column(text).slice(a, b - a).to_pylist()]
            rows = pa.array(np.flatnonzero(sides == 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(rows) for f in keep), pa.array(found, kind)], names=out.names)

    return small_batches(flow).mapInArrow(run, out)


def contained_terms(texts: DataFrame, terms: DataFrame, key: str = "query_id", text: str = "transcript", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, known): the terms (term, place) that each text contains in any case, in order of place; texts without one are left out.

    terms: lower-case terms, each once, and something that orders them. They are summed up first: one slice's worth is sent to the texts, more of them are dealt into slices
    by their hash, and each slice gets all texts. They are written first, as they are read several times. Null and empty texts and terms contain nothing and are in nothing; rows of one key are one text each, and their terms are joined.
    """
    terms = cut(terms, "terms")  # what makes them may be long
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    slices = -(-size // slice_bytes)
    asked = texts.select(key, F.trim(text).alias("t")).filter(F.length("t") > 0)
    kinds = dict(asked.dtypes)
    if slices <= 1:
        ordered = [r["term"] for r in terms.filter(F.col("term") != "").orderBy("place", "term").select("term").collect()]  # of slice_bytes
        shared = texts.sparkSession.sparkContext.broadcast(ordered)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Matcher(shared.value)
            for batch in batches:
                found = [find(t.lower()) for t in batch.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([[shared.value[i] for i in x] for x in found], pa.list_(pa.string())), pa.array(found, pa.list_(pa.int64()))], names=[key, "own", "at"])

        got = asked.mapInArrow(run, StructType([asked.schema[key], StructField("own", ArrayType(StringType())), StructField("at", ArrayType(LongType()))]))
        each = got.select(key, F.explode(F.arrays_zip("at", "own")).alias("x"))
        return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("x.at").alias("place"), F.col("x.own").alias("term")))), lambda x: x["term"]).alias("known"))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int").alias("part")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    held = terms.filter(F.col("term") != "").select(part("term"), F.lit(0).alias("side"), "term", F.col("term").alias("low"), none(key, kinds[key]), none("t", "string"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))).alias("part"), F.lit(1).alias("side"), none("term", "string"), none("low", "string"), key, "t")
    flow = held.unionByName(sent).repartitionById(int(slices), "part").sortWithinPartitions("part", "side")
    found = match_flow(flow, "part", "side", "term", "low", "t", "own").select(key, F.explode("own").alias("term"))
    named = found.distinct().join(terms, "term")
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("known"))

"""Blocks to clauses: ordered rules with headings carried forward, continuations joined, short units merged.

Blocks get the number of their document's row, by which they are shuffled; so documents with null or equal ids stay apart. Units then flow through
their partition in order: a state of a few numbers tells which are merged, and a second pass over the same partition finds each document's defined terms in its
clauses. A document of a million blocks is never one row, and a task holds one clause, a batch and the document's terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clausewright import settings as S
from clausewright.functions import text as T
from clausewright.operators.dictionary import match_flow
from clausewright.operators.documents import block_rows
from clausewright.sources.tables import small_batches

# The forms of headings and clauses, in the order in which they are tried.
ARTICLE = r"(?i)^ARTICLE\s+[IVXLC]+(?:\s*[—–-]\s*.+)?$"
SECTION = r"(?i)^SECTION\s+([\d.]+)\s*.*$"
DEFINED = r'^"([A-Z][\w\s-]+)"\s+(?:means|shall mean)'
LETTERED = r"(?i)^(?:§\s*)?(\d+(?:\.\d+)+)\s*\(([a-z0-9]+)\)\s+.+$"
DECIMAL = r"^(?:§\s*)?(\d+(?:\.\d+)+)\s+.+$"
ALPHA = r"(?i)^\(([a-z])\)\s+.+$"


class MidSentenceSplit(ValueError):
    """A clause ends within a sentence."""


def units(parsed: DataFrame) -> DataFrame:
    """(row, doc_id, doc_title, seq, path, label, trail, page_start, page_end, text, is_definition) from parsed documents; their titles are null where they have no column title."""
    title = F.col("title").cast("string") if "title" in parsed.columns else F.lit(None).cast("string")
    b = block_rows(parsed.select(F.monotonically_increasing_id().alias("row"), "doc_id", title.alias("doc_title"), "blocks"))
    t = F.col("text")
    kind = (
        F.when(t.rlike(ARTICLE), "article")
        .when(t.rlike(SECTION) & (T.word_count(t) <= 12) & ~t.endswith("."), "section")
        .when(t.rlike(DEFINED), "defined")
        .when(t.rlike(LETTERED), "lettered")
        .when(t.rlike(DECIMAL), "decimal")
        .when(t.rlike(ALPHA), "alpha")
        .when(t.rlike("(?i)^TERM SHEET") & ~t.endswith("."), "skip")
        .otherwise("more")
    )
    b = b.withColumn("kind", kind)
    w = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda value, default: F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default))
    number = F.when(F.col("kind") == "section", F.regexp_extract(t, SECTION, 1)).when(F.col("kind") == "decimal", F.regexp_extract(t, DECIMAL, 1))
    b = b.withColumns({
        "article": carried(F.when(F.col("kind") == "article", t), "ARTICLE I — GENERAL"), "section": carried(F.when(F.col("kind") == "section", t), "General Provisions"),
        "number": carried(number, "1"), "unit": F.sum(F.col("kind").isin("defined", "lettered", "decimal", "alpha").cast("int")).over(w),
    }).filter("unit > 0 AND kind NOT IN ('article', 'section', 'skip')")
    term, letter = F.regexp_extract(t, DEFINED, 1), F.lower(F.regexp_extract(t, ALPHA, 1))
    by = lambda defined, lettered, decimal, alpha: F.when(F.col("kind") == "defined", defined).when(F.col("kind") == "lettered", lettered).when(F.col("kind") == "decimal", decimal).when(F.col("kind") == "alpha", alpha)
    one, two, ten = F.regexp_extract(t, LETTERED, 1), F.regexp_extract(t, LETTERED, 2), F.regexp_extract(t, DECIMAL, 1)
    path = by(F.array(F.lit("def"), T.slug(term)), F.concat(F.split(one, r"\."), F.array(two)), F.split(ten, r"\."), F.concat(F.split("number", r"\."), F.array(letter)))
    label = by(F.concat(F.lit('§1.1 ("'), term, F.lit('")')), F.concat(F.lit("§"), one, F.lit("("), two, F.lit(")")), F.concat(F.lit("§"), ten), F.concat(F.lit("§"), F.col("number"), F.lit("("), letter, F.lit(")")))
    trail = F.array(F.col("article"), F.when(F.col("kind") == "defined", F.lit("Definitions")).otherwise(F.col("section")))
    head = F.when(F.col("kind") != "more", F.struct(path.alias("path"), label.alias("label"), trail.alias("trail"), (F.col("kind") == "defined").alias("is_definition")))
    got = b.select("row", "doc_id", "doc_title", "unit", head.alias("head"), F.struct("place", "page", "text").alias("r"))
    got = got.groupBy("row", "unit").agg(F.first("doc_id").alias("doc_id"), F.first("doc_title").alias("doc_title"), F.max("head").alias("h"), F.array_sort(F.collect_list("r")).alias("rs"))
    return got.select("row", "doc_id", "doc_title", F.col("unit").alias("seq"), "h.path", "h.label", "h.trail", F.col("rs")[0]["page"].alias("page_start"), F.element_at("rs", -1)["page"].alias("page_end"), F.array_join(F.transform("rs", lambda r: r["text"]), " ").alias("text"), "h.is_definition")


#: What stands between quotation marks as a term does; white space as Java's \\s.
QUOTED = re.compile(r'"([A-Z][A-Za-z0-9 \t\n\x0b\f\r-]{1,35})"')


def fold(rows: list[int], words: list[int], closed: list[bool], short: int = S.SHORT_UNIT, most: int = S.MAX_UNIT) -> tuple[list[int], list[int]]:
    """(where each clause begins, its words) of units in order, by their document's row, their words and whether they are definitions: units of few words go in front of the next one, which may pass them on."""
    starts: list[int] = []
    totals: list[int] = []
    for i, n in enumerate(words):
        if starts and rows[i] == rows[i - 1] and not closed[i] and not closed[i - 1] and totals[-1] < short and totals[-1] + n <= most:
            totals[-1] += n
        else:
            starts.append(i)
            totals.append(n)
    return starts, totals


def clause_flow(unit_rows: DataFrame, short: int = S.SHORT_UNIT, most: int = S.MAX_UNIT) -> DataFrame:
    """(row, side, at, term, key, doc_id, doc_title, seq, page_start, page_end, text, path, label, trail, is_definition, words): clauses (side 1) of merged units, see fold(), and each
    document's quoted terms with their lower-case form (side 0) and place (seq, at); the same partition holds all of a document.
    """
    if "doc_title" not in unit_rows.columns:
        unit_rows = unit_rows.withColumn("doc_title", F.lit(None).cast("string"))
    kinds = {f.name: f.dataType for f in unit_rows.schema.fields}
    fields = StructType.fromDDL("row long, side int, at int, term string, key string").add("doc_id", kinds["doc_id"])
    fields = StructType([*fields.fields, *StructType.fromDDL("doc_title string, seq int, page_start int, page_end int, text string, path array<string>, label string, trail array<string>, is_definition boolean, words int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seq, known = None, 0, set()  # of the document that the last clause is of
        held = None  # the units of a clause that isn't finished

        def table(n: int, of: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x := of.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in schema], schema=schema)

        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            units = batch if held is None else held if batch is None else pa.concat_batches([held, batch])
            if units is None:
                return
            docs, texts = units.column("row").to_pylist(), units.column("text").to_pylist()
            starts, totals = fold(docs, [len(t.encode().split()) for t in texts], units.column("is_definition").to_pylist(), short, most)
            ends = [*starts[1:], len(docs)]
            if batch is not None:  # its last clause may go on in the next one
                held = units.slice(starts.pop())
                ends.pop()
                totals.pop()
            if not starts:
                continue
            merged, seqs, terms = [], [], []
            for a, b in zip(starts, ends, strict=True):
                if docs[a] != row:
                    row, seq, known = docs[a], 0, set()
                text = texts[a] if b - a == 1 else " ".join(texts[a:b])
                for at, term in enumerate(QUOTED.findall(text)):
                    if term not in known:
                        known.add(term)
                        terms.append((row, seq, at, term))
                merged.append(text)
                seqs.append(seq)
                seq += 1
            if terms:
                of, places, ats, own = zip(*terms, strict=True)
                yield table(len(terms), {"row": of, "side": [0] * len(of), "seq": places, "at": ats, "term": own, "key": [t.lower() for t in own]})
            first, last = pa.array(starts), pa.array([b - 1 for b in ends])
            pages = np.minimum.reduceat(units.column("page_start").to_numpy(zero_copy_only=False)[: ends[-1]], starts)
            same = {c: units.column(c).take(first) for c in ("row", "doc_id", "doc_title")} | {c: units.column(c).take(last) for c in ("page_end", "path", "label", "trail", "is_definition")}
            yield table(len(starts), same | {"side": [1] * len(starts), "seq": seqs, "at": [0] * len(starts), "page_start": pages, "text": merged, "words": totals})

    schema = to_arrow_schema(fields)
    return small_batches(unit_rows.repartition("row").sortWithinPartitions("row", "seq")).mapInArrow(run, fields)


def merge_short(unit_rows: DataFrame, short: int = S.SHORT_UNIT, most: int = S.MAX_UNIT) -> DataFrame:
    """(row, doc_id, doc_title, seq, page_start, page_end, text, path, label, trail, is_definition, words): units of few words in front of the next one, which may pass them on."""
    return clause_flow(unit_rows, short, most).filter("side = 1").drop("side", "at", "term", "key")


def ends_whole(text: Column) -> Column:
    """Whether a clause ends as a sentence may."""
    return F.right(F.trim(text), F.lit(1)).isin(".", ";", ":", '"', "'", ")")


def whole(chunk_rows: DataFrame, strict: bool = False) -> DataFrame:
    """The clauses that end as a sentence may; strict: the job fails at the first other one."""
    good = ends_whole(F.col("text"))
    if not strict:
        return chunk_rows.filter(good)
    said = F.concat(F.lit("clause cut within a sentence: "), F.col("clause_label"), F.lit(" ... "), F.right(F.trim("text"), F.lit(50)))
    return chunk_rows.filter(F.when(~good, F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def chunks(unit_rows: DataFrame) -> DataFrame:
    """The clause table: labels, references, defined terms of the document, signals and the order within the document."""
    flow = clause_flow(unit_rows).sortWithinPartitions("row", "side", "seq", "at")  # a document's terms before its clauses, where they are
    out = match_flow(flow, "row", "side", "term", "key", "text", "terms_here").drop("at")
    t = F.col("text")
    return out.select(
        F.concat_ws("::", F.col("doc_id").cast("string"), F.array_join("path", ".")).alias("id"), "row", "doc_id", "doc_title", F.col("path").alias("clause_path"), F.col("label").alias("clause_label"), F.col("trail").alias("heading_trail"),
        "page_start", "page_end", "text", F.length(t).alias("char_count"), F.col("words").alias("token_count"), T.cross_refs(t, F.col("label")).alias("cross_refs"),
        F.col("terms_here").alias("defined_terms"), T.signals(t).alias("signals"), F.col("seq").alias("vector_offset"), embedding_text(F.col("trail"), F.col("label"), t).alias("embedding_text"),
    )


def embedding_text(trail: Column, label: Column, text: Column) -> Column:
    """What a clause is embedded as: its headings, label and text."""
    return F.concat(F.array_join(trail, " > "), F.lit(" — "), label, F.lit(" "), text)


def searched(chunk_rows: DataFrame, wanted: str) -> DataFrame:
    """Clauses whose text or label contains what is wanted, in any case."""
    low = F.lower(F.lit(wanted))
    return chunk_rows.filter(F.contains(F.lower("text"), low) | F.contains(F.lower("clause_label"), low))


def corpus_terms(chunk_rows: DataFrame) -> DataFrame:
    """(term, place): the defined terms of all clauses in lower case, each once, and where in the corpus it stands first."""
    each = chunk_rows.select("doc_id", "vector_offset", F.posexplode("defined_terms").alias("at", "t"))
    return each.groupBy(F.lower("t").alias("term")).agg(F.min(F.struct("doc_id", "vector_offset", "at")).alias("place"))


def as_clauses(chunk_rows: DataFrame) -> DataFrame:
    """Clauses as reference expansion, stance and search take them: id, doc (the document's row, so equal and missing ids stay apart), label, refs, seq, text and flat signals."""
    s = F.col("signals")
    return chunk_rows.select(
        "id", F.col("row").alias("doc"), F.col("clause_label").alias("label"), F.col("cross_refs").alias("refs"), F.struct("doc_id", "vector_offset").alias("seq"), "text",
        *(s[c].alias(c) for c in ("has_exception", "has_obligation", "has_definition", "has_remedy", "matched_markers")),
    )

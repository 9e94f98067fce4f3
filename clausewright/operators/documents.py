"""Texts to pages and blocks. A document stays one row: its lines, pages and blocks are arrays, so nothing is shuffled and rows need no id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import text as T


class ScannedDocument(ValueError):
    """Pages hold too little text; reading images is out of scope."""


def pages(text: Column, per_page: int = S.PAGE_LINES) -> Column:
    """Array of a text's pages: what lies between break markers where it has any, else every per_page lines."""
    by_lines = T.let(F.split(text, r"\r?\n", -1), lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / per_page).cast("int")), lambda i: F.array_join(F.slice(ls, i * per_page + 1, F.lit(per_page)), "\n")))
    return F.when(F.contains(text, F.lit(S.PAGE_BREAK)), F.split(text, S.PAGE_BREAK, -1)).otherwise(by_lines)


#: What a heading may begin with; other lines needn't be held against the patterns.
FIRSTS = '#AaSs0123456789("'


def is_heading(line: Column) -> Column:
    return F.contains(F.lit(FIRSTS), F.substring(line, 1, 1)) & reduce(lambda a, b: a | b, [line.rlike(p) for p in S.HEADINGS])


def page_blocks(page: Column) -> Column:
    """Array of a page's paragraphs (line_no, text, font_size, bold): blank lines and headings start one."""

    def block(ls: Column, at: Column, stop: Column) -> Column:
        first, heading = F.get(ls, at)["x"], F.get(ls, at)["heading"]
        clean = F.when(first.startswith("#"), F.regexp_replace(first, S.HASHES, "")).otherwise(first)
        body = F.array_join(F.concat(F.array(clean), F.transform(F.slice(ls, at + 2, F.greatest(stop - at - 1, F.lit(0))), lambda l: l["x"])), " ")
        size = F.when(~heading, 11.0).when(clean.rlike("(?i)^article"), 14.0).when(clean.rlike("(?i)^section"), 12.5).otherwise(11.0)
        return F.struct(at.alias("line_no"), T.dehyphenate(body).alias("text"), size.alias("font_size"), (heading & clean.rlike("(?i)^article|section")).alias("bold"))

    def found(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(ls, i)["x"] == "") | (i == 0) | (F.get(ls, i - 1)["x"] == "") | F.get(ls, i)["heading"])
        return T.let(starts, lambda at: F.filter(F.transform(at, lambda s, k: block(ls, s, F.coalesce(F.get(at, k + 1), n))), lambda b: b["text"] != ""))

    marked = lambda x: F.struct(x.alias("x"), is_heading(x).alias("heading"))
    return T.let(F.transform(F.transform(F.split(page, r"\r?\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), marked), found)


def strip_repeats(blocks: Column, n_pages: Column) -> Column:
    """The blocks without headers that recur on most pages, where a document has three pages or more."""
    least = F.ceil(n_pages * F.lit(S.HEADER_SHARE)).cast("int")
    often = lambda bs: T.let(F.array_sort(F.transform(bs, lambda b: F.lower(b["text"]))), lambda low: F.array_distinct(F.filter(low, lambda x, i: F.get(low, i + least - 1) == x)))
    return F.when(n_pages < 3, blocks).otherwise(T.let(blocks, lambda bs: T.let(often(bs), lambda out: F.filter(bs, lambda b: ~F.array_contains(out, F.lower(b["text"]))))))


def poor_pages(page_texts: Column) -> Column:
    """How many pages have few characters."""
    return F.size(F.filter(page_texts, lambda p: F.length(F.regexp_replace(p, r"\s+", "")) < S.SCANNED_CHARS))


def parse(docs: DataFrame, text: str = "text", per_page: int = S.PAGE_LINES) -> DataFrame:
    """docs, without their text, with page_count, poor_pages, rejected, blocks (page, line_no, text, font_size, bold) and sha256 of the blocks' texts.

    A null text is one empty page, and so rejected. Rows are worked on alone; other columns stay, ids may be null or repeated.
    """
    own = T.free(docs, "__pages")
    ready = docs.withColumn(own, pages(F.coalesce(text, F.lit("")), per_page))
    on_page = lambda p, i: F.transform(page_blocks(p), lambda b: F.struct((i + 1).alias("page"), b["line_no"].alias("line_no"), b["text"].alias("text"), b["font_size"].alias("font_size"), b["bold"].alias("bold")))
    n = F.size(own)
    ready = ready.withColumns({"page_count": n, "poor_pages": poor_pages(F.col(own)), "blocks": strip_repeats(F.flatten(F.transform(own, on_page)), n)})
    ready = ready.withColumn("rejected", F.col("poor_pages") / F.col("page_count") > S.SCANNED_SHARE)
    return ready.withColumn("sha256", F.sha2(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"), 256)).drop(own, text)


def accepted(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """The documents with enough text; strict: the job fails at the first other one."""
    if not strict:
        return parsed.filter(~F.col("rejected"))
    said = F.concat(F.lit("scanned document: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit(", pages with little text "), F.concat_ws("/", F.col("poor_pages").cast("string"), F.col("page_count").cast("string")))
    return parsed.filter(F.when(F.col("rejected"), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))


def quarantined(parsed: DataFrame) -> DataFrame:
    """The documents that accepted() leaves out, with the reason."""
    return parsed.filter("rejected").withColumn("reason", F.lit("scanned_document"))


def block_rows(parsed: DataFrame) -> DataFrame:
    """A row per block, with the document's columns and the block's place.

    The outer form keeps Spark from testing beforehand whether there are blocks, for which it would work them all out once more.
    """
    return parsed.select("*", F.posexplode_outer("blocks").alias("place", "b")).drop("blocks").filter("place IS NOT NULL").select("*", "b.*").drop("b")

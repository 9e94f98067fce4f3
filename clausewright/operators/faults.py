"""Faults of documents and clauses as codes in a column, counted while the rows are written: one pass, with what is refused beside what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.operators.clauses import ends_whole

# The codes.
SCANNED, MID_SENTENCE, OVERSIZED, EMPTY = "scanned_document", "mid_sentence_split", "oversized_atomic_chunk", "parse_failure"


def document_fault(parsed: DataFrame) -> DataFrame:
    """parsed documents with fault: scanned ones, ones of which no block is left, or null."""
    return parsed.withColumn("fault", F.when(F.col("rejected"), SCANNED).when(F.size("blocks") == 0, EMPTY))


def clause_fault(chunk_rows: DataFrame, most: int = S.MAX_UNIT) -> DataFrame:
    """Clauses with fault: those cut within a sentence, else those of more words than a unit may have, or null."""
    return chunk_rows.withColumn("fault", F.when(~ends_whole(F.col("text")), MID_SENTENCE).when(F.col("token_count") > most, OVERSIZED))


def counted(rows: DataFrame, codes: list[str], name: str) -> tuple[DataFrame, Observation]:
    """(rows, an observation that has, once they have been written, their number and that of each code): rows, kept and the codes."""
    fault: Column = F.col("fault")
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(fault.isNull()).alias("kept"), *[F.count_if(F.coalesce(fault == c, F.lit(False))).alias(c) for c in codes]), seen


def write_apart(rows: DataFrame, path: str, codes: list[str], name: str = "faults") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(what is kept, what is refused with its fault, counts): rows with a column fault are written once, in folders of their own, and counted on the way."""
    watched, seen = counted(rows, codes, name)
    watched.withColumn("refused", F.col("fault").isNotNull()).write.partitionBy("refused").parquet(path)
    spark = rows.sparkSession
    back = spark.read.schema(rows.schema.add("refused", "boolean")).option("basePath", path).parquet(path)
    return back.filter("NOT refused").drop("refused", "fault"), back.filter("refused").drop("refused"), seen.get

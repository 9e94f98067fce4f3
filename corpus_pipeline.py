"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import cut, discard, table
from clausewright.llm.line_dedup import dedup_lines
from clausewright.llm.mixing import mix_documents
from clausewright.llm.near_dup import drop_near_duplicates
from clausewright.llm.packing import default_tokenizer, digest, pack_documents
from clausewright.llm.toxicity import drop_toxic, fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model scores as toxic go; it is fitted on labelled rows of docs.

    Rows without text or id, with repeated ids and repeated rows are judged by their texts alone; those without words stay. Other columns than COLUMNS go, here and in
    all stages, so none can clash. An empty table gives an empty one, in all stages.
    """
    return drop_toxic(docs.select(COLUMNS), fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go; n_chars follows, and texts of which nothing is left stay as empty ones.

    Every row counts as a document, null ids and repeated rows too; a null text is one empty line and becomes an empty text.
    """
    return dedup_lines(docs.select(COLUMNS)).withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, likeness 0.8 or more.

    Of repeated rows one stays; rows without an id lose to rows with one; texts without words, null ones too, are in no group and stay.
    """
    return drop_near_duplicates(docs.select(COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; texts without words, null ones too, have no part in a mix and go.

    Null sources are one source, the last. Rows are told apart by id and text; equal rows are repeated alike.
    """
    return mix_documents(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the curve together; every row is packed by itself, one without text as its end mark."""
    return digest(pack_documents(docs.select(COLUMNS), default_tokenizer()))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the trained scores and tokens; tests/llm/test_pipeline.py holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

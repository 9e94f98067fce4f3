"""From live speech to answers: each micro-batch of utterances goes through the batched query path, once.

The sink writes a micro-batch's cards, and the history of the newest queries, to folders named by the batch's number. A batch that is run again, after a failure or on purpose, overwrites what it
wrote and starts from the history of the batch before it, so nothing is doubled or lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.plans import retrieval as R
from clausewright.sources.tables import passing

#: How many queries a history shows.
MOST = 100
CARD = ["query_id", "id", "final_rank", "fused", "best_cosine", "best_kind", "xref_from", "stance", "stance_confidence", "reasons", "matched_terms"]


def queries_of(utterances: DataFrame, provisional: bool = False) -> DataFrame:
    """(query_id, at, transcript, asr_mean_logprob, asr_no_speech_prob, snr_db) from utterances: final ones, and provisional ones if asked for. The id is stream and start."""
    told = T.recognised(F.col("text"), F.col("rms"), F.col("audio_ms"))
    rows = utterances if provisional else utterances.filter(~F.col("is_provisional"))
    name = F.concat_ws(":", F.col("stream_id").cast("string"), F.col("start").cast("string"), F.when(F.col("is_provisional"), F.lit("partial")))
    return rows.select(name.alias("query_id"), F.col("stop").alias("at"), F.col("text").alias("transcript"), told["mean_logprob"].alias("asr_mean_logprob"), told["no_speech"].alias("asr_no_speech_prob"), "snr_db")


def merged(before: DataFrame | None, new: DataFrame, most: int = MOST) -> DataFrame:
    """The newest rows by (at, query_id) of a history and new rows; of one query_id the new row, or among new ones the latest, stays."""
    rows = new.withColumn("__new", F.lit(1)) if before is None else before.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in new.columns if c != "query_id"]
    last = rows.groupBy("query_id").agg(F.max_by(F.struct(*rest), F.struct("__new", "at")).alias("r")).select("query_id", "r.*")
    return last.orderBy(F.desc("at"), F.desc("query_id")).limit(most)


class AnswerSink:
    """What foreachBatch calls with queries as queries_of() gives them. path is a folder that driver and executors share; chunk_rows a written table of clauses."""

    def __init__(self, path: str, chunk_rows: DataFrame, embed: Callable[[Column], Column], backend: str = "flat", most: int = MOST) -> None:
        self.path, self.chunk_rows, self.embed, self.backend, self.most = path, chunk_rows, embed, backend, most
        self.known = None  # the terms and vectors of the clauses, worked out for the first batch

    def _fs(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def batches(self, spark: SparkSession, part: str) -> list[int]:
        """Numbers of the batches whose part was written whole."""
        fs, path = self._fs(spark)
        found = fs.globStatus(path(f"{self.path}/{part}/batch=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)

    def __call__(self, queries: DataFrame, batch: int) -> None:
        spark = queries.sparkSession
        if queries.isEmpty():
            return
        asked = self.path + f"/asked/batch={batch}"
        queries.write.mode("overwrite").parquet(asked)  # the plan behind a micro-batch runs once
        asked = spark.read.schema(queries.schema).parquet(asked)
        ranked_path = f"{self.path}/ranked/batch={batch}"
        self.known = self.known or R.prepared(self.chunk_rows, self.embed, self.backend)
        with passing():  # a stream may have any number of batches
            R.answer(asked.drop("at"), self.chunk_rows, self.embed, self.backend, self.known).write.mode("overwrite").parquet(ranked_path)
        ranked = spark.read.parquet(ranked_path)
        R.cards(ranked).select(*CARD).write.mode("overwrite").parquet(f"{self.path}/cards/batch={batch}")
        top = ranked.filter("final_rank = 1").select("query_id", F.col("id").alias("top_id"))
        told = asked.select("query_id", "at", "transcript").join(R.verdicts(asked.drop("at"), ranked), "query_id").join(top, "query_id", "left")
        earlier = [b for b in self.batches(spark, "history") if b < batch]
        before = spark.read.parquet(f"{self.path}/history/batch={earlier[-1]}") if earlier else None
        merged(before, told, self.most).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/history/batch={batch}")
        fs, path = self._fs(spark)
        for part, keep in (("asked", []), ("ranked", []), ("history", [*earlier[-1:], batch])):  # a repeated batch needs the one before
            for old in [b for b in self.batches(spark, part) if b not in keep and b <= batch]:
                fs.delete(path(f"{self.path}/{part}/batch={old}"), True)

    def cards(self, spark: SparkSession) -> DataFrame:
        """All cards so far, with the number of their batch."""
        return spark.read.parquet(f"{self.path}/cards")

    def history(self, spark: SparkSession) -> DataFrame:
        """The newest queries with verdict and first card, newest first."""
        return spark.read.parquet(f"{self.path}/history/batch={self.batches(spark, 'history')[-1]}").orderBy(F.desc("at"), F.desc("query_id"))


def answer_stream(utterances: DataFrame, sink: AnswerSink, checkpoint: str, provisional: bool = False):
    """A writer, to be started: utterances of a stream, answered batch by batch."""
    return queries_of(utterances, provisional).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)

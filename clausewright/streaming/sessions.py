"""Sessions, latest frames and double taps, as window functions that run alike on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n): rows less than a gap apart; also streams, given a watermark."""
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("w")


def latest(rows: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each key: what a ring buffer of n holds."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n)


def double_taps(rows: DataFrame, key: str, ts_ms: str, tie: str, least: float = 60, most: float = 400) -> DataFrame:
    """Rows that complete a double tap. After one the detector starts anew, so in a chain of close taps every second one counts."""
    w = Window.partitionBy(key).orderBy(ts_ms, tie)
    gap = F.col(ts_ms) - F.lag(ts_ms).over(w)
    chained = rows.withColumn("__new", F.when(gap.between(least, most), 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(w))
    place = F.row_number().over(Window.partitionBy(key, "__chain").orderBy(ts_ms, tie))
    return chained.withColumn("__place", place).filter("__place % 2 = 0").drop("__new", "__chain", "__place")


def history(rows: DataFrame, ts: str, tie: str, most: int = 100) -> DataFrame:
    """The newest rows, newest first: what a history of bounded length shows."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(most)

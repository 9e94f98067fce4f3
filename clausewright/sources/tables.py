"""Written cut points: tables in the folder that driver and executors share.

What a plan is done with, discard() deletes. A table that a returned result still reads can't go before that result has been used, so the driver deletes those it has left when it ends, or sweep() before.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: What this driver has written and not yet deleted, by the last part of its folder's name.
_left: dict[str, tuple[SparkSession, str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path.rpartition("/")[2]] = spark, path
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _left.pop(path.rpartition("/")[2], None)


#: What this thread has written within passing().
_made: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def passing():
    """Deletes at its end what this thread wrote within; all that is made from it must be written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for spark, path in _made.get():
            _delete(spark, path)
        _made.reset(token)


def sweep() -> None:
    """Deletes what has been written here and is still there; results that read it can't be used any more."""
    for spark, path in list(_left.values()):
        with contextlib.suppress(Exception):  # the session may have ended, with its JVM
            _delete(spark, path)


atexit.register(sweep)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    Later jobs start from the files, so a lost executor costs only the tasks it ran, and
    a plan that is used several times runs once. Shuffle files of the write go when it has ended.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once all that is made from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(spark, path)


#: Bytes of an Arrow batch, and of the texts that a Python function sees at once, beyond which no further row is added.
BATCH_BYTES = 2**24


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands tasks' rows to Python in Arrow batches of at most 1,000 rows and some 16 MB, if it had Spark's own limits.

    Texts and arrays are long rows, and a batch is held several times on its way; rows alone don't bound it. Results don't depend on these settings.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df

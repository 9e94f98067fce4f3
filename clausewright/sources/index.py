"""An index as a folder: clauses with vectors as Parquet files, and a manifest whose hash tree covers every byte of them.

Each file's SHA-256 is a leaf, in order of the files' names; a node is the hash of up to FAN hashes below it, level by level up to one root, which a small JSON file names with model, dimensions
and counts. Writing and checking read each file once, in parallel; the tree is made by grouping, so no task and not the driver sees more than FAN hashes of it at a time. A change of any column of
any row, its vector included, changes its file's leaf, and the check names the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
FAN = 256  # children of a node
FILE_ROWS = 1_000_000  # rows of a file at most, as a task that hashes it holds it whole
NAMED = 10  # damaged files that an error names


class InvalidIndex(ValueError):
    """The folder isn't an index."""


class UnsupportedVersion(InvalidIndex):
    """An index of a version that this library doesn't read."""


class CorruptIndex(InvalidIndex):
    """Files are missing, added or changed, or don't hold what the manifest says; `files` has some of their names."""

    def __init__(self, message: str, files: list[str] | None = None) -> None:
        super().__init__(message)
        self.files = files or []


class ModelMismatch(ValueError):
    """The index was made with another model."""


class DimensionMismatch(ValueError):
    """The model has another number of dimensions than the index."""


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the index's data files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{path}/chunks")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree(files: DataFrame) -> DataFrame:
    """(level, i, sha256): leaves are level 0 in order of their files' names, the root is alone at the last level. Without files the root is the hash of nothing."""
    spark = files.sparkSession
    level = files.select((F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("i"), "sha256")  # a row a file
    n, depth = files.count(), 0
    if not n:
        return spark.range(1).select(F.lit(0).alias("level"), F.col("id").alias("i"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    all_ = level.withColumn("level", F.lit(0))
    while n > 1:
        depth, n = depth + 1, -(-n // FAN)
        below = F.transform(F.array_sort(F.collect_list(F.struct("i", "sha256"))), lambda x: x["sha256"])
        level = level.groupBy(F.floor(F.col("i") / FAN).alias("up")).agg(F.sha2(F.array_join(below, "").cast("binary"), 256).alias("sha256")).withColumnRenamed("up", "i")
        all_ = all_.unionByName(level.withColumn("level", F.lit(depth)))
    return all_.select("level", "i", "sha256")


def root_of(files: DataFrame) -> str:
    return tree(files).orderBy(F.desc("level")).first()["sha256"]


def write_index(chunks: DataFrame, path: str, fingerprint: str, dimensions: int, file_rows: int = FILE_ROWS) -> None:
    """Writes clauses (embedding array, and any columns) and the manifest: files with their hashes, and what the reader asks for first."""
    spark = chunks.sparkSession
    chunks.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/chunks")
    leaves(spark, path).write.parquet(f"{path}/manifest/files")
    files = spark.read.parquet(f"{path}/manifest/files")
    told = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunk_count"))
    head = told.select(F.lit(VERSION).alias("version"), F.lit(fingerprint).alias("fingerprint"), F.lit(dimensions).alias("dimensions"), "chunk_count", F.lit(root_of(files)).alias("root"))
    head.coalesce(1).write.json(f"{path}/manifest/head")


HEAD = "version int, fingerprint string, dimensions int, chunk_count long, root string"


def read_head(spark: SparkSession, path: str):
    """The manifest's head; InvalidIndex if there is none that can be read, UnsupportedVersion if it is another version's."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/head")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        raise InvalidIndex(f"{path} has no manifest")
    head = spark.read.schema(HEAD).json(f"{path}/manifest/head").first()
    if head is None or head["version"] is None:
        raise InvalidIndex(f"{path} has a manifest that can't be read")
    if head["version"] != VERSION:
        raise UnsupportedVersion(f"{path} is of version {head['version']}, not {VERSION}")
    return head


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, what): files that are missing, added or changed against the manifest."""
    told = spark.read.parquet(f"{path}/manifest/files").select("file", F.col("sha256").alias("told"))
    both = told.join(leaves(spark, path).select("file", F.col("sha256").alias("found")), "file", "full_outer")
    what = F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "added").when(F.col("told") != F.col("found"), "changed")
    return both.select("file", what.alias("what")).filter("what IS NOT NULL")


def read_index(spark: SparkSession, path: str, fingerprint: str | None = None, dimensions: int | None = None) -> DataFrame:
    """The clauses, after the checks, in this order: a manifest, its version, the files and the tree against the root, the model, the dimensions, the number and size of vectors."""
    head = read_head(spark, path)
    odd = damaged(spark, path).orderBy("file").limit(NAMED).collect()
    if odd:
        raise CorruptIndex(f"{path}: " + ", ".join(f"{r['file']} {r['what']}" for r in odd), [r["file"] for r in odd])
    if root_of(spark.read.parquet(f"{path}/manifest/files")) != head["root"]:
        raise CorruptIndex(f"{path}: the manifest's files don't lead to its root")
    if fingerprint is not None and head["fingerprint"] != fingerprint:
        raise ModelMismatch(f"the index is of {head['fingerprint']}, not of {fingerprint}")
    if dimensions is not None and head["dimensions"] != dimensions:
        raise DimensionMismatch(f"the index has {head['dimensions']} dimensions, not {dimensions}")
    chunks = spark.read.parquet(f"{path}/chunks")
    n, wrong = chunks.agg(F.count("*"), F.count_if(~F.coalesce(F.size("embedding") == head["dimensions"], F.lit(False)))).first()
    if n != head["chunk_count"] or wrong:
        raise CorruptIndex(f"{path}: {n} vectors, {wrong} of them of another size, where {head['chunk_count']} of {head['dimensions']} were written")
    return chunks

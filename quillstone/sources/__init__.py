"""Reading documents and writing chunks with Spark's own formats."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table kept as ``<folder>/<name>.parquet``, wherever Spark can read it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate files. Where none is set, a local session gets a
    temporary one; on a cluster it is an error, as executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="quillstone-")).rstrip("/")


#: Rows and bytes of one Arrow batch handed to Python: batches of very long texts stay small.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 23


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes. Settings are read when a plan is executed, so they have one value only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """A table just read, over at least as many partitions as there are slots. Chunking is all computing, so a small input
    in one file would leave the other slots idle; an input of many files is left as it is and nothing is shuffled."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def deal(df: DataFrame) -> DataFrame:
    """A table just read, its rows dealt over four tasks a slot. For narrow tables whose rows cost much computing: files are cut
    by bytes and row groups, so that few tasks, or one, would get all of such a table however many rows it has."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files, one row a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_chunks(chunks: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Chunks as Parquet, partitioned if asked for."""
    writer = chunks.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks as lines of JSON, with breadcrumbs as an array."""
    chunks.write.mode(mode).json(path)

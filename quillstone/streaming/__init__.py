"""Chunking of streams: the chunker holds no state between rows, so it runs in append mode without a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunk import Chunker


def read_documents(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", files_per_trigger: int | None = None, only: str | None = None) -> DataFrame:
    """A stream of the files in a folder, or of those whose names match ``only``."""
    reader = spark.readStream.format(format).schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def latest_versions(documents: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of a key seen within the watermark; later copies are dropped."""
    return documents.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_chunks(documents: DataFrame, chunker: Chunker, path: str, checkpoint: str, text: str = "text", available_now: bool = True) -> StreamingQuery:
    """Chunk a stream of documents into a Parquet folder, exactly once."""
    writer = chunker.transform(documents, text).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)

"""Documents from a folder as a stream: what is per row in a batch load is per row here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusql.config import RetrievalConfig
from corpusql.functions.chunk import chunks
from corpusql.functions.vectors import embed
from corpusql.sources.files import _parsed, as_documents

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, directory: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Documents of files as they arrive in a directory."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_trigger).load(directory)
    return as_documents(_parsed(files))


def stream_chunks(documents: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Chunks with vectors of a stream of documents."""
    return embed(chunks(documents, config.chunking), config.embedding)


def write_chunks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, each file's chunks once; stops when what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows, late rows allowed for a while; the same on a table and on a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
    )

"""Keep a chunk index of a folder of documents that grows.

    python jobs/index_documents.py DOCUMENTS INDEX CHECKPOINT [--config FILE]

DOCUMENTS is a folder of Parquet files of (doc_id, text, lang), to which files
are added, or a pattern of such files and folders. INDEX gets two tables:
``documents`` (doc_id, text_hash) and ``chunks`` with vectors. CHECKPOINT is where
Structured Streaming keeps which files it has taken; a new one needs a new INDEX.

A run takes the files that are new and ends. Each batch is a ``load``, a
partition of both tables; if it is repeated after a failure it overwrites that
partition, so reruns give the same tables. A document that comes again with the
same text is passed over; with another text it is chunked again, and
``current`` shows its latest load only, also where that has no chunk.

Of several rows of one document in a load the one of the newest file counts.
Rows without an id are left out and counted in the log; null texts are empty, blank ones
have no chunks; a null or empty language is ``und``.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql import log
from corpusql.config import RetrievalConfig, updated, validated
from corpusql.packaging import ship
from corpusql.plans import vanilla

DOCUMENTS = "doc_id long, text string, lang string"
CHUNKS = (
    "chunk_id string, doc_id long, chunk_index int, content string, chunk_size int, token_count int, "
    "chunk_position double, strategy string, embedding array<double>, load long, language string"
)
LEDGER = "doc_id long, text_hash string, load long"
#: A file is taken whatever its age beside the newest one.
ANY_AGE = "36500d"


@dataclass(frozen=True)
class Settings:
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    files_per_batch: int = 1_000


def settings(changes: dict[str, Any]) -> Settings:
    own = updated(Settings(), changes)
    validated(own.retrieval)
    return own


def latest(rows: DataFrame) -> DataFrame:
    """One row (doc_id, text, language, text_hash) per document: that of the newest file, then of the last path and text."""
    plain = rows.withColumns({"text": F.coalesce("text", F.lit("")), "language": F.coalesce(F.nullif("lang", F.lit("")), F.lit("und"))})
    best = plain.groupBy("doc_id").agg(F.max_by(F.struct("text", "language"), F.struct("modified", "path", "text", "language")).alias("own"))
    return best.select("doc_id", "own.*").withColumn("text_hash", F.sha2(F.col("text"), 256))


def changed(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents that the ledger does not have, or has last with another text; only ids and hashes of the ledger are read."""
    known = ledger.groupBy("doc_id").agg(F.max_by("text_hash", "load").alias("known_hash"))
    return rows.join(known, "doc_id", "left").filter(~F.col("text_hash").eqNullSafe(F.col("known_hash"))).drop("known_hash")


def chunked(rows: DataFrame, own: Settings) -> DataFrame:
    """Chunks with vectors of documents (doc_id, text, language). The language goes with the id, so it needs no join."""
    found = vanilla.index(rows.select(F.struct("doc_id", "language").alias("whose"), "text"), own.retrieval, id_col="whose")
    name = F.concat_ws("_", F.col("doc_id.doc_id").cast("string"), "strategy", F.col("chunk_index").cast("string"))
    return found.withColumns({"chunk_id": name, "language": F.col("doc_id.language")}).withColumn("doc_id", F.col("doc_id.doc_id"))


def _put(rows: DataFrame, schema: str, load: int, path: str, *partitions: str) -> None:
    """Write rows as a load, in place of what an interrupted run left of it."""
    columns = [c.split()[0] for c in schema.split(", ")]
    whole = rows.withColumn("load", F.lit(load).cast("long")).select(*columns)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", *partitions).parquet(path)


def index_documents(spark: SparkSession, documents: str, index: str, checkpoint: str, own: Settings) -> dict[str, int]:
    """Take the new files of ``documents`` into ``index``; the numbers of loads, rows read, documents and chunks written."""
    say, done = log.get("jobs.index_documents"), {"loads": 0, "rows": 0, "documents": 0, "chunks": 0}

    def take(batch: DataFrame, load: int) -> None:
        rows, named = batch.agg(F.count("*"), F.count("doc_id")).first()
        new = latest(batch.filter("doc_id IS NOT NULL"))
        if load:  # what an interrupted run left of this load does not count as known
            new = changed(new, read_documents(spark, index).filter(F.col("load") < load))
        new = new.persist()
        _put(chunked(new, own), CHUNKS, load, f"{index}/chunks", "language")
        _put(new, LEDGER, load, f"{index}/documents")
        taken, chunks = new.count(), read_chunks(spark, index).filter(F.col("load") == load).count()
        new.unpersist()
        for name, n in (("loads", 1), ("rows", rows), ("documents", taken), ("chunks", chunks)):
            done[name] += n
        say.info("load %d: read %d rows, %d of them without an id; wrote %d documents that are new or changed and %d chunks to %s", load, rows, rows - named, taken, chunks, index)

    source = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", own.files_per_batch).option("maxFileAge", ANY_AGE).parquet(documents)
    rows = source.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path"))
    say.info("reading what is new in %s", documents)
    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    say.info("done: %s", done)
    return done


def read_chunks(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of all loads, once there is one."""
    return spark.read.schema(CHUNKS).parquet(f"{index}/chunks")


def read_documents(spark: SparkSession, index: str) -> DataFrame:
    """The documents of all loads, once there is one."""
    return spark.read.schema(LEDGER).parquet(f"{index}/documents")


def current(spark: SparkSession, index: str) -> DataFrame:
    """The chunks of each document's latest load."""
    newest = read_documents(spark, index).groupBy("doc_id").agg(F.max("load").alias("load"))
    return read_chunks(spark, index).join(newest, ["doc_id", "load"], "left_semi")


def main() -> None:
    parser = argparse.ArgumentParser(description="Keep a chunk index of a growing folder of documents.")
    parser.add_argument("documents")
    parser.add_argument("index")
    parser.add_argument("checkpoint")
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    told = parser.parse_args()
    log.setup()
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        ship(spark)
        own = settings(json.loads(Path(told.config).read_text(encoding="utf-8")))
        index_documents(spark, told.documents, told.index, told.checkpoint, own)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

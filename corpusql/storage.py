"""Tables that iterative operators write between rounds, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.errors import ConfigurationError

_KEY = "spark.checkpoint.dir"
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a temporary one where it is unset."""
    if folder := spark.conf.get(_KEY, None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError(f"{_KEY} must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="corpusql-core-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a new Parquet table: lineage ends here and a lost executor repeats nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """The same rows, dealt by the hash of some columns: a file of few row groups is otherwise read, and its rows worked on, by as few tasks."""
    return df.repartition(F.xxhash64(*by))


def dealt(df: DataFrame) -> DataFrame:
    """The same rows for a join that deals both sides by key: numbers take so little room in a file or a shuffle that a table of them is otherwise broadcast, through the driver, at many times that size."""
    return df.hint("merge")

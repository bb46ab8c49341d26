"""Tables that cut lineage, kept in the folder all executors share.

``table`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
reads it back. A lost executor then costs only the tasks it was running: what
was written before is still there. Writing a table instead of calling
``checkpoint()`` keeps column pruning and size statistics for later steps.

A query's result reads its tables lazily, so they stay until ``clear`` is
called or, where the session still lives, the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own_root: str | None = None
_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder: the session's setting, or a temporary one in local mode."""
    global _own_root
    told = spark.conf.get(_KEY, None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="corpusql-")
        atexit.register(shutil.rmtree, _own_root, True)
    return f"file://{_own_root}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new shared table and return a DataFrame that reads it."""
    spark = df.sparkSession
    folder = f"{root(spark)}/corpusql-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written.append(folder)
    df.write.parquet(f"{folder}/{label}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{label}")


def mark() -> int:
    """A point in time, for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since a mark, but for the files that ``keep`` reads; no DataFrame may read them any more."""
    kept = set(keep.inputFiles()) if keep is not None else set()
    context = spark.sparkContext
    left = []
    for folder in _written[since:]:
        if any(f"/{folder.rsplit('/', 1)[1]}/" in file for file in kept):
            left.append(folder)
            continue
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _written[since:] = left


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear(spark)

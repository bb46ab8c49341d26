"""Making a session ready: the package on the executors, and Arrow batches of a size that texts allow."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch. Texts of some kilobytes make batches of a few megabytes, in the JVM and in Python.
BATCH_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch, or one row beyond them: rows that hold whole blocks of vectors, and long texts, make batches no larger than others.
BATCH_BYTES = 8 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per context, and bound Arrow batches."""
    if int(spark.conf.get(_BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)
    if not 0 < int(spark.conf.get(_BYTES_KEY, None) or 0) <= BATCH_BYTES:
        spark.conf.set(_BYTES_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_corpusql_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="corpusql-code-")) / "corpusql.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # Spark serves the file to every executor
    context._corpusql_shipped = True

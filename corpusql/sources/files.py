"""Reading text, Markdown, JSON and CSV files as documents, one row per file.

Files are read by Spark's ``binaryFile`` source from any file system it knows;
a file that cannot be read becomes a row of the errors table and stops nothing.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.errors import ProcessingError
from corpusql.functions.text import clean_text, document_id, word_count

#: Document types and media types by suffix.
TYPES = {".txt": "text", ".md": "markdown", ".json": "json", ".csv": "csv", ".pdf": "pdf", ".docx": "docx"}
MIME_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".json": "application/json", ".csv": "text/csv", ".pdf": "application/pdf"}
CSV_ROWS = 10


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_type(path: Column) -> Column:
    return F.coalesce(_lookup(TYPES, suffix(path)), F.lit("unknown"))


def list_files(spark: SparkSession, directory: str, suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, name, size, modified, suffix and mime_type of the files below a directory, sorted by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    own = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    own = own.withColumn("suffix", suffix(F.col("path")))
    if suffixes is not None:
        own = own.filter(F.col("suffix").isin([s.lower() for s in suffixes]))
    return own.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "modified", "suffix", _lookup(MIME_TYPES, F.col("suffix")).alias("mime_type")
    ).orderBy("path")


def decoded(content: bytes) -> str:
    """UTF-8, or Latin-1 where it is not valid."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def json_text(content: str) -> str:
    """'key: value' lines of an object, lists joined by commas; anything else pretty-printed."""
    data = json.loads(content)
    if not isinstance(data, dict):
        return json.dumps(data, indent=2)

    def shown(value: object) -> str:
        if isinstance(value, str | int | float):
            return str(value)
        return ", ".join(map(str, value)) if isinstance(value, list) else json.dumps(value)

    return "\n".join(f"{key}: {shown(value)}" for key, value in data.items())


def csv_text(content: str) -> str:
    """A summary line, the columns, the first rows as 'column: value' pairs, and how many more there are."""
    rows = [r for r in csv.reader(io.StringIO(content)) if r]
    if not rows:
        raise ProcessingError("the file has no columns")
    head, body = rows[0], rows[1:]
    lines = [f"CSV with {len(body)} rows and {len(head)} columns", f"Columns: {', '.join(head)}"]
    lines += [f"Row {i}: " + ", ".join(f"{c}: {v}" for c, v in zip(head, r, strict=False)) for i, r in enumerate(body[:CSV_ROWS])]
    return "\n".join([*lines, f"... and {len(body) - CSV_ROWS} more rows"] if len(body) > CSV_ROWS else lines)


def file_text(content: bytes, kind: str) -> tuple[str, dict[str, str]]:
    """Text before cleaning, and what is known of the file's inside."""
    if kind == "json":
        text = content.decode("utf-8")
        data = json.loads(text)
        about = {"json_type": type(data).__name__}
        if isinstance(data, dict):
            about["json_keys"] = ",".join(data)
        if isinstance(data, dict | list):
            about["json_length"] = str(len(data))
        return json_text(text), about
    if kind == "csv":
        text = content.decode("utf-8")
        rows = [r for r in csv.reader(io.StringIO(text)) if r]
        about = {"csv_rows": str(max(0, len(rows) - 1)), "csv_columns": str(len(rows[0]) if rows else 0), "csv_column_names": ",".join(rows[0]) if rows else ""}
        return csv_text(text), about
    if kind == "markdown":
        return content.decode("utf-8"), {}
    return decoded(content), {}


_SCHEMA = "path string, size long, modified timestamp, raw string, inside map<string,string>, error string"


def _parsed(files: DataFrame) -> DataFrame:
    """Raw texts of ``binaryFile`` rows; failures keep their message instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                dot = path.rfind(".")
                try:
                    rows.append((*file_text(content.as_py(), TYPES.get(path[dot:].lower() if dot > path.rfind("/") else "", "unknown")), None))
                except (ValueError, ProcessingError) as e:
                    rows.append((None, {}, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"), batch.column("length"), batch.column("modificationTime"), pa.array([r[0] for r in rows], pa.string()),
                    pa.array([list(r[1].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[2] for r in rows], pa.string()),
                ],
                ["path", "size", "modified", "raw", "inside", "error"],
            )

    return files.select("path", "length", "modificationTime", "content").mapInArrow(run, _SCHEMA)


def as_documents(parsed: DataFrame, clean: bool = True) -> DataFrame:
    """doc_id, content, file_path, document_type, word_count and metadata of files that could be read."""
    whole = parsed.filter("error is null").withColumn("content", clean_text(F.col("raw")) if clean else F.col("raw"))
    plain = F.map_from_arrays(
        F.array(*map(F.lit, ("filename", "size", "modified", "mime_type", "extension"))),
        F.array(
            F.regexp_extract("path", r"([^/]+)$", 1), F.col("size").cast("string"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss"),
            F.coalesce(_lookup(MIME_TYPES, suffix(F.col("path"))), F.lit("")), suffix(F.col("path")),
        ),
    )
    return whole.select(
        document_id(F.col("path"), F.col("content")).alias("doc_id"), "content", F.col("path").alias("file_path"), document_type(F.col("path")).alias("document_type"),
        word_count(F.col("content")).alias("word_count"), F.map_concat(plain, "inside").alias("metadata"),
    )


def load_documents(spark: SparkSession, paths: str | list[str], clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of files, directories or patterns; errors has path and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    parsed = _parsed(files)
    return as_documents(parsed, clean), parsed.filter("error is not null").select("path", "error")


def load_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and whole text of files as they are."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def csv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row on a table file: rows, columns, their names and types."""
    table = spark.read.csv(path, header=True, inferSchema=True)
    names = [n for n, _ in table.dtypes]
    return table.agg(F.count("*").alias("csv_rows")).select(
        "csv_rows", F.lit(len(names)).alias("csv_columns"), F.array(*map(F.lit, names)).alias("csv_column_names"), F.array(*[F.lit(t) for _, t in table.dtypes]).alias("csv_dtypes")
    )


def json_columns(text: Column) -> list[Column]:
    """json_type, json_keys and json_length of a JSON column; all null where it is no JSON."""
    keys, length = F.json_object_keys(text), F.json_array_length(text)
    return [
        F.when(keys.isNotNull(), "dict").when(length.isNotNull(), "list").alias("json_type"), keys.alias("json_keys"), F.coalesce(F.size(keys), length).alias("json_length")
    ]


def json_fields(df: DataFrame, text: str, depth: int = 4) -> DataFrame:
    """The values within a JSON column, a row each: the other columns, path, kind and value.

    Objects and arrays are opened down to ``depth``; what lies deeper is given
    as JSON text. A path names keys and places, joined by dots. A text that is
    no JSON, null or a single value without a key gives no row; neither does an empty object or array.
    """
    kept, spark = [c for c in df.columns if c != text], df.sparkSession
    level, found = df.select(*kept, F.lit(None).cast("string").alias("path"), F.try_parse_json(text).alias("held")), []
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    named = F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    for at in range(depth):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
        rows = inside.select(*kept, F.concat_ws(".", "path", F.coalesce("key", F.col("pos").cast("string"))).alias("path"), named.alias("kind"), "value")
        opened = F.col("kind").isin("object", "array") if at < depth - 1 else F.lit(False)
        shown = F.when(F.col("kind") == "string", F.variant_get("value", "$", "string")).otherwise(F.to_json("value"))
        found.append(rows.filter(~opened).select(*kept, "path", "kind", shown.alias("value")))
        level = rows.filter(opened).select(*kept, "path", F.col("value").alias("held"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole

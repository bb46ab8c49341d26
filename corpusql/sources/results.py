"""Writing and reading results, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.errors import ProcessingError
from corpusql.operators.graph import last_edges


def save_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or Parquet."""
    if kind not in ("json", "parquet"):
        raise ProcessingError(f"unknown result format: {kind}")
    df.write.mode("overwrite").format(kind).save(path)


def load_results(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    if kind not in ("json", "parquet"):
        raise ProcessingError(f"unknown result format: {kind}")
    return spark.read.format(kind).load(path)


def save_embeddings(df: DataFrame, path: str, id_col: str = "chunk_id") -> None:
    df.select(id_col, "embedding").write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_graph(vertices: DataFrame, relationships: DataFrame, chunk_entities: DataFrame, path: str, kind: str = "parquet") -> None:
    """Three tables as Parquet or JSON lines; ``gexf`` writes one XML file of vertices and edges by rows of text."""
    if kind in ("parquet", "json"):
        for name, table in (("vertices", vertices), ("relationships", relationships), ("chunk_entities", chunk_entities)):
            table.write.mode("overwrite").format(kind).save(f"{path}/{name}")
    elif kind == "gexf":
        gexf(vertices, relationships).write.mode("overwrite").text(path)
    else:
        raise ProcessingError(f"unknown graph format: {kind}")


def load_graph(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, relationships, edges, chunk_entities); edges are derived again."""
    if kind not in ("parquet", "json"):
        raise ProcessingError(f"graphs are not read from {kind}")
    vertices, relationships, bridge = (spark.read.format(kind).load(f"{path}/{name}") for name in ("vertices", "relationships", "chunk_entities"))
    return vertices, relationships, last_edges(relationships), bridge


def gexf(vertices: DataFrame, relationships: DataFrame) -> DataFrame:
    """Lines of a GEXF document, in order, in one partition range each: head, nodes, edges, foot."""
    spark = vertices.sparkSession

    def quoted(name: str) -> Column:
        text = F.col(name)
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), text, F.lit('"'))

    nodes = vertices.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit("<node id="), quoted("name"), F.lit(" label="), quoted("name"), F.lit("/>")).alias("value"))
    edges = last_edges(relationships).select(
        F.lit(3).alias("part"), F.concat_ws("|", "src", "dst", "relation_type").alias("key"),
        F.concat(F.lit("<edge source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(" label="), quoted("relation_type"), F.lit(' weight="'), F.col("confidence").cast("string"), F.lit('"/>')).alias("value"),
    )
    frame = spark.createDataFrame(
        [
            (0, "", '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'),
            (2, "", "</nodes><edges>"),
            (4, "", "</edges></graph></gexf>"),
        ],
        "part int, key string, value string",
    )
    return frame.unionByName(nodes).unionByName(edges).orderBy("part", "key").select("value")


def export_comparison(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """One folder of JSON per query, and the aggregate report."""
    metrics.withColumn("query", F.col("query_id")).write.mode("overwrite").partitionBy("query").json(f"{path}/comparisons")
    summary.write.mode("overwrite").json(f"{path}/aggregate_report")

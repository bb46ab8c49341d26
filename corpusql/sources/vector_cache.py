"""A table of vectors by content hash, kept across loads.

``path`` holds a partition for each model and load. A load embeds only the
texts that no other load of its model holds; run again under its name it
overwrites its own partition and gives the same rows.

Defined results: a null text counts as empty; equal texts share a vector; an
empty load writes nothing; loads of one cache are run one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.config import EmbeddingConfig
from corpusql.functions.vectors import embed

_SCHEMA = "text_hash string, embedding array<double>, model string, load string"


def _hash(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Everything the cache holds; none where it has not been started with ``clear``."""
    return spark.read.schema(_SCHEMA).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """Start the cache, or empty it."""
    spark.createDataFrame([], _SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def add(df: DataFrame, path: str, load: str, config: EmbeddingConfig = EmbeddingConfig(), text_col: str = "content") -> None:
    """Embed each distinct text that no other load has, and write it as this load."""
    spark = df.sparkSession
    others = entries(spark, path).filter((F.col("model") == config.model_name) & (F.col("load") != load)).select("text_hash")
    wanted = df.select(_hash(text_col).alias("text_hash"), F.col(text_col).alias("content")).join(others, "text_hash", "left_anti")
    new = embed(wanted.groupBy("text_hash").agg(F.first("content").alias("content")), config)
    named = new.select("text_hash", "embedding", F.lit(config.model_name).alias("model"), F.lit(load).alias("load"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "load").parquet(path)


def vectors(df: DataFrame, path: str, config: EmbeddingConfig = EmbeddingConfig(), text_col: str = "content") -> DataFrame:
    """Rows whose texts the cache holds, with their vectors."""
    held = entries(df.sparkSession, path).filter(F.col("model") == config.model_name)
    return df.withColumn("text_hash", _hash(text_col)).join(held.select("text_hash", "embedding"), "text_hash").drop("text_hash")


def statistics(df: DataFrame, path: str, load: str, config: EmbeddingConfig = EmbeddingConfig(), text_col: str = "content") -> DataFrame:
    """n_rows, n_texts (distinct), n_embedded (by this load) and hit_rate (share of rows that needed no embedding of their own)."""
    own = entries(df.sparkSession, path).filter((F.col("model") == config.model_name) & (F.col("load") == load)).select("text_hash", F.lit(1).alias("new"))
    texts = df.groupBy(_hash(text_col).alias("text_hash")).agg(F.count("*").alias("n")).join(own, "text_hash", "left")
    return texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_texts"), F.count("new").alias("n_embedded")).select(
        F.lit(load).alias("load"), "*", F.round(1 - F.try_divide(F.col("n_embedded"), F.col("n_rows")), 6).alias("hit_rate")
    )

"""A training-data pipeline over ``documents``: each stage works on what the one before it kept.

Toxic documents go, of exact copies and then of near copies one stays, sources
are mixed to their target weights, and what is left is packed into sequences.
Every stage takes (spark, docs, sf_dir); ``run`` writes each stage's rows to
the shared folder and reads them back for the next.

Defined results of all stages: null texts count as empty; rows with null or
equal ids, repeated rows, very long texts and further columns, whatever their
names and the case of these, pass through as the operators say; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusql.llm import scratch
from corpusql.llm.exact_dedup import drop_exact_duplicates
from corpusql.llm.mixing import mixed_rows
from corpusql.llm.packing import pack
from corpusql.llm.shingles import drop_near_copies
from corpusql.llm.toxicity import drop_toxic
from corpusql.packaging import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject; null and empty texts are scored as one padding word."""
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id; one of several rows with that id."""
    ship(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, verified at Jaccard similarity 0.8 of five-word shingles), the document with the smallest id.

    Texts without words are one group; null ids come last.
    """
    ship(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, a text without words is taken as its source's rate says."""
    ship(spark)
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place in it; an empty text is its end token alone."""
    ship(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.clear(spark, since, keep=docs)  # the stage's input and what it wrote on the way
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact search: every chunk against the query, the top k as context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.config import RetrievalConfig
from corpusql.errors import RetrievalError
from corpusql.functions.chunk import chunks
from corpusql.functions.text import clean_text
from corpusql.functions.vectors import DIGITS, embed
from corpusql.operators.context import gathered, plain_context, plain_response
from corpusql.operators.nearest import nearest
from corpusql.storage import spread

#: How the strategy explains itself.
STEPS = [
    "1. Query embedding generation",
    "2. Similarity computation with all chunks",
    "3. Top-k retrieval based on cosine similarity",
    "4. Context formatting from retrieved chunks",
    "5. Response generation (mock implementation)",
]


def cut(docs: DataFrame, config: RetrievalConfig, id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """Chunks of documents that are cleaned first unless told otherwise."""
    text = clean_text(F.col(text_col)) if clean else F.col(text_col)
    dealt = spread(docs.select(id_col, text_col), id_col, text_col)
    return chunks(dealt.select(F.col(id_col).alias("doc_id"), text.alias("content")), config.chunking)


def index(docs: DataFrame, config: RetrievalConfig, id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """Chunks with vectors, of documents that are cleaned first unless told otherwise."""
    return embed(cut(docs, config, id_col, text_col, clean), config.embedding)


def embedded_queries(queries: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Queries (query_id, query) with vectors."""
    return embed(queries.select("query_id", "query"), config.embedding, "query")


def retrieve(queries: DataFrame, indexed: DataFrame, config: RetrievalConfig, top_k: int | None = None) -> DataFrame:
    """Hits (query_id, rank, chunk_id, doc_id, content, score); a threshold of 0 lets negative scores pass."""
    if "embedding" not in indexed.columns:
        raise RetrievalError("the chunks have no embeddings")
    threshold = config.similarity_threshold if config.similarity_threshold > 0 else None
    found = nearest(
        embedded_queries(queries, config), indexed, top_k or config.top_k, "cosine", threshold, item_id="chunk_id"
    ).withColumnRenamed("item_id", "chunk_id")
    # Scores are settled on ids and vectors; contents meet only the rows that remain.
    return found.join(indexed.select("chunk_id", "doc_id", "content"), "chunk_id").select(
        "query_id", "rank", "chunk_id", "doc_id", "content", "score"
    )


def search(queries: DataFrame, docs: DataFrame, config: RetrievalConfig, top_k: int | None = None) -> DataFrame:
    """The hits of ``retrieve`` (query_id, rank, chunk_id, doc_id, score) without an index: documents are cut, embedded and scored in one pass."""
    threshold = config.similarity_threshold if config.similarity_threshold > 0 else None
    found = nearest(embedded_queries(queries, config), cut(docs, config), top_k or config.top_k, "cosine", threshold, item_id="chunk_id", text="content", embedding=config.embedding, carried=["doc_id"])
    return found.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "doc_id", "score")


def confidence(hits: DataFrame, top_k: int) -> DataFrame:
    """query_id, confidence: mean positive score, less where fewer than the configured k were found."""
    positive = F.avg(F.when(F.col("score") > 0, F.col("score")))
    share = F.least(F.count("*") / top_k, F.lit(1.0))
    value = F.when(positive.isNull(), 0.5).otherwise(F.least(positive * share, F.lit(1.0)))
    return hits.groupBy("query_id").agg(F.round(value, DIGITS).alias("confidence"))


def answer(queries: DataFrame, hits: DataFrame, config: RetrievalConfig) -> DataFrame:
    """One row per query: response, context, confidence, chunks_retrieved and sources; queries without hits too."""
    found = queries.join(gathered(hits), "query_id", "left").join(confidence(hits, config.top_k), "query_id", "left")
    return found.select(
        "query_id",
        "query",
        plain_response(F.col("hits"), F.col("query")).alias("response"),
        F.coalesce(plain_context(F.col("hits")), F.lit("")).alias("context"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("chunks_retrieved"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["doc_id"].cast("string")))), F.array().cast("array<string>")).alias("sources"),
    )


def query(queries: DataFrame, indexed: DataFrame, config: RetrievalConfig, top_k: int | None = None) -> DataFrame:
    """Retrieve and answer."""
    return answer(queries, retrieve(queries, indexed, config, top_k), config)


def explain(queries: DataFrame, hits: DataFrame, config: RetrievalConfig) -> DataFrame:
    """One row per query on how its answer came about."""
    top = F.transform(F.filter(F.slice("hits", 1, 5), lambda h: h["score"] > 0), lambda h: h["score"])
    return queries.join(gathered(hits), "query_id", "left").select(
        "query_id",
        F.lit("vanilla").alias("rag_type"),
        F.length("query").alias("query_length"),
        F.coalesce(F.size("hits"), F.lit(0)).alias("chunks_retrieved"),
        F.lit(config.similarity_threshold).alias("similarity_threshold"),
        F.lit(config.chunking.strategy).alias("chunking_strategy"),
        F.lit(config.embedding.model_name).alias("embedding_model"),
        F.lit(config.embedding.dimension).alias("embedding_dimension"),
        top.alias("top_similarities"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["doc_id"].cast("string")))).alias("source_documents"),
        F.array(*map(F.lit, STEPS)).alias("process_steps"),
    )

"""Exact nearest rows by similarity of vectors.

Scores are computed in blocks by matrix products. A query set within
``BROADCAST_QUERIES`` rows goes to every task, which keeps its own best k of
each query over all its batches: the items themselves are never shuffled. Larger query sets meet
the items block by block, each pair of blocks in one task. Either way a final
window ranks a few rows per query; results do not depend on the way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.config import EmbeddingConfig
from corpusql.errors import RetrievalError
from corpusql.functions.vectors import DIGITS, EPSILON, embed, embedder

BROADCAST_QUERIES = 1_024
QUERY_BLOCK = 512
ITEM_BLOCK = 8_192


def similarities(queries: np.ndarray, items: np.ndarray, metric: str) -> np.ndarray:
    """(queries, items) scores, rounded as they leave the operator."""
    products = queries @ items.T
    if metric == "cosine":
        lengths = [np.linalg.norm(x, axis=1) + EPSILON for x in (queries, items)]
        products = products / lengths[0][:, None] / lengths[1][None, :]
    elif metric == "euclidean":
        squares = [(x * x).sum(axis=1) for x in (queries, items)]
        products = 1 / (1 + np.sqrt(np.maximum(squares[0][:, None] + squares[1][None, :] - 2 * products, 0)))
    elif metric != "dot":
        raise RetrievalError(f"unknown metric: {metric}")
    return np.round(products, DIGITS)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), len(values) // len(flat) if len(flat) else 0)


def best_of(queries: np.ndarray, items: np.ndarray, metric: str, k: int | None, threshold: float | None, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of queries and items and the scores of each query's best items, ties to smaller names."""
    scores = similarities(queries, items, metric)
    wanted = scores >= threshold if threshold is not None else np.ones(scores.shape, bool)
    if k is not None and 0 < k < scores.shape[1]:
        at = scores.shape[1] - k
        wanted &= scores >= np.partition(scores, at, axis=1)[:, at, None]
    whose, which = np.nonzero(wanted)
    score = scores[whose, which]
    if k is None:
        return whose, which, score
    order = np.lexsort((names[which], -score, whose))
    whose, which, score = whose[order], which[order], score[order]
    first = np.arange(len(whose)) - np.searchsorted(whose, whose) < k
    return whose[first], which[first], score[first]


def matches(names: pa.Array, vectors: np.ndarray, ids: pa.Array, batch: np.ndarray, metric: str, k: int | None, threshold: float | None, rest: dict[str, pa.Array] | None = None) -> pa.Table:
    """(query_id, item_id, score) of the best items of a block for each query of a block, and these items' part of the rest."""
    plain = np.array(ids.to_pylist(), dtype=object)
    order = np.argsort(plain, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    whose, which, score = best_of(vectors, batch, metric, k, threshold, place)
    at = pa.array(which)
    return pa.table({"query_id": names.take(pa.array(whose)), "item_id": ids.take(at), "score": pa.array(score)} | {c: own.take(at) for c, own in (rest or {}).items()})


def first_of_each(found: list[pa.Table], k: int) -> pa.Table:
    """The k best rows of each query, ties to smaller items."""
    ordered = pa.concat_tables(found).sort_by([("query_id", "ascending"), ("score", "descending"), ("item_id", "ascending")])
    whose = ordered.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
    place = np.arange(len(whose)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(whose)]])))
    return ordered.filter(pa.array(place < k))


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int | None,
    metric: str = "cosine",
    threshold: float | None = None,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "embedding",
    text: str | None = None,
    embedding: EmbeddingConfig = EmbeddingConfig(),
    carried: Sequence[str] = (),
) -> DataFrame:
    """query_id, item_id, score, rank: the k best items of each query (all within the threshold, if k is None).

    With ``text`` the items' vectors are made of that column by ``embedding``, where they are scored,
    and leave no task. Columns of the items that are ``carried`` stand beside the rank, so hits need not meet their items again.

    Rows with null vectors take no part; vectors of one call have one length.
    Ties go to smaller item ids. A threshold is applied before the limit,
    which is the same as after it, as both follow the score.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    texts = items.select(F.col(item_id).alias("item_id"), F.col(text or vector).alias("v"), *carried)
    vectors_of = matrix if text is None else lambda column, make=embedder(embedding): make([t or "" for t in column.to_pylist()])
    given = texts.withColumn("v", F.col("v").cast("array<double>")).filter("v is not null") if text is None else texts
    q_type, i_type = asked.schema["query_id"].dataType, given.schema["item_id"].dataType
    schema = f"query_id {q_type.simpleString()}, item_id {i_type.simpleString()}, score double"

    def rows(names: pa.Array, vectors: np.ndarray, batch_ids: pa.Array, batch: np.ndarray, rest: dict[str, pa.Array] | None = None) -> pa.Table:
        return matches(names, vectors, batch_ids, batch, metric, k, threshold, rest)

    if (held := asked.limit(BROADCAST_QUERIES + 1).toArrow()).num_rows <= BROADCAST_QUERIES:
        names, vectors = held.column("query_id").combine_chunks(), matrix(held.column("v"))
        shared = spark.sparkContext.broadcast((names, vectors))

        def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[pa.Table] = []
            held = 0
            for batch in batches:
                if not batch.num_rows or not len(shared.value[1]):
                    continue
                found = rows(*shared.value, batch.column(0), vectors_of(batch.column(1)), {c: batch.column(c) for c in carried})
                if k is None:
                    yield from found.to_batches()
                    continue
                best.append(found)
                held += found.num_rows
                if held > 4 * k * len(shared.value[1]):
                    best = [first_of_each(best, k)]
                    held = best[0].num_rows
            if held:
                yield from first_of_each(best, k).to_batches()

        partial = given.mapInArrow(score_batches, ", ".join([schema, *(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in carried)]))
    else:
        partial = _by_blocks(asked, (given if text is None else embed(given, embedding, "v", "v")).select("item_id", "v"), rows, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    ranked = partial.withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked.join(given.select("item_id", *carried), "item_id") if carried and held.num_rows > BROADCAST_QUERIES else ranked


def pairwise(items: DataFrame, metric: str = "cosine", threshold: float | None = None, k: int | None = None, item_id: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(item_id, other_id, score, rank) of all items against all, by blocks; give a threshold or k, or the result is quadratic."""
    found = nearest(items.withColumnRenamed(item_id, "query_id"), items, k, metric, threshold, item_id=item_id, vector=vector)
    return found.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("other_id"), "score", "rank")


def _by_blocks(asked: DataFrame, given: DataFrame, rows, schema: str) -> DataFrame:
    """Each block of queries with each block of items in one task."""
    n_query, n_item = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (given, ITEM_BLOCK)))
    blocked = lambda df, name, n: (
        df.withColumn("block", F.pmod(F.xxhash64(name), F.lit(n))).groupBy("block").agg(F.collect_list(name).alias("ids"), F.collect_list("v").alias("v"))
    )
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = blocked(asked, "query_id", n_query).select(
        F.col("block").alias("q"), to_all(n_item).alias("i"), F.col("ids").alias("query_ids"), F.col("v").alias("query_v")
    )
    items = blocked(given, "item_id", n_item).select(
        to_all(n_query).alias("q"), F.col("block").alias("i"), F.col("ids").alias("item_ids"), F.col("v").alias("item_v")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, vectors, ids, others = (batch.column(c)[r].values for c in ("query_ids", "query_v", "item_ids", "item_v"))
                yield from rows(names, matrix(vectors), ids, matrix(others)).to_batches()

    return queries.join(items, ["q", "i"]).select("query_ids", "query_v", "item_ids", "item_v").mapInArrow(compare, schema)

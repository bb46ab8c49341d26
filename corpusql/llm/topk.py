"""Exact top-k by inner product, with pivot-table elimination.

Vectors are scaled to integers. Each block of vectors holds a pivot table: the
distances of its vectors to a fixed set of pivots. For a query, the largest
difference between its own and a vector's distance to a pivot is a lower bound
of their distance, and with the two lengths an upper bound of their inner
product. Candidates are evaluated exactly in order of that bound until the
k-th best score exceeds the next bound, so nothing that belongs to the result
is left out.

Blocks of queries meet blocks of vectors, each pair in one task that holds
these two blocks only; a query's best of all blocks are then ranked. A block of
vectors is copied once for each ``QUERY_BLOCK`` queries of its length, so what
is shuffled grows with vectors times queries, as the work does.

Pivots are chosen farthest-first from a sample of ``PIVOT_SAMPLE`` vectors;
the sample affects speed alone.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; a vector meets those of its own length
only; rows with equal ids are candidates and queries each for itself; a query
without candidates has no rows; empty vectors meet each other with score 0; ties
go to the smaller id; an empty table gives an empty result; very long vectors
are held whole, a block of them at a time; other columns, whatever their names
and the case of these, are ignored. Scores outside the range of a long are cut
to that range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import quoted

SCALE = 1024
PIVOTS = 24
PIVOT_SAMPLE = 1_024
BLOCK = 1 << 14
QUERY_BLOCK = 1 << 11
CHUNK = 256  # candidates evaluated at once


def farthest_first(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors, each as far as can be from those before it."""
    if not len(vectors):
        return vectors
    chosen = [0]
    apart = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < n and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector to each pivot."""
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as longs."""
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if largest < 2.0**53:
        return (vectors @ query).astype(np.int64)
    exact = vectors.astype(np.int64).astype(object) @ query.astype(np.int64).astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def best(
    query: np.ndarray, query_distances: np.ndarray, vectors: np.ndarray, table: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best allowed vectors, ties to smaller ids."""
    where = np.flatnonzero(allowed)
    # |q - v| >= |d(q, p) - d(v, p)| for every pivot p, and 2 q.v = |q|^2 + |v|^2 - |q - v|^2.
    apart = np.abs(table[where] - query_distances).max(axis=1, initial=0)
    lengths = (query * query).sum() + (vectors[where] * vectors[where]).sum(axis=1)
    bound = (lengths - apart * apart) / 2 + 1e-9 * lengths + 1  # above any rounding
    order = np.argsort(-bound, kind="stable")
    where, bound = where[order], bound[order]
    kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(where), CHUNK):
        if len(scores) == k and scores[-1] > bound[at]:
            break
        own = where[at : at + CHUNK]
        kept, scores = np.concatenate([kept, own]), np.concatenate([scores, inner(vectors[own], query)])
        top = np.lexsort((ids[kept], -scores))[:k]
        kept, scores = kept[top], scores[top]
    return kept, scores


def _packed(rows: DataFrame, block: str, pivots) -> DataFrame:
    """One row per (dim, block): vectors, distances, ids and row numbers as bytes."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        flat = group.column("v").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(group.num_rows, dim).astype(np.float64)
        table = distances(vectors, pivots.value.get(dim, vectors[:0]))
        blobs = [vectors.tobytes(), table.tobytes(), *(group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "row"))]
        columns = [pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)]
        return pa.table(columns, ["dim", "block", "v", "d", "ids", "rows"])

    return rows.groupBy("dim", block).applyInArrow(pack, "dim int, block long, v binary, d binary, ids binary, rows binary")


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best other rows."""
    spark = df.sparkSession
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = (
        df.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).cast("array<double>").alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", sound))
        .select(
            "vec_id",
            F.transform("x", lambda x: F.floor(SCALE * x)).alias("v"),
            F.size("x").alias("dim"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows = scratch.table(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(PIVOT_SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list[list[int]]] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    pivots = spark.sparkContext.broadcast({dim: farthest_first(np.array(v, np.float64), PIVOTS) for dim, v in by_dim.items()})

    is_query = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).select(
        "dim", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("q") / QUERY_BLOCK).alias("query_blocks")
    )
    # A row for each length of vector: met where the rows are, so that one length that all have is not dealt to one task.
    sizes = F.broadcast(scratch.table(sizes, "sizes"))
    dealt = rows.join(sizes, "dim")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    data = _packed(dealt.filter("query_blocks > 0").withColumn("b", deal("blocks")), "b", pivots)
    queries = _packed(dealt.filter(is_query).withColumn("b", deal("query_blocks")), "b", pivots)
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blobs = ["v", "d", "ids", "rows"]
    pairs = (
        queries.join(sizes, "dim")
        .select("dim", F.col("block").alias("query_block"), to_all("blocks").alias("data_block"), F.lit(0).alias("side"), *blobs)
        .unionByName(
            data.join(sizes, "dim").select(
                "dim", to_all("query_blocks").alias("query_block"), F.col("block").alias("data_block"), F.lit(1).alias("side"), *blobs
            )
        )
    )

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        sides: dict[int, list[np.ndarray]] = {}
        for r in group.to_pylist():
            n = len(r["rows"]) // 8
            numbers = [np.frombuffer(r[c], t) for c, t in zip(blobs, (np.float64, np.float64, np.int64, np.int64), strict=True)]
            sides[r["side"]] = [numbers[0].reshape(n, dim), numbers[1].reshape(n, -1) if n else numbers[1], *numbers[2:]]
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(sides) == 2:
            (asked, asked_d, asked_ids, asked_rows), (vectors, table, ids, numbers) = sides[0], sides[1]
            for i in range(len(asked)):
                at, scores = best(asked[i], asked_d[i], vectors, table, ids, numbers != asked_rows[i], k)
                for column, values in zip(
                    found, (np.full(len(at), asked_rows[i]), np.full(len(at), asked_ids[i]), ids[at], numbers[at], scores), strict=True
                ):
                    column.append(values)
        names = ["query_row", "query_id", "vec_id", "row", "score"]
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in found], names)

    partial = pairs.groupBy("dim", "query_block", "data_block").applyInArrow(
        compare, "query_row long, query_id long, vec_id long, row long, score long"
    )
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

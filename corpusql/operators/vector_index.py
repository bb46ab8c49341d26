"""An inverted-file index of vectors: lists around trained centres, of which a search reads only a few.

``build`` trains centres on a sample, puts every vector into the list of its
nearest centre, and writes the lists as partitions of a Parquet table, so that
a search opens the files of the probed lists alone. Searches are approximate:
what lies in other lists is not seen. ``nearest.nearest`` is the exact way, and ``recall``
compares the two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusql.functions.vectors import DIGITS, norm
from corpusql.operators.nearest import ITEM_BLOCK, QUERY_BLOCK, first_of_each, matches, matrix, nearest
from corpusql.storage import written

#: About so many vectors, drawn at random, train the centres.
SAMPLE = 100_000
#: There are at most so many lists, so centres and the numbers of probed lists are small.
MOST_LISTS = 4_096
#: A task of a search puts its hits together beyond so many.
HELD_HITS = 1 << 18


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(item_id, embedding) of vectors with a direction; null ones, and those of length 0, lie nowhere."""
    own = vectors.select(F.col(id_col).alias("item_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("embedding"))
    return own.filter(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> int:
    """Write the index of vectors of one length; returns the number of lists, by default the square root of that of the vectors."""
    own = _usable(vectors, id_col, vector_col)
    n = own.count()
    wanted = max(1, min(lists or math.isqrt(n), MOST_LISTS, n))
    ready = own.withColumn("features", array_to_vector("embedding"))
    sample = ready.sample(min(1.0, SAMPLE / max(n, 1)), seed).select("features")
    if n < 2 or wanted < 2:
        placed, centres = own.withColumn("list", F.lit(0)), own.limit(1).select(F.lit(0).alias("list"), "embedding")
    else:
        model = KMeans(k=wanted, seed=seed, maxIter=20, distanceMeasure="cosine", predictionCol="list").fit(sample)
        spark = vectors.sparkSession
        placed = model.transform(ready).drop("features")
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, embedding array<double>")
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    # Rows of a list go together, a very long list into several files.
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    return centres.count()


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(query_id, item_id, score, rank): the k best by cosine in the ``probes`` lists whose centres are nearest; ties to smaller items.

    A list's vectors meet the queries that probe it block by block, by matrix
    products; a long list, or one that many queries probe, is several blocks.
    ``queries`` has query_id and embedding; null ones find nothing.
    """
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).filter("q IS NOT NULL")
    centres = spark.read.parquet(f"{path}/centres")
    near = written(nearest(asked.withColumnRenamed("q", "embedding"), centres, probes, "cosine", item_id="list").select("query_id", F.col("item_id").cast("int").alias("list")))
    probed = [r["list"] for r in near.select("list").distinct().collect()]  # at most MOST_LISTS numbers
    items = spark.read.parquet(f"{path}/lists").filter(F.col("list").isin(probed)).select("list", "item_id", F.col("embedding").alias("v"))
    pairs = _blocked(near.join(asked, "query_id"), "query_id", "q", QUERY_BLOCK).join(_blocked(items, "item_id", "v", ITEM_BLOCK), "list")
    kinds = (asked.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table] = []
        held = 0
        for batch in batches:
            for r in range(batch.num_rows):
                names, vectors, ids, others = (batch.column(c)[r].values for c in ("query_ids", "qs", "item_ids", "vs"))
                best.append(matches(names, matrix(vectors), ids, matrix(others), "cosine", k, None))
                held += best[-1].num_rows
                if held > HELD_HITS:
                    best = [first_of_each(best, k)]
                    held = best[0].num_rows
                    if held > HELD_HITS // 2:  # very many queries: little would be saved by holding on
                        yield from best.pop().to_batches()
                        held = 0
        if held:
            yield from first_of_each(best, k).to_batches()

    found = pairs.select("query_ids", "qs", "item_ids", "vs").mapInArrow(compare, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocked(rows: DataFrame, name: str, vector: str, size: int) -> DataFrame:
    """(list, ``name``s, ``vector``s): the rows of each list in blocks of about ``size``."""
    parts = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("parts")))  # at most MOST_LISTS rows
    dealt = rows.join(parts, "list").withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")))
    return dealt.groupBy("list", "part").agg(F.collect_list(name).alias(f"{name}s"), F.collect_list(vector).alias(f"{vector}s")).drop("part")


def probes_for(spark: SparkSession, path: str, target: float = 0.95, k: int = 10, sample: int = 200, seed: int = 0) -> int:
    """The least number of lists in which the share ``target`` of the exact k nearest of about ``sample`` indexed vectors lies."""
    items, centres = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centres")
    n = items.count()
    asked = items.sample(min(1.0, sample / max(n, 1)), seed).select(F.col("item_id").alias("query_id"), "embedding")
    exact = nearest(asked, items, k + 1, item_id="item_id").filter("query_id <> item_id")
    places = nearest(asked, centres, None, item_id="list")  # of every list, for some queries
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "list")
    placed = places.withColumnRenamed("item_id", "list").select("query_id", "list", F.row_number().over(order).alias("place"))
    lies = exact.join(items.select("item_id", "list"), "item_id").join(placed, ["query_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    total, seen = sum(r["n"] for r in lies), 0
    for r in lies:  # a row per list at most
        seen += r["n"]
        if seen >= target * total:
            return r["place"]
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of exact hits (query_id, item_id) that were found."""
    marked = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return marked.agg(F.round(F.coalesce(F.count("hit") / F.count("*"), F.lit(1.0)), DIGITS).alias("recall"))

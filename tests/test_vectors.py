import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusql.config import EmbeddingConfig
from corpusql.errors import ApiError, RetrievalError
from corpusql.functions import vectors as V
from corpusql.operators import nearest as N


def test_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 7))
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(
        V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.euclidean_similarity(F.col("a"), F.col("b")), V.normalized(F.col("a"))
    ).first()
    lengths = np.linalg.norm(a) + V.EPSILON, np.linalg.norm(b) + V.EPSILON
    assert row[0] == pytest.approx(a @ b)
    assert row[1] == pytest.approx(a @ b / lengths[0] / lengths[1])
    assert row[2] == pytest.approx(1 / (1 + np.linalg.norm(a - b)))
    assert row[3] == pytest.approx((a / np.linalg.norm(a)).tolist())


def test_zero_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")), V.normalized(F.col("a"))).first()
    assert row[0] == 0 and row[1] == [0.0, 0.0]


def test_embedding_and_its_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "b  a")], "id long, content string")
    rows, known = V.embed_once(df, None)
    assert known.count() == 3
    by_id = {r.id: r.embedding for r in rows.collect()}
    assert by_id[1] == by_id[2] == by_id[4] and not any(by_id[3])
    more, kept = V.embed_once(spark.createDataFrame([(5, "a b"), (6, "new")], "id long, content string"), known)
    assert more.count() == 2 and kept.count() == 4
    plain = V.embed(df, EmbeddingConfig(dimension=8, batch_size=1, normalize=False))
    assert sum(plain.filter("id = 1").first().embedding) == 2


def test_providers():
    assert isinstance(V.provider(EmbeddingConfig("hashing")), V.HashingProvider)
    assert isinstance(V.provider(EmbeddingConfig("some/model")), V.SentenceProvider)
    remote = V.provider(EmbeddingConfig("text-embedding-x"))
    with pytest.raises(ApiError):
        remote.embed(["a"])
    with pytest.raises(ApiError):
        V.RemoteProvider(EmbeddingConfig("x"), lambda name, texts: 1 / 0).embed(["a"])
    assert V.RemoteProvider(EmbeddingConfig("x"), lambda name, texts: [[1.0]] * len(texts)).embed(["a", "b"]).shape == (2, 1)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_nearest_both_ways(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)] + [(500, None)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    queries = items.filter("item_id < 20").withColumnRenamed("item_id", "query_id")
    one = N.nearest(queries, items, 4, metric).collect()
    monkeypatch.setattr(N, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(N, "QUERY_BLOCK", 6)
    monkeypatch.setattr(N, "ITEM_BLOCK", 50)
    two = N.nearest(queries, items, 4, metric).collect()
    assert sorted(one) == sorted(two) and len(one) == 80
    vectors = np.array([v for _, v in rows[:120]])
    scores = N.similarities(vectors[:20], vectors, metric)
    for r in one:
        assert sorted(scores[r.query_id], reverse=True)[r["rank"] - 1] == r.score


def test_arrow_batches_are_bounded_by_bytes(spark):
    """A row of the search by blocks holds thousands of vectors: a task must not get all of its rows as one batch."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    blocks = spark.range(0, 40, 1, 1).select(F.expr("transform(sequence(1, 131072), x -> double(x))").alias("v"))  # 1 MB a row
    found = [r.n for r in blocks.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 40 and max(found) <= 8


def test_nearest_ties_threshold_and_nothing(spark):
    items = spark.createDataFrame([(c, [1.0, 0.0]) for c in "dbca"] + [("x", [-1.0, 0.0])], "item_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.item_id for r in N.nearest(queries, items, 2).orderBy("rank").collect()] == ["a", "b"]
    assert N.nearest(queries, items, None, threshold=0.5).count() == 4
    assert N.nearest(queries.limit(0), items, 2).count() == 0
    assert N.nearest(queries, items.limit(0), 2).count() == 0
    with pytest.raises(RetrievalError):
        N.similarities(np.ones((1, 1)), np.ones((1, 1)), "other")


def test_pairwise_and_benchmark(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "item_id string, embedding array<double>")
    rows = {(r.item_id, r.other_id): r.score for r in N.pairwise(items).collect()}
    assert len(rows) == 9 and rows["a", "c"] == rows["c", "a"] == pytest.approx(0.707107) and rows["a", "b"] == 0
    found = V.benchmark(["x y", "z"], [EmbeddingConfig(dimension=16), EmbeddingConfig("some/model")])
    assert found[0]["dimension"] == 16 and "error" in found[1]


def test_running_best_over_many_batches(spark):
    items = spark.range(500).select(F.format_string("i%03d", "id").alias("item_id"), F.array(F.pmod(F.col("id") * 7, F.lit(11)).cast("double"), F.lit(1.0)).alias("embedding"))
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 2.0])], "query_id string, embedding array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in N.nearest(queries, items.coalesce(2), 4, "dot").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    all_items = [(f"i{i:03d}", float(i * 7 % 11)) for i in range(500)]
    for name, score in (("a", lambda x: x), ("b", lambda x: 2 - x)):
        best = sorted(((-score(x), item) for item, x in all_items))[:4]
        assert [found[name, k + 1] for k in range(4)] == [(item, -s) for s, item in best]

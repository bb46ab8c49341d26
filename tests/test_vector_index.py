"""The index against exact search."""

import numpy as np
import pytest

import corpusql.queries as Q
from corpusql.operators import vector_index as VI
from corpusql.operators.nearest import nearest


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_the_given_vectors(spark, sf):
    where = f"/root/testdata/{sf}"
    assert VI.recall(Q.QUERIES["index_topk"](spark, where), Q.QUERIES["cosine_topk"](spark, where)).first().recall >= 0.9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")


def test_all_lists_give_the_exact_result(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 7) for i in range(200)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(100)]  # a third of all vectors are copies
    rows += [(2000, None, 7), (2001, [0.0] * 8, 7)]
    df = frame(spark, rows)
    lists = VI.build(df, f"file://{tmp_path}/index", lists=12)
    asked = df.filter("vec_id % 10 = 0 AND embedding IS NOT NULL AND vec_id <> 2001").withColumnRenamed("vec_id", "query_id")
    found = VI.search(spark, f"file://{tmp_path}/index", asked, 4, probes=lists)
    exact = nearest(asked, df.filter("vec_id < 2000"), 4, item_id="vec_id")
    assert sorted(map(tuple, found.select("query_id", "rank", "item_id", "score").collect())) == sorted(map(tuple, exact.select("query_id", "rank", "item_id", "score").collect()))


def test_a_search_reads_the_probed_lists_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = frame(spark, [(i, [float(x) for x in rng.normal(size=8)], 7) for i in range(300)])
    VI.build(df, f"file://{tmp_path}/index", lists=10)
    one = df.filter("vec_id = 5").withColumnRenamed("vec_id", "query_id")
    found = VI.search(spark, f"file://{tmp_path}/index", one, 3, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert found.first().item_id == 5 and found.count() == 3


def test_few_vectors(spark, tmp_path):
    df = frame(spark, [(1, [1.0, 0.0], 7)])
    assert VI.build(df, f"file://{tmp_path}/one") == 1
    asked = df.withColumnRenamed("vec_id", "query_id")
    assert [r.item_id for r in VI.search(spark, f"file://{tmp_path}/one", asked, 3).collect()] == [1]


def test_lists_meet_queries_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VI, "ITEM_BLOCK", 16)
    monkeypatch.setattr(VI, "QUERY_BLOCK", 8)
    monkeypatch.setattr(VI, "HELD_HITS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 7) for i in range(120)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(100)]
    df = frame(spark, rows)
    lists = VI.build(df, f"file://{tmp_path}/index", lists=5)
    asked = df.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    found = VI.search(spark, f"file://{tmp_path}/index", asked, 4, probes=lists).select("query_id", "rank", "item_id", "score")
    exact = nearest(asked, df, 4, item_id="vec_id").select("query_id", "rank", "item_id", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()

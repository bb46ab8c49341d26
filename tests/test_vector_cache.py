from corpusql.sources import vector_cache as VC


def test_a_second_load_embeds_only_new_texts(spark, tmp_path):
    path = str(tmp_path / "cache")
    VC.clear(spark, path)
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, content string")
    second = spark.createDataFrame([(4, "a b"), (5, ""), (6, "new")], "id long, content string")
    VC.add(first, path, "one")
    for _ in range(2):  # a load that is run again gives the same
        VC.add(second, path, "two")
        assert VC.entries(spark, path).count() == 3
        assert tuple(VC.statistics(second, path, "two").first()) == ("two", 3, 3, 1, 0.666667)
    assert tuple(VC.statistics(first, path, "one").first())[1:4] == (3, 2, 2)
    got = {r.id: r.embedding for r in VC.vectors(first.union(second), path).collect()}
    assert len(got) == 6 and got[1] == got[2] == got[4] and got[3] == got[5]
    VC.clear(spark, path)
    assert VC.entries(spark, path).count() == 0
    VC.add(first.limit(0), path, "none")
    assert VC.entries(spark, path).count() == 0


def test_the_query_equals_its_sql(spark):
    import duckdb

    from corpusql.oracles import ORACLES
    from corpusql.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = sorted(tuple(r) for r in QUERIES["vector_cache"](spark, folder).collect())
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    assert found == sorted(con.sql(ORACLES["vector_cache"]).fetchall())

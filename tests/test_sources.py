import json

import pytest
from pyspark.sql import functions as F

from corpusql import config as K
from corpusql.config import ChunkingConfig, RetrievalConfig
from corpusql.errors import ConfigurationError, ProcessingError
from corpusql.operators import graph as G
from corpusql.sources import files as S
from corpusql.sources import results as R
from corpusql.streaming import ingest as I


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Plain  text & more\n\nend", encoding="utf-8")
    (tmp_path / "latin.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.md").write_text("# Head\n\nBody", encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"k": 1, "flag": True, "list": [1, "x"], "deep": {"a": None}}), encoding="utf-8")
    (tmp_path / "d.json").write_text("{broken", encoding="utf-8")
    (tmp_path / "sub" / "e.csv").write_text("n,v\n" + "".join(f"{i},x{i}\n" for i in range(12)), encoding="utf-8")
    (tmp_path / "sub" / "list.json").write_text("[1, 2]", encoding="utf-8")
    return tmp_path


def test_documents_and_errors(spark, folder):
    docs, errors = S.load_documents(spark, str(folder))
    by_name = {r.metadata["filename"]: r for r in docs.collect()}
    assert by_name["a.txt"].content == "Plain text  more end" and by_name["a.txt"].word_count == 4
    assert by_name["latin.txt"].content == "café"
    assert by_name["b.md"].document_type == "markdown" and by_name["b.md"].content == "Head Body"
    assert by_name["c.json"].content == 'k: 1 flag: True list: 1, x deep: {"a": null}'
    assert by_name["c.json"].metadata["json_keys"] == "k,flag,list,deep" and by_name["c.json"].metadata["json_length"] == "4"
    assert "CSV with 12 rows and 2 columns Columns: n, v Row 0: n: 0, v: x0" in by_name["e.csv"].content and by_name["e.csv"].content.endswith("... and 2 more rows")
    assert by_name["list.json"].metadata["json_type"] == "list"
    assert [r.path.rsplit("/", 1)[1] for r in errors.collect()] == ["d.json"]
    assert all(r.doc_id.startswith("doc_") for r in by_name.values())


def test_listing_and_raw(spark, folder):
    names = [r.name for r in S.list_files(spark, str(folder), [".TXT", ".md"]).collect()]
    assert names == ["a.txt", "b.md", "latin.txt"]
    assert S.load_raw(spark, str(folder / "b.md")).first().content == "# Head\n\nBody"
    about = S.csv_metadata(spark, str(folder / "sub" / "e.csv")).first()
    assert (about.csv_rows, about.csv_column_names, about.csv_dtypes) == (12, ["n", "v"], ["int", "string"])
    with pytest.raises(ProcessingError):
        S.csv_text("")


def test_json_columns(spark):
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ("[1,2,3]",), ("no",), (None,)], "t string").select(*S.json_columns(F.col("t"))).collect()
    assert [(r.json_type, r.json_length) for r in rows] == [("dict", 2), ("list", 3), (None, None), (None, None)]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    for kind in ("json", "parquet"):
        R.save_results(df, str(tmp_path / kind), kind)
        assert R.load_results(spark, str(tmp_path / kind), kind).select("a", "b").collect() == df.collect()
    with pytest.raises(ProcessingError):
        R.save_results(df, str(tmp_path / "p"), "pickle")
    vectors = spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<double>")
    R.save_embeddings(vectors, str(tmp_path / "v"))
    assert R.load_embeddings(spark, str(tmp_path / "v")).collect() == vectors.collect()


def test_graph_round_trip(spark, tmp_path):
    vertices = spark.createDataFrame([("a<b", "T", 0.5)], "name string, entity_type string, confidence double")
    relationships = spark.createDataFrame([("a<b", "a<b", "X", 0.5, 1)], "src string, dst string, relation_type string, confidence double, seq long")
    bridge = spark.createDataFrame([("a<b", "c1")], "name string, chunk_id string")
    for kind in ("parquet", "json"):
        R.save_graph(vertices, relationships, bridge, str(tmp_path / kind), kind)
        loaded = R.load_graph(spark, str(tmp_path / kind), kind)
        assert [t.count() for t in loaded] == [1, 1, 1, 1]
    lines = [r.value for r in R.gexf(vertices, relationships).collect()]
    assert '<node id="a&lt;b" label="a&lt;b"/>' in lines and lines[-1].endswith("</gexf>")
    with pytest.raises(ProcessingError):
        R.load_graph(spark, str(tmp_path), "gexf")
    nodes, edges = G.drawing(vertices.withColumn("chunk_count", F.lit(2)), relationships, vertices.select("name", F.lit(0.1).alias("importance")))
    assert nodes.first().size == 20 and edges.first().width == 2.5


def test_streamed_files_make_the_batch_rows(spark, folder, tmp_path):
    config = RetrievalConfig(ChunkingConfig("fixed_size", 50, 0, 1))
    stream = I.stream_chunks(I.stream_documents(spark, str(folder)), config)
    I.write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() > 0 and "embedding" in found.columns
    top = S.load_documents(spark, [str(folder / n) for n in ("a.txt", "latin.txt", "b.md", "c.json")])[0]
    from corpusql.functions.chunk import chunks

    assert found.select("content").distinct().count() >= chunks(top, config.chunking).select("content").distinct().count()


def test_configuration(tmp_path):
    config = K.updated(K.load(), {"top_k": 3, "chunking": {"chunk_size": 200, "separators": ["\n"]}})
    assert (config.top_k, config.chunking.chunk_size, config.chunking.overlap, config.chunking.separators) == (3, 200, 50, ("\n",))
    path = str(tmp_path / "c.json")
    K.save(config, path)
    assert K.load(path) == config and K.load(str(tmp_path / "none.json")) == RetrievalConfig()
    with pytest.raises(ConfigurationError):
        K.updated(config, {"nonsense": 1})
    bad = K.updated(config, {"top_k": 0, "similarity_threshold": 2.0, "chunking": {"overlap": 500}})
    assert len(K.problems(bad)) == 3
    with pytest.raises(ConfigurationError):
        K.validated(bad)


def test_json_fields(spark):
    from corpusql.sources.files import json_fields

    texts = ['{"a": 1, "b": {"c": [1, "x\\"y", null, true, 2.5]}, "d": "t", "e": {}}', "[[7], 8]", "no json", None, "7", '{"p": {"q": {"r": {"s": {"t": 1}}}}}']
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "id long, text string, other string")
    rows = {(r.id, r.path): (r.kind, r.value) for r in json_fields(df, "text").collect()}
    assert rows == {
        (0, "a"): ("number", "1"), (0, "b.c.0"): ("number", "1"), (0, "b.c.1"): ("string", 'x"y'), (0, "b.c.2"): ("null", "null"), (0, "b.c.3"): ("boolean", "true"), (0, "b.c.4"): ("number", "2.5"),
        (0, "d"): ("string", "t"), (1, "0.0"): ("number", "7"), (1, "1"): ("number", "8"), (5, "p.q.r.s"): ("object", '{"t":1}'),
    }

"""The jobs over growing and repeated input, by copies in temporary folders."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from corpusql.errors import ConfigurationError
from jobs import compare_systems as C
from jobs import index_documents as I
from jobs.queries import ORACLES, QUERIES

REPO = Path(__file__).parent.parent
TEXT = "Alpha beta gamma delta. Second sentence of some length here. Third one ends."
OWN = I.settings({"retrieval": {"chunking": {"strategy": "semantic", "chunk_size": 40, "overlap": 0, "min_chunk_size": 5}}})


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    before = dict(spark.conf.getAll)
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert rows(mine) == rows(theirs)
    assert dict(spark.conf.getAll) == before


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        documents, index, checkpoint = f"file://{tmp_path}/documents", f"file://{tmp_path}/index", f"file://{tmp_path}/checkpoint"

        def add(self, *found):
            spark.createDataFrame(list(found), "doc_id long, text string, lang string, load string").coalesce(1).write.mode("append").parquet(self.documents)

        def run(self):
            return I.index_documents(spark, self.documents, self.index, self.checkpoint, OWN)

        def current(self):
            return sorted(tuple(r) for r in I.current(spark, self.index).select("doc_id", "load", "chunk_index", "content", "language").collect())

    return Place()


def test_index_takes_only_what_is_new(spark, place):
    place.add((1, TEXT, "en", "x"), (2, "Only this one sentence.", None, "x"), (None, "nobody", "en", "x"), (3, "  ", "", "x"), (4, None, "en", "x"))
    assert place.run() == {"loads": 1, "rows": 5, "documents": 4, "chunks": 4}
    assert place.run() == {"loads": 0, "rows": 0, "documents": 0, "chunks": 0}
    first = place.current()
    assert [r[0] for r in first] == [1, 1, 1, 2] and {r[4] for r in first} == {"en", "und"}

    # A new document, one with the same text, one with another and one that is blank now.
    place.add((5, "A fifth document came.", "de", "x"), (1, TEXT, "en", "x"), (2, "Its text has changed.", None, "x"))
    assert place.run() == {"loads": 1, "rows": 3, "documents": 2, "chunks": 2}
    place.add((5, " ", "de", "x"))
    assert place.run() == {"loads": 1, "rows": 1, "documents": 1, "chunks": 0}
    assert place.current() == [*first[:3], (2, 1, 0, "Its text has changed", "und")]
    assert I.read_chunks(spark, place.index).count() == 6  # earlier loads stay
    place.add((2, "Its text has changed.", None, "x"), (2, "Only this one sentence.", None, "x"))  # of several rows in a file the last text counts
    assert place.run()["documents"] == 1
    assert place.current()[3] == (2, 3, 0, "Only this one sentence", "und")


def test_two_runs_give_what_one_gives(spark, place, tmp_path):
    docs = [(i, f"{TEXT} Number {i} is told apart here.", "en", "x") for i in range(40)]
    place.add(*docs[:15])
    place.run()
    place.add(*docs[15:])
    place.run()
    whole = I.index_documents(spark, place.documents, f"{place.index}-whole", f"{place.checkpoint}-whole", OWN)
    assert whole["loads"] == 1 and whole["documents"] == 40
    plain = lambda index: sorted(tuple(r) for r in I.current(spark, index).drop("load").withColumn("embedding", F.col("embedding").cast("string")).collect())
    assert plain(place.index) == plain(f"{place.index}-whole")


def test_an_interrupted_load_is_written_again(spark, place, tmp_path):
    place.add((1, TEXT, "en", "x"))
    place.run()
    place.add((1, "The text is another one.", "en", "x"), (2, TEXT, "fr", "x"))
    place.run()
    after, stored = place.current(), I.read_chunks(spark, place.index).count()
    (tmp_path / "checkpoint" / "commits" / "1").unlink()  # as if the run had ended before it was noted
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert place.run()["documents"] == 2
    assert place.current() == after and I.read_chunks(spark, place.index).count() == stored


def test_an_empty_folder(spark, place, tmp_path):
    (tmp_path / "documents").mkdir()
    assert place.run() == {"loads": 0, "rows": 0, "documents": 0, "chunks": 0}


CONFIG = {"retrieval": {"chunking": {"strategy": "semantic", "chunk_size": 60, "overlap": 0, "min_chunk_size": 5}, "similarity_threshold": 0.1, "top_k": 2}, "long_question": 20}


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, f"Topic number{i} speaks of number{i} things. " * 6 + TEXT, "x") for i in range(6)] + [(6, None, "x"), (7, "", "x")]
    asked = [(1, "number1", 9), (2, "number2 things of number2", 9), (2, "a lesser text", 9), (3, None, 9), (None, "nobody asks", 9), (4, "zzzz", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, system string").write.parquet(f"file://{tmp_path}/docs")
    spark.createDataFrame(asked, "item_id long, text string, kind int").write.parquet(f"file://{tmp_path}/asked")
    return f"file://{tmp_path}/docs", f"file://{tmp_path}/asked", f"file://{tmp_path}/out"


def test_comparison_reruns_and_replaces_one_system(spark, tables):
    out = tables[2]
    first = C.compare_systems(spark, *tables, C.settings(CONFIG))
    read = lambda: (rows(C.read_hits(spark, out).toPandas()), rows(C.read_report(spark, out).toPandas()))
    before = read()
    assert first["documents"] == 8 and first["questions"] == 4 and first["report"] == 8 + 9
    assert C.compare_systems(spark, *tables, C.settings(CONFIG)) == first and read() == before

    report = C.read_report(spark, out)
    best = {(r.query_id, r.system): r for r in report.filter("level = 'question'").collect()}
    assert best[1, "vanilla"].kind == "short" and best[2, "vanilla"].kind == "long"
    assert best[1, "vanilla"].mean_shared_documents >= 1 and best[3, "vanilla"].mean_confidence == 0
    assert {r.system for k, r in best.items() if k[0] == 3 and r.most_confident} == {"hierarchical"}  # both 0: ties by name
    whole = report.filter("level = 'all'").first()
    assert whole.n == 8 and whole.mean_confidence == pytest.approx(sum(r.mean_confidence for r in best.values()) / 8, abs=1e-6)

    # One system with other settings: the other's hits stay.
    C.compare_systems(spark, *tables, C.settings(CONFIG | {"systems": ["vanilla"], "retrieval": CONFIG["retrieval"] | {"top_k": 1}}))
    after = C.read_hits(spark, out)
    assert after.filter("system = 'vanilla'").agg(F.max("rank")).first()[0] == 1
    assert rows(after.filter("system = 'hierarchical'").toPandas()) == [r for r in before[0] if "'hierarchical'" in r]
    assert C.read_report(spark, out).filter("level = 'question'").count() == 8


def test_settings():
    assert I.settings(json.loads((REPO / "jobs/index_documents.json").read_text())).retrieval.chunking.chunk_size == 400
    assert C.settings(json.loads((REPO / "jobs/compare_systems.json").read_text())).systems == ("hierarchical", "vanilla")
    with pytest.raises(ConfigurationError):
        C.settings({"systems": ["none"]})
    with pytest.raises(ConfigurationError):
        I.settings({"retrieval": {"top_k": 0}})


def test_command_lines(spark, tables, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG | {"systems": ["vanilla"]}))
    (tmp_path / "i.json").write_text(json.dumps({"files_per_batch": 1}))
    docs, asked, out = tables
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    for script, *told in (("index_documents.py", docs, f"{out}-index", f"{out}-mark", "--config", str(tmp_path / "i.json")), ("compare_systems.py", docs, asked, out, "--config", str(tmp_path / "c.json"))):
        done = subprocess.run([sys.executable, str(REPO / "jobs" / script), *told], env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]
        assert "INFO" in done.stderr and "wrote" in done.stderr
    assert I.current(spark, f"{out}-index").select("doc_id").distinct().count() == 6
    assert C.read_hits(spark, out).count() > 0

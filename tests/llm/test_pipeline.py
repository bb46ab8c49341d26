import string
from collections import Counter

import pytest
from test_shingles import kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusql.llm import scratch, toxicity  # noqa: E402
from corpusql.llm.mixing import mix  # noqa: E402

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_each_stage_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = out.collect()
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
            assert Counter(after) == Counter(r for r in before if not scores[r.doc_id])
        elif name == "exact_dedup":
            last = {}
            for r in before:
                key = r.text.translate(LOWER)
                last[key] = max(r.doc_id, last.get(key, -1))
            assert sorted(r.doc_id for r in after) == sorted(last.values())
        elif name == "near_dedup":
            # The stage takes five words and a similarity of 0.8, whatever the query of the operator takes.
            ids = [r.doc_id for r in sorted(before, key=lambda r: r.doc_id)]
            texts = [r.text for r in sorted(before, key=lambda r: r.doc_id)]
            assert sorted(r.doc_id for r in after) == sorted(ids[i] for i in kept(texts))
        else:
            copies = {r.doc_id: r.n_copies for r in mix(docs).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in copies.items() if n})
        docs = spark.createDataFrame(after, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    assert set(whole) == {r.doc_id for r in docs.collect()}


def test_run(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    found = corpus_pipeline.run(spark, SF)
    assert "sequence_id" in found.columns and found.count() > 0


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_stages_one_after_the_other_over_awkward_rows(spark, monkeypatch, request, table):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    docs = request.getfixturevalue(table)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert (docs.count() == 0) == (table == "nothing")


def test_tables_in_between_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 20)
    before = len(scratch._written)
    found = corpus_pipeline.run(spark, SF)
    left = len(scratch._written) - before
    assert left <= 4 and found.count() > 0  # the last stage's own tables and its input

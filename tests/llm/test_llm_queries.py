"""The registered queries run over whole tables, and agree with their SQL where they have any."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from corpusql.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):  # longs with nulls among them come as doubles
            return int(v) if v == int(v) else round(float(v), 6)
        return v

    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_topk": ["query_id", "rank", "vec_id", "score"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_url_filters": ["page_id", "host", "path", "rule", "verdict"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name not in ("op5_packing", "op10_topk", "op11_prefix_trie"):
        assert found.count() == spark.read.parquet(f"{SF}/{'pages' if name == 'op12_url_filters' else 'documents'}.parquet").count()

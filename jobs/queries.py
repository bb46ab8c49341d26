"""The jobs as queries over the given tables, run twice into one new folder, and their SQL in DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.oracles import CLEANED, SYSTEMS_SQL, semantic_chunks, vector_texts
from corpusql.storage import shared_folder
from jobs import compare_systems as C
from jobs import index_documents as I


#: Whole numbers that are -1 in the queries' rows where there are none.
NUMBERS_1, NUMBERS_2 = ["chunk_index", "chunk_size", "token_count"], ["query_id", "rank", "doc_id", "n"]


def _config(name: str) -> dict[str, Any]:
    return json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))


def _new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the index with their chunks; vectors as texts of millionths."""
    folder, own = _new_folder(spark, "job1"), I.settings(_config("index_documents"))
    for _ in range(2):  # the second run finds nothing new
        I.index_documents(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/index", f"{folder}/checkpoint", own)
    index = f"{folder}/index"
    vector = F.array_join(F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    chunks = I.read_chunks(spark, index).withColumn("vector", vector).drop("embedding", "chunk_position", "strategy")
    return I.read_documents(spark, index).join(chunks, ["doc_id", "load"], "left").fillna(-1, NUMBERS_1)


def job2_compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and report, in one table: rows of hits have the level 'hit'."""
    folder, own = _new_folder(spark, "job2"), C.settings(_config("compare_systems"))
    for _ in range(2):
        C.compare_systems(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder, own)
    hits = C.read_hits(spark, folder).withColumn("level", F.lit("hit"))
    return hits.unionByName(C.read_report(spark, folder), allowMissingColumns=True).fillna(-1, NUMBERS_2).fillna(False, ["most_confident"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_documents, job2_compare_systems)}

ORACLES: dict[str, str] = {
    "job1_index_documents": f"""
        WITH RECURSIVE {CLEANED}, {semantic_chunks(400, 50, 100)}, named AS (
            SELECT doc_id::VARCHAR || '_semantic_' || chunk_index::VARCHAR AS chunk_id, doc_id, chunk_index, content,
                   len(content)::INT AS chunk_size, (len(content) // 4)::INT AS token_count FROM chunks
        ), {vector_texts("named", "chunk_id", "content")}
        SELECT * REPLACE ({", ".join(f"coalesce({c}, -1) AS {c}" for c in NUMBERS_1)}) FROM (SELECT d.doc_id, 0::BIGINT AS load, sha256(coalesce(text, '')) AS text_hash, chunk_id, chunk_index, content, chunk_size, token_count, vector,
               CASE WHEN chunk_id IS NOT NULL THEN coalesce(nullif(lang, ''), 'und') END AS language
        FROM documents d LEFT JOIN (SELECT * FROM named JOIN vectors USING (chunk_id)) n ON n.doc_id = d.doc_id)
    """,
    "job2_compare_systems": f"""
        {SYSTEMS_SQL}, h AS (
            SELECT query_id, rank, chunk_id, doc_id, score, score AS similarity, NULL::DOUBLE AS parent_similarity, 'vanilla' AS system FROM hits
            UNION ALL SELECT query_id, rank, chunk_id, doc_id, score, similarity, parent_similarity, 'hierarchical' FROM top
        ), g AS (
            SELECT query_id, system, count(*) AS chunks, count(DISTINCT doc_id) AS documents, max(score) AS top_score,
                   round(least(1.0::DOUBLE, least(count(*) / 5.0::DOUBLE, 1.0::DOUBLE) * CASE WHEN system = 'vanilla' THEN avg(score) FILTER (score > 0)
                       ELSE 0.4::DOUBLE * avg(score) + 0.4::DOUBLE * avg(similarity) + 0.2::DOUBLE * count(DISTINCT doc_id) / (SELECT count(*) FROM documents) END), 6) AS confidence
            FROM h GROUP BY query_id, system
        ), s AS (
            SELECT query_id, a.system, count(DISTINCT a.doc_id) AS shared FROM h a JOIN h b USING (query_id, doc_id) WHERE a.system <> b.system GROUP BY ALL
        ), q AS (
            SELECT b.item_id AS query_id, y.system, CASE WHEN len(text) < 200 THEN 'short' ELSE 'long' END AS kind, top_score,
                   coalesce(confidence, 0)::DOUBLE AS confidence, coalesce(chunks, 0)::DOUBLE AS chunks, coalesce(documents, 0)::DOUBLE AS documents, coalesce(shared, 0)::DOUBLE AS shared_documents
            FROM benchmark b CROSS JOIN (SELECT DISTINCT system FROM h) y LEFT JOIN g ON g.query_id = b.item_id AND g.system = y.system LEFT JOIN s ON s.query_id = b.item_id AND s.system = y.system
        )
        SELECT * REPLACE ({", ".join(f"coalesce({c}, -1) AS {c}" for c in NUMBERS_2)}, coalesce(most_confident, false) AS most_confident) FROM (
        SELECT query_id, rank, chunk_id, doc_id, score, similarity, parent_similarity, system, 'hit' AS level, NULL AS kind, NULL::BIGINT AS n, NULL::DOUBLE AS top_score, NULL::BOOLEAN AS most_confident,
               {", ".join(f"NULL::DOUBLE AS mean_{m}, NULL::DOUBLE AS median_{m}" for m in C.MEASURES)} FROM h
        UNION ALL BY NAME
        SELECT query_id, system, kind, 1::BIGINT AS n, top_score, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, system) = 1 AS most_confident, 'question' AS level,
               {", ".join(f"{m} AS mean_{m}, {m} AS median_{m}" for m in C.MEASURES)} FROM q
        UNION ALL BY NAME
        SELECT ['system_kind', 'system', 'kind', 'all'][grouping(system, kind)::INT + 1] AS level, system, kind, count(*) AS n,
               {", ".join(f"round(avg({m}), 6) AS mean_{m}, round(median({m}), 6) AS median_{m}" for m in C.MEASURES)} FROM q GROUP BY CUBE (system, kind))
    """,
}

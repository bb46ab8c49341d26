"""Retrieval systems that hold an index: add documents, ask, look at statistics, clear.

A system keeps DataFrames, never rows. Documents come as a DataFrame
(doc_id, text) or as paths of files; each load is added to those before it.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.config import RetrievalConfig, validated
from corpusql.errors import ConfigurationError, RetrievalError
from corpusql.packaging import ship
from corpusql.plans import graph, hierarchical, vanilla
from corpusql.sources.files import load_documents
from corpusql.storage import written


@dataclass
class _Log:
    """What a system has done so far."""

    queries: int = 0
    retrieval_seconds: float = 0.0
    generation_seconds: float = 0.0
    loads: list[str] = field(default_factory=list)


class System(ABC):
    """What all systems share; a subclass says how to index, search, answer and explain."""

    kind: str
    default_k: int | None = 5

    def __init__(self, spark: SparkSession, config: RetrievalConfig = RetrievalConfig()):
        ship(spark)
        self.spark, self.config = spark, validated(config)
        self.clear()

    @abstractmethod
    def _index(self, documents: DataFrame) -> Any: ...

    @abstractmethod
    def _retrieve(self, queries: DataFrame, top_k: int) -> DataFrame: ...

    @abstractmethod
    def _answer(self, queries: DataFrame, hits: DataFrame) -> DataFrame: ...

    @abstractmethod
    def _explain(self, queries: DataFrame, hits: DataFrame) -> DataFrame: ...

    @abstractmethod
    def _sizes(self) -> dict[str, int]: ...

    def clear(self) -> None:
        """Forget documents, index and statistics."""
        self.documents: DataFrame | None = None
        self.errors: DataFrame | None = None
        self.index: Any = None
        self.log = _Log()

    def add_documents(self, documents: DataFrame | str | list[str]) -> None:
        """Add documents and index all of them; files that cannot be read are listed in ``errors``."""
        if not isinstance(documents, DataFrame):
            found, self.errors = load_documents(self.spark, documents)
            documents = found.select("doc_id", F.col("content").alias("text"))
        new = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        self.documents = written(new if self.documents is None else self.documents.unionByName(new))
        self.index = self._index(self.documents)
        self.log.loads.append(time.strftime("%Y-%m-%dT%H:%M:%S"))

    def _asked(self, queries: DataFrame | str) -> DataFrame:
        if self.documents is None:
            raise RetrievalError("no documents have been added")
        return self.spark.createDataFrame([("q", queries)], "query_id string, query string") if isinstance(queries, str) else queries

    def retrieve(self, queries: DataFrame | str, top_k: int | None = None) -> DataFrame:
        """Hits of each query; the exact search takes k from the settings, the others 5 unless told otherwise."""
        return self._retrieve(self._asked(queries), top_k or self.default_k or self.config.top_k)

    def query(self, queries: DataFrame | str, top_k: int | None = None) -> DataFrame:
        """Answers of each query, with its share of the time they took."""
        asked = self._asked(queries)
        began = time.perf_counter()
        hits = written(self.retrieve(asked, top_k))
        searched = time.perf_counter()
        answers = written(self._answer(asked, hits))
        ended = time.perf_counter()
        n = max(1, asked.count())
        self.log.queries += n
        self.log.retrieval_seconds += searched - began
        self.log.generation_seconds += ended - searched
        return answers.withColumn("retrieval_time", F.lit((searched - began) / n)).withColumn("generation_time", F.lit((ended - searched) / n))

    def explain(self, queries: DataFrame | str, top_k: int | None = None) -> DataFrame:
        asked = self._asked(queries)
        return self._explain(asked, written(self.retrieve(asked, top_k)))

    def stats(self) -> dict[str, Any]:
        """Counts of documents, index and queries, and mean seconds per query."""
        n = max(1, self.log.queries)
        return {
            "rag_type": self.kind,
            "documents": 0 if self.documents is None else self.documents.count(),
            **({} if self.index is None else self._sizes()),
            "loads": len(self.log.loads),
            "queries_processed": self.log.queries,
            "avg_retrieval_time": self.log.retrieval_seconds / n,
            "avg_generation_time": self.log.generation_seconds / n,
            "embedding_model": self.config.embedding.model_name,
            "chunking_strategy": self.config.chunking.strategy,
        }


class VanillaSystem(System):
    """Exact search over all chunks."""

    kind, default_k = "vanilla", None

    def _index(self, documents: DataFrame) -> DataFrame:
        return written(vanilla.index(documents, self.config))

    def _retrieve(self, queries: DataFrame, top_k: int) -> DataFrame:
        return vanilla.retrieve(queries, self.index, self.config, top_k)

    def _answer(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return vanilla.answer(queries, hits, self.config)

    def _explain(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return vanilla.explain(queries, hits, self.config)

    def _sizes(self) -> dict[str, int]:
        return {"chunks": self.index.count()}


class HierarchicalSystem(System):
    """Two-stage search over documents, sections and chunks."""

    kind = "hierarchical"

    def _index(self, documents: DataFrame) -> DataFrame:
        return written(hierarchical.index(documents, self.config))

    def _retrieve(self, queries: DataFrame, top_k: int) -> DataFrame:
        return hierarchical.retrieve(queries, self.index, self.config, top_k)

    def _answer(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return hierarchical.answer(queries, hits, self.index, self.config)

    def _explain(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return hierarchical.explain(queries, hits, self.config)

    def _sizes(self) -> dict[str, int]:
        return {f"nodes_level_{r['level']}": r["count"] for r in self.index.groupBy("level").count().collect()}


class GraphSystem(System):
    """Search along a graph of entities."""

    kind = "graph"

    def _index(self, documents: DataFrame) -> graph.GraphIndex:
        return graph.index(documents, self.config)

    def _retrieve(self, queries: DataFrame, top_k: int) -> DataFrame:
        return graph.retrieve(queries, self.index, self.config, top_k)

    def _answer(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return graph.answer(queries, hits, self.index, self.config)

    def _explain(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return graph.explain(queries, hits, self.index, self.config)

    def _sizes(self) -> dict[str, int]:
        return {"chunks": self.index.chunks.count(), "entities": self.index.vertices.count(), "relationships": self.index.relationships.count()}

    def knowledge_graph(self) -> graph.GraphIndex:
        return self.index


SYSTEMS: dict[str, type[System]] = {s.kind: s for s in (VanillaSystem, HierarchicalSystem, GraphSystem)}


def system(kind: str, spark: SparkSession, config: RetrievalConfig = RetrievalConfig()) -> System:
    """A new system by its kind."""
    if kind not in SYSTEMS:
        raise ConfigurationError(f"unknown kind of system: {kind}")
    return SYSTEMS[kind](spark, config)

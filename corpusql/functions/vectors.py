"""Vectors: providers that make them and similarities between them."""

from __future__ import annotations

import hashlib
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.config import EmbeddingConfig
from corpusql.errors import ApiError, ConfigurationError, CorpusError

#: Added to each norm in the cosine, so that zero vectors give 0.
EPSILON = 1e-8
DIGITS = 6  # of similarities that leave an operator


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2))))


def normalized(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    length = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / length)


class Provider(ABC):
    """Makes vectors of texts on the executors; must be picklable."""

    name: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""


class HashingProvider(Provider):
    """Word counts by bucket of the word's md5: similar where texts share words, without a model."""

    def __init__(self, config: EmbeddingConfig):
        self.name, self.dimension = config.model_name, config.dimension
        self._known: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if len(self._known) >= 1 << 18:
            self._known.clear()
        return self._known.setdefault(word, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dimension)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            buckets = [*map(self._known.get, words)]
            if None in buckets:
                buckets = [self._bucket(w) for w in words]
            row += np.bincount(np.array(buckets, dtype=np.int64), minlength=self.dimension)
        return out


class SentenceProvider(Provider):
    """A local sentence-transformers model, where that library is installed."""

    def __init__(self, config: EmbeddingConfig):
        self.name, self.dimension = config.model_name, config.dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ConfigurationError("this model needs the sentence_transformers library") from e
        return np.asarray(SentenceTransformer(self.name).encode(texts))


class RemoteProvider(Provider):
    """A remote embedding service behind a function from texts to vectors."""

    def __init__(self, config: EmbeddingConfig, call: Callable[[str, list[str]], list[list[float]]] | None = None):
        self.name, self.dimension, self.call = config.model_name, config.dimension, call

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.call is None:
            raise ApiError("no client is set for this provider")
        try:
            return np.asarray(self.call(self.name, texts))
        except Exception as e:
            raise ApiError(f"the embedding service failed: {e}") from e


_providers: list[tuple[str, Callable[[EmbeddingConfig], Provider]]] = [
    ("hashing", HashingProvider),
    ("text-embedding", RemoteProvider),
    ("", SentenceProvider),
]


def add_provider(part_of_name: str, make: Callable[[EmbeddingConfig], Provider]) -> None:
    """Register a provider for models whose name contains this; the latest comes first."""
    _providers.insert(0, (part_of_name, make))


def provider(config: EmbeddingConfig) -> Provider:
    return next(make for part, make in _providers if part in config.model_name)(config)


def unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths == 0, 1, lengths)


def embedder(config: EmbeddingConfig) -> Callable[[list[str]], np.ndarray]:
    """A function from texts to one row for each, in batches of the provider's size."""
    make = provider(config)

    def run(texts: list[str]) -> np.ndarray:
        parts = [make.embed(texts[i : i + config.batch_size]) for i in range(0, len(texts), config.batch_size)]
        vectors = np.vstack(parts) if parts else np.zeros((0, config.dimension))
        return unit(vectors) if config.normalize else vectors

    return run


def embed(df: DataFrame, config: EmbeddingConfig = EmbeddingConfig(), text_col: str = "content", into: str = "embedding") -> DataFrame:
    """Add a vector to each row, in batches of the provider's size; null texts count as empty."""
    vectors_of = embedder(config)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(vectors_of(texts.fillna("").tolist())), dtype=object)

    return df.withColumn(into, run(F.col(text_col)))


def embed_once(df: DataFrame, known: DataFrame | None, config: EmbeddingConfig = EmbeddingConfig(), text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Embed each distinct text that ``known`` (text_hash, embedding) lacks; rows with vectors, and the table to keep.

    The table is the cache: joined by content hash, it serves repeated texts
    within a load and across loads. Pass None to begin or to clear it.
    """
    hashed = df.withColumn("text_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    wanted = hashed.groupBy("text_hash").agg(F.first(text_col).alias(text_col))
    if known is not None:
        wanted = wanted.join(known, "text_hash", "left_anti")
    new = embed(wanted, config, text_col).select("text_hash", "embedding")
    kept = new if known is None else known.unionByName(new)
    return hashed.join(kept, "text_hash").drop("text_hash"), kept


def benchmark(texts: list[str], configs: list[EmbeddingConfig]) -> list[dict[str, object]]:
    """For each model: dimension, seconds, texts a second and megabytes of its vectors; or the error it ends with."""
    rows: list[dict[str, object]] = []
    for config in configs:
        began = time.perf_counter()
        try:
            vectors = provider(config).embed(texts)
        except CorpusError as e:
            rows.append({"model": config.model_name, "error": str(e)})
            continue
        seconds = time.perf_counter() - began
        rows.append(
            {"model": config.model_name, "dimension": vectors.shape[1], "seconds": seconds, "texts_per_second": len(texts) / max(seconds, 1e-9), "megabytes": vectors.nbytes / 1e6}
        )
    return rows

"""Exceptions, all below one base."""

from __future__ import annotations


class CorpusError(Exception):
    """Anything that goes wrong in this library."""


class ConfigurationError(CorpusError):
    """Settings are missing or out of range."""


class ProcessingError(CorpusError):
    """A document cannot be read."""


class ChunkingError(CorpusError):
    """A document cannot be cut into chunks."""


class EmbeddingError(CorpusError):
    """Vectors cannot be made."""


class RetrievalError(CorpusError):
    """A search cannot be run."""


class GenerationError(CorpusError):
    """A response cannot be made."""


class EvaluationError(CorpusError):
    """Systems cannot be compared."""


class ApiError(EmbeddingError):
    """A remote provider fails."""

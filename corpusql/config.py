"""Settings of chunking, embedding and retrieval, with the ranges they must lie in."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from corpusql.errors import ConfigurationError


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "fixed_size"
    chunk_size: int = 512
    overlap: int = 50
    min_chunk_size: int = 100
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")


@dataclass(frozen=True)
class EmbeddingConfig:
    model_name: str = "hashing"
    dimension: int = 64
    batch_size: int = 100
    normalize: bool = True


@dataclass(frozen=True)
class RetrievalConfig:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    top_k: int = 5
    similarity_threshold: float = 0.7
    max_context_tokens: int = 4000


def problems(config: RetrievalConfig) -> list[str]:
    """What is out of range, in words."""
    c, e = config.chunking, config.embedding
    checks = [
        (c.chunk_size > 0, "chunk_size must be positive"),
        (c.overlap >= 0, "overlap must not be negative"),
        (c.overlap < c.chunk_size, "overlap must be less than chunk_size"),
        (e.dimension > 0, "dimension must be positive"),
        (e.batch_size > 0, "batch_size must be positive"),
        (config.top_k > 0, "top_k must be positive"),
        (0 <= config.similarity_threshold <= 1, "similarity_threshold must lie between 0 and 1"),
    ]
    return [text for holds, text in checks if not holds]


def validated(config: RetrievalConfig) -> RetrievalConfig:
    if found := problems(config):
        raise ConfigurationError("; ".join(found))
    return config


def updated(config: Any, changes: dict[str, Any]) -> Any:
    """A copy with nested changes merged in; unknown names are an error."""
    known = {f.name for f in fields(config)}
    if unknown := set(changes) - known:
        raise ConfigurationError(f"unknown settings: {sorted(unknown)}")
    merged = {}
    for name, value in changes.items():
        old = getattr(config, name)
        merged[name] = updated(old, value) if is_dataclass(old) and isinstance(value, dict) else tuple(value) if isinstance(old, tuple) else value
    return replace(config, **merged)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ConfigurationError("YAML settings need the yaml library; use JSON") from e
    return yaml


def load(path: str | None = None) -> RetrievalConfig:
    """Settings from a JSON or YAML file; defaults where there is no file."""
    if path is None or not Path(path).exists():
        return RetrievalConfig()
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        data = _yaml().safe_load(text) or {}
    elif path.endswith(".json"):
        data = json.loads(text)
    else:
        raise ConfigurationError(f"unknown settings format: {path}")
    return validated(updated(RetrievalConfig(), data))


def save(config: RetrievalConfig, path: str) -> None:
    if path.endswith((".yaml", ".yml")):
        text = _yaml().safe_dump(json.loads(json.dumps(asdict(config))))
    else:
        text = json.dumps(asdict(config), indent=2)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")

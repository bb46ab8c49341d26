"""Loggers of this library: to the console, and to a file on request."""

from __future__ import annotations

import logging
from pathlib import Path

_FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


def setup(level: str = "INFO", file: str | None = None) -> None:
    """Send this library's records to the console and, if named, to a file."""
    logger = logging.getLogger("corpusql")
    logger.setLevel(level.upper())
    logger.handlers.clear()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(logging.Formatter(_FORMAT))
        logger.addHandler(handler)


def get(name: str) -> logging.Logger:
    return logging.getLogger(f"corpusql.{name}")

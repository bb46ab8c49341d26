"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from corpusql.llm import scratch

MARGIN = 2
_RANGE = float(1 << 64)


def row_hash() -> Column:
    """The place of a row (id, text) in the order of sampling: rows alike in both are one."""
    return F.xxhash64(F.col("id").cast("string"), F.xxhash64("text"))


def labelled_sample(df: DataFrame, keys: DataFrame, groups: str, rows: int, max_bytes: int) -> list[tuple[Row, Any]]:
    """Up to ``rows`` rows for each value of ``groups``, those with the smallest hash, with whole texts.

    ``df`` has columns id, text and whatever else the rows shall hold; ``keys``
    has ``h`` (``row_hash``), size (bytes of text) and ``groups``, so that texts
    are never shuffled. Rows of equal id and text count once. Of a value with
    very many rows only those pass whose hash lies below the share of the range
    that holds ``MARGIN`` times as many as are wanted, so that sorting a value
    in one task means sorting some thousand rows. Texts are then fetched for
    rows whose running size, in order of hash, stays within ``max_bytes``: the
    driver never holds more. A row that does not fit is skipped, and those
    after it still count. Returns each row with its value of ``groups``.
    """
    distinct = scratch.table(keys.groupBy(groups, "h").agg(F.max("size").alias("size")), "sample_keys")
    # One row for each value of ``groups``; written, its size decides how it is met.
    counts = scratch.table(distinct.groupBy(F.col(groups).alias("value")).agg(F.count("*").alias("n")), "sample_counts")
    share = F.least(F.lit(1.0), F.lit(float(MARGIN * rows)) / F.col("n"))
    few = distinct.join(counts, F.col(groups) == F.col("value")).filter(F.col("h") <= share * _RANGE - _RANGE / 2)
    order = Window.partitionBy(groups).orderBy("h")
    ranked = few.select(groups, "h", "size", F.row_number().over(order).alias("place"))
    chosen, held = {}, 0
    for r in ranked.filter(F.col("place") <= rows).orderBy("place", "h").toLocalIterator():
        size = r["size"] or 0
        if held + size > max_bytes:
            continue
        held += size
        chosen[r["h"]] = r[groups]
    if not chosen:
        return []
    hashes = df.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
    columns = F.struct(*df.columns).alias("r")
    # At most ``rows`` hashes for each value; of repeated rows one is fetched.
    found = df.select(row_hash().alias("h"), columns).join(F.broadcast(hashes), "h").groupBy("h").agg(F.first("r").alias("r"))
    return [(r["r"], chosen[r["h"]]) for r in sorted(found.collect(), key=lambda r: r["h"])]

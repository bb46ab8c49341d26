"""Packing documents into sequences: shortest pack first over the length histogram.

One pass over the texts encodes each document, cuts it at multiples of the
sequence length and keeps only lengths and checksums. The histogram of piece
lengths has at most ``max_tokens`` entries however many documents there are;
it is packed on the driver, longest pieces first, each into the emptiest pack.
Packs that hold the same lengths are one pattern with a count. The patterns
then meet the pieces again by rank: the r-th piece of a length takes the r-th
place that the patterns have for that length.

Defined results: a null text counts as empty, its document is the end token
alone; documents of any length are cut; rows with null or equal ids and
repeated rows are documents of their own; pieces of one length take their
places in an order that nothing else depends on; an empty table gives no
pieces; other columns, whatever their names and the case of these, are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import quoted
from corpusql.llm.tokens import ids

#: A rank is counted within groups of about this many pieces.
RANK_GROUP = 50_000


def pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str, ranks: str, end_id: int, max_tokens: int
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, without a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids(tokenizer, ranks)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            owner, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.concatenate([encoder.encode(text.as_py() or ""), end])
                for at in range(0, len(tokens), max_tokens):
                    piece = tokens[at : at + max_tokens]
                    owner.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths longest first) and how many packs follow each.

    Lengths are placed longest first, each into packs with the most room left.
    A step either ends a length or turns one pattern into another, so the
    number of patterns follows from the number of lengths, not of documents.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < length:
                # None has room: open packs and fill each with this length alone.
                each = max_tokens // length
                if full := left // each:
                    put((length,) * each, max_tokens - length * each, full)
                if rest := left % each:
                    put((length,) * rest, max_tokens - length * rest, 1)
                break
            pattern, count = by_room[room].popitem()
            # A run of packs takes as many of this length as bring it level with the next emptier room.
            used = min(left, count)
            if count > used:
                put(pattern, room, count - used)
            put((*pattern, length), room - length, used)
            left -= used
    return [(p, n) for room in sorted(by_room) for p, n in sorted(by_room[room].items()) if n]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of places: first rank, first sequence, places per sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, count in patterns:
        offset, at = 0, 0
        while at < len(pattern):
            length, times = pattern[at], 1
            while at + times < len(pattern) and pattern[at + times] == length:
                times += 1
            runs[length].append((ranks[length], sequence, times, offset))
            ranks[length] += times * count
            offset += times * length
            at += times
        sequence += count
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def _ranked(cut: DataFrame, longest_bar: int) -> DataFrame:
    """Add a gapless rank within each length, counted in salted groups so that no length meets in one task."""
    salts = max(1, -(-longest_bar // RANK_GROUP))
    # By the row's number in the written table, so that equal pieces too are spread.
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("row")
    return salted.withColumn("rank", F.row_number().over(within) - 1).join(groups, ["length", "salt"]).withColumn(
        "rank", F.col("rank") + F.col("ranks_before")
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    end_id: int = 1,
    max_tokens: int = 2048,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids run from 0 without gaps, offsets within a sequence too.
    """
    spark = df.sparkSession
    cut = pieces(df, id_col, text_col, tokenizer, ranks, end_id, max_tokens)
    cut = scratch.table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    table = spark.sparkContext.broadcast(places(pack_histogram(histogram, max_tokens)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                runs = table.value[int(n)]
                run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                step = rank[own] - run[:, 0]
                sequence[own] = run[:, 1] + step // run[:, 2]
                offset[own] = run[:, 3] + step % run[:, 2] * n
            kept = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"]
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return (
        _ranked(cut, max(histogram.values(), default=0))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank"))
        .mapInArrow(
            place,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )

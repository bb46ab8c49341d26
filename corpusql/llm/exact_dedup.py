"""Exact duplicates behind a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every normalised text to two bits of one block of a blocked
Bloom filter, counts how many rows set each bit, and keeps the bits that at
least two rows set. Pass 2 probes each row: where one of its two bits was set
by that row alone, no other row has the same text, and the row passes straight
through. Only the others are shuffled and compared by SHA-256.

The filter has ``BITS_PER_ROW`` bits or more for each row, however many rows
there are, so it lets about as few single rows through at any size. What pass 1
shuffles is a place in the filter for each bit, 24 bytes, never a row. A filter
of at most ``broadcast_bits`` bits (32 MB by default) is broadcast. A larger one
stays distributed: the rows' digests meet its blocks by a join, dealt evenly
since blocks are taken from the hash. Texts never move, at any size: what is
settled on digests comes back as one bit a row, by file (``row_marks``).

Defined results: a null text counts as empty; a null id sorts below all
others; of rows that agree in text and id exactly one stays; blank, empty and
very long texts are compared like any other, as digests; a text that makes up
any share of the rows is met as one of at most 1,024 hot groups, which are
broadcast; an empty table gives an empty result; other columns, whatever their
names and the case of these, are passed on by ``drop_exact_duplicates`` and
ignored by ``exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import fresh, join_groups, lower_ascii, quoted, text_or_empty
from corpusql.llm.row_marks import BLOCK_BITS, BLOCKS, all_distinct, is_set, placed, with_marks

BITS_PER_ROW = 16
BROADCAST_BITS = 1 << 28


def _blocks(rows: int) -> int:
    """Number of filter blocks, a power of two."""
    return max(1, 1 << (BITS_PER_ROW * rows // BLOCK_BITS).bit_length())


def _places(key: Column, blocks: int) -> list[Column]:
    """The block of a key and its two bits in it."""
    h = F.xxhash64(key)
    bit = F.lit(BLOCK_BITS - 1).cast("long")
    return [
        h.bitwiseAND(F.lit(blocks - 1).cast("long")),
        F.shiftrightunsigned(h, 32).bitwiseAND(bit),
        F.shiftrightunsigned(h, 48).bitwiseAND(bit),
    ]


def repeated_bits(keys: Column, df: DataFrame, blocks: int) -> DataFrame:
    """Pass 1: (block, bitmap) of the bits that two or more rows set.

    Counting is partial on the map side, so a text that makes up a third of
    the rows reaches the shuffle as one count per task.
    """
    block, first, second = _places(keys, blocks)
    start = block * BLOCK_BITS
    return (
        df.select(F.explode(F.array(start + first, start + second)).alias("place"))
        .groupBy("place")
        .agg(F.count("*").alias("n"))
        # A row whose two bits coincide counts twice in it; it then takes the exact way, which is right too.
        .filter("n >= 2")
        .groupBy(F.shiftright("place", BLOCK_BITS.bit_length() - 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long"))).alias("bitmap"))
    )


def with_suspects(df: DataFrame, keys: Column, repeated: DataFrame, blocks: int, into: str, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """Pass 2: add a boolean column that is false where no other row has the same key."""
    block, first, second = _places(keys, blocks)
    of_block, bitmap = fresh([*df.columns, into], "block", "bitmap")
    named = repeated.select(F.col("block").alias(of_block), F.col("bitmap").alias(bitmap))
    if blocks * BLOCK_BITS <= broadcast_bits:
        named = F.broadcast(named)  # broadcast_bits / 8 bytes at most
    return (
        df.join(named, block == F.col(of_block), "left")
        .withColumn(into, is_set(F.col(bitmap), first) & is_set(F.col(bitmap), second))
        .drop(of_block, bitmap)
    )


def _settled(rows: DataFrame, broadcast_bits: int) -> tuple[DataFrame, DataFrame]:
    """Of the written table ``rows`` (doc_id, sha, row): the rows that the filter clears, and the others with ``best`` and ``group_size``."""
    blocks = _blocks(rows.count())
    repeated = scratch.table(repeated_bits(F.col("sha"), rows, blocks), "filter")
    probed = with_suspects(rows, F.col("sha"), repeated, blocks, "suspect", broadcast_bits)
    suspects = scratch.table(probed.filter("suspect").select("doc_id", "sha", "row"), "suspects")
    groups = scratch.table(
        suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")), "groups"
    )
    return probed.filter(~F.col("suspect")), join_groups(suspects, groups, "sha", "group_size", suspects.count())


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows whose texts are equal after lower-casing A-Z, the one with the
    largest id stays.
    """
    digest = F.sha2(lower_ascii(text_or_empty(quoted(text_col))).cast("binary"), 256)
    rows = scratch.table(
        df.select(quoted(id_col).alias("doc_id"), F.unhex(digest).alias("sha"), F.monotonically_increasing_id().alias("row")),
        "hashes",
    )
    clear, suspects = _settled(rows, broadcast_bits)
    compared = suspects.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    alone = clear.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(compared)


def drop_exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS, mark_blocks: int = BLOCKS
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Texts are read twice and never shuffled: once for digests, which with ids
    and places (file and row) settle what goes, and once to leave that out, by
    one bit a row. What is not rows of Parquet files as they stand (a join, a
    union, another format) is written as such first.
    """
    run, number = fresh(df.columns, "run", "number")
    text = text_or_empty(quoted(text_col))
    digest = F.unhex(F.sha2(lower_ascii(text).cast("binary"), 256))
    # The raw text's hash, then the place, breaks ties between equal ids, so that reruns agree.
    row = F.struct(F.xxhash64(text).alias("tie"), quoted(run).alias("run"), quoted(number).alias("number"))

    def hashed(at: DataFrame) -> DataFrame:
        return scratch.table(at.select(quoted(id_col).alias("doc_id"), digest.alias("sha"), row.alias("row")), "hashes")

    at = placed(df, run, number)
    rows = None if at is None else hashed(at)
    if rows is None or not all_distinct(rows.select("row.run", "row.number")):
        at = placed(scratch.table(df, "rows"), run, number)
        rows = hashed(at)
    _, suspects = _settled(rows, broadcast_bits)
    gone = suspects.filter(F.col("row") != F.col("best.row")).select("row.run", "row.number")
    (goes,) = fresh(at.columns, "goes")
    marked = with_marks(at, quoted(run), quoted(number), gone, goes, blocks=mark_blocks)
    return marked.filter(~quoted(goes)).drop(run, number, goes)

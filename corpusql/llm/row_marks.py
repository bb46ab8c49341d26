"""Rows marked by a set of places, as one bit for each, sent to where the rows are read.

A place is a run, such as a file, and a number in it. Marks become bitmaps of
``BLOCK_BITS`` numbers of a run, built by ``bitmap_construct_agg``; a row finds
its block by a broadcast join, exactly and without moving. Where all blocks
would be more than one broadcast of ``blocks`` (8,192 of 4 KB, 32 MB) holds, the
runs are cut in their order into slices that hold no more, and the rows of each
slice meet its own blocks. A slice reads its runs alone, as the scan prunes by
the bounds of the slice. So each row is read once, is never shuffled, and no
broadcast grows with the table; only a run with more marks than one broadcast
holds (over 268 million rows in one file) takes as many bits as it has rows.

Defined results: without marks, or without rows, no row is marked; places that
are marked twice count once; runs and numbers are never null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm import scratch
from corpusql.llm.columns import fresh, quoted

BLOCK_BITS = 1 << 15  # what bitmap_construct_agg holds
BLOCKS = 1 << 13


def is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit is set in a bitmap; false where there is none."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), (bit % 8).cast("int")) == 1, F.lit(False))


def block_of(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS.bit_length() - 1)


def bit_of(number: Column) -> Column:
    return number.bitwiseAND(F.lit(BLOCK_BITS - 1).cast("long"))


def _slices(held: DataFrame, blocks: int) -> list:
    """The first run of each slice, in order; one row per run meets in one task."""
    ends = held.groupBy("run").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("run")))
    # A run goes where its first block falls, so a slice exceeds the bound by less than its last run.
    cut = ends.groupBy(F.floor((F.col("end") - F.col("n")) / blocks).alias("slice")).agg(F.min("run").alias("first"))
    return [r["first"] for r in cut.orderBy("slice").collect()]


def with_marks(df: DataFrame, run: Column, number: Column, marks: DataFrame, into: str, from_run: Callable[[object], Column] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Add a boolean column: whether the row's (run, number) is one of ``marks`` (run, number).

    ``from_run(r)`` tells whether a row's run is ``r`` or a later one, in the
    form by which the scan of ``df`` can prune.
    """
    held = scratch.table(
        marks.groupBy("run", block_of(F.col("number")).alias("block")).agg(F.bitmap_construct_agg(bit_of(F.col("number"))).alias("bitmap")), "marks"
    )
    of_run, of_block, bitmap = fresh([*df.columns, into], "run", "block", "bitmap")

    def probed(rows: DataFrame, part: DataFrame) -> DataFrame:
        sent = F.broadcast(part.select(F.col("run").alias(of_run), F.col("block").alias(of_block), F.col("bitmap").alias(bitmap)))
        met = rows.join(sent, (run == F.col(of_run)) & (block_of(number) == F.col(of_block)), "left")
        return met.withColumn(into, is_set(F.col(bitmap), bit_of(number))).drop(of_run, of_block, bitmap)

    if held.count() <= blocks:
        return probed(df, held)
    reaches = from_run or (lambda first: run >= F.lit(first))
    firsts = _slices(held, blocks)
    parts = []
    for i, first in enumerate(firsts):
        rows, part = df, held
        if i:
            rows, part = rows.filter(reaches(first)), part.filter(F.col("run") >= F.lit(first))
        if i + 1 < len(firsts):
            rows, part = rows.filter(~reaches(firsts[i + 1])), part.filter(F.col("run") < F.lit(firsts[i + 1]))
        parts.append(probed(rows, part))
    return functools.reduce(DataFrame.unionByName, parts)


_IN_TASK = 33  # bits of monotonically_increasing_id that count within a task


def with_row_marks(df: DataFrame, row: str, rows: DataFrame, into: str, blocks: int = BLOCKS) -> DataFrame:
    """Add a boolean column: whether a row's number is in the one column of ``rows``.

    Numbers are those of ``monotonically_increasing_id``, written in the table
    that ``df`` reads, so that a task that wrote is a run, and a slice is a range by which row groups are skipped.
    """
    of = quoted(rows.columns[0])
    within = F.lit((1 << _IN_TASK) - 1).cast("long")
    marks = rows.select(F.shiftright(of, _IN_TASK).alias("run"), of.bitwiseAND(within).alias("number"))
    number = quoted(row)
    return with_marks(df, F.shiftright(number, _IN_TASK), number.bitwiseAND(within), marks, into, lambda first: number >= F.lit(first << _IN_TASK), blocks)


def without_rows(df: DataFrame, row: str, rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``df`` whose number is not in the one column of ``rows``; no row is shuffled."""
    (gone,) = fresh(df.columns, "gone")
    return with_row_marks(df, row, rows, gone, blocks).filter(~quoted(gone)).drop(gone)


def placed(df: DataFrame, run: str, number: str) -> DataFrame | None:
    """Rows of Parquet files with the file and the row's number in it, both the same in every scan; None where ``df`` has none such."""
    from pyspark.errors import AnalysisException

    try:
        at = df.metadataColumn("_metadata")
        return df.select("*", at.getField("file_path").alias(run), at.getField("row_index").alias(number))
    except AnalysisException:
        return None


def all_distinct(places: DataFrame) -> bool:
    """Whether no place (run, number) comes twice, told by counts of bits."""
    bits = places.groupBy("run", block_of(F.col("number")).alias("block")).agg(
        F.bitmap_count(F.bitmap_construct_agg(bit_of(F.col("number")))).alias("bits"), F.count("*").alias("n")
    )
    return bits.filter("bits <> n").isEmpty()

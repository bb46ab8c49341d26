"""Column expressions shared by the operators of this subpackage."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    Pure ASCII texts take the built-in ``lower``, which agrees there and is
    much faster than ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words as long; null counts 0."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that is none of the names taken, whatever their case, and none of the others."""
    used = {name.casefold() for name in taken}
    names = []
    for name in wanted:
        while name.casefold() in used:
            name += "_"
        used.add(name.casefold())
        names.append(name)
    return names


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_columns(df: DataFrame, column: str, added: list[StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Add columns computed from batches of one column, without a shuffle.

    ``make`` is called once in each task and gives the function of a batch.
    Columns go through Arrow under plain names, whatever theirs are.
    """
    at, new = df.columns.index(column), [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], [*batch.schema.names, *places])

    plain = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    places = [f"n{i}" for i in range(len(added))]
    schema = StructType([*plain, *(StructField(name, f.dataType) for name, f in zip(places, added, strict=True))])
    return df.toDF(*[f.name for f in plain]).mapInArrow(run, schema).toDF(*df.columns, *new)


#: A key of more than one row in so many is hot; there are at most as many hot keys.
HOT_SHARE = 1 << 10


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with their groups' columns by ``key``, of which ``groups`` has one row each and ``size`` its rows.

    Groups that hold at least one row in ``HOT_SHARE`` of ``total`` are at most
    ``HOT_SHARE``, so they are broadcast and their rows stay where they are;
    the others' rows are shuffled by key, none of which is hot.
    """
    least = max(1, -(-total // HOT_SHARE))
    hot, cold = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    few = rows.join(F.broadcast(hot), key)  # at most HOT_SHARE rows
    many = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return few.unionByName(many)

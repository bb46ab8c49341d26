"""All pairs of texts whose word sets are similar, by signatures of parts of the sets.

Sets of Jaccard similarity ``t`` or more differ in few words: in at most
``(1 - t) / (1 + t)`` of the words of both. Words are dealt into slices by a hash,
and each slice into one more part than a slice of such a pair may differ in, so in some slice
the two differ in no more than its share and one of its parts is the same in both. A signature for each part and an equi
join on them finds all pairs. Parts hold several words, so other sets seldom share one, and
those that do are told apart by a sketch of the slice: bits of its words, added modulo two, differ in
at most as many places as the words do. Slices are small, so sketches tell large sets apart too.

How sets are sliced follows from the range of sizes in which the larger set of a pair lies: a set
has signatures for its own range and, as the smaller set, for the next. Of signatures that no
two sets share, most are never shuffled with their rows: all are counted first, as numbers alone, and a
filter of bits of bounded size keeps the others. What reaches the comparison of the sets themselves is
little more than what is similar.
Texts of one word set are one class and are compared once.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions.text import words
from corpusql.functions.vectors import DIGITS
from corpusql.storage import written

#: Words held by every task because they are the most frequent, in a search by prefixes; signatures need none.
FREQUENT_WORDS = 4_096
#: Numbers of 64 bits in a sketch.
SKETCH = 4
#: Words of a slice, at most, on average: few enough that its sketch tells sets apart.
SLICE = 192
#: Bits, as a power of two, of the filter of shared signatures: 32 MB at most.
LEAST_BITS, MOST_BITS = 16, 28
#: Pairs of rows that are compared at a time.
PAIRS = 1 << 20
_BITS = [f"s{i}" for i in range(SKETCH)]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): the least id among the texts of the same word set; a text without words is alone."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(words(F.lower(F.coalesce(text_col, F.lit("")))))).alias("words"))
    # Read twice: written, words are sorted and hashed once.
    keyed = written(own.select("doc_id", F.when(F.size("words") > 0, F.sha2(F.array_join("words", " "), 256)).otherwise(F.concat(F.lit("-"), F.col("doc_id").cast("string"))).alias("key")))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"))  # a hot class is a row per task here, and one row in the join
    return keyed.join(least, "key").select("doc_id", "class_id")


def _representatives(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(class_id, words) of classes with any word."""
    heads = members.filter("doc_id = class_id").select("class_id").distinct()
    own = docs.select(F.col(id_col).alias("class_id"), F.array_distinct(words(F.lower(F.coalesce(text_col, F.lit(""))))).alias("words"))
    return own.join(heads, "class_id").filter(F.size("words") > 0).dropDuplicates(["class_id"])


def prefix_length(n: int, threshold: float) -> int:
    """So many first words, in any common order, of which similar sets of this size share one."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def sketch(words: list[str]) -> np.ndarray:
    """The parity of the words at each of the bits."""
    places = np.fromiter((zlib.crc32(w.encode()) % (64 * SKETCH) for w in words), np.int64, len(words))
    odd = np.bincount(places, minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Range(NamedTuple):
    """Sizes up to ``top``, and how the sets of a pair whose larger one lies there are cut: into slices, of which one differs in at most ``differ`` words."""

    place: int
    top: int
    slices: int
    differ: int


def ranges(threshold: float, size: int) -> list[Range]:
    """Ranges of sizes up to that of ``size`` and the next one; sets of a pair lie in one range or in neighbours."""
    found: list[Range] = []
    top = 1
    while True:
        slices = -(-top // SLICE)
        found.append(Range(len(found), top, slices, math.floor(2 * top * (1 - threshold) / (1 + threshold) + 1e-6) // slices))
        if len(found) > 1 and found[-2].top >= size:
            return found
        top = max(top + 1, math.floor(top / threshold + 1e-9))


_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(32))) * _MIX
    return (numbers ^ (numbers >> np.uint64(29))) * _TURN


def signatures(hashes: np.ndarray, own: Range) -> tuple[np.ndarray, np.ndarray]:
    """(slices, parts) signatures of a set of words, given by their hashes, and (slices, SKETCH) sketches."""
    parts = own.differ + 1
    slice_ = (hashes >> np.uint64(40)) % np.uint64(own.slices)
    part = (slice_ * np.uint64(parts) + (hashes >> np.uint64(12)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(own.slices * parts, np.uint64)
    np.add.at(sums, part, _mixed(hashes))
    keys = _mixed(sums + _mixed(np.arange(len(sums), dtype=np.uint64) + np.uint64(own.place << 32)))
    odd = np.bincount(slice_.astype(np.int64) * 64 * SKETCH + (hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=own.slices * 64 * SKETCH) % 2
    return keys.view(np.int64).reshape(own.slices, parts), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(own.slices, SKETCH)


def _signed(sets: DataFrame, threshold: float, shared: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """(key, own) of every part of the sets, ``own`` where the range is the set's own; with the filter of shared keys
    (key, own, class_id, n, slices, differ, s0, ...) of those parts that pass it."""
    sent = None if shared is None else sets.sparkSession.sparkContext.broadcast(shared)
    kind = sets.schema["class_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranges(threshold, 1)
        tops = [r.top for r in known]
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6 + SKETCH)]
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
            for i, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                hashes = flat[begin:end]
                if known[-2].top < len(hashes):
                    known = ranges(threshold, len(hashes))
                    tops = [r.top for r in known]
                at = bisect_left(tops, len(hashes))
                for own in known[at : at + 2]:
                    keys, bits = signatures(hashes, own)
                    slice_ = np.repeat(np.arange(own.slices), own.differ + 1)
                    keys = keys.reshape(-1)
                    if sent is not None:
                        keep = np.flatnonzero(_passes(keys, *sent.value))
                        keys, slice_ = keys[keep], slice_[keep]
                    some = np.ones(len(keys), np.int64)
                    columns[0].append(keys)
                    columns[1].append(some * (own.place == at))
                    if sent is not None:
                        for column, values in zip(columns[2:], (i * some, len(hashes) * some, own.slices * some, own.differ * some, *bits[slice_].T), strict=True):
                            column.append(values)
            key, own, *rest = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            told = [pa.array(key, pa.int64()), pa.array(own == 1)]
            if sent is not None:
                told += [batch.column(0).take(pa.array(rest[0], pa.int64())), *(pa.array(r.astype(np.int32)) for r in rest[1:4]), *map(pa.array, rest[4:])]
            yield pa.RecordBatch.from_arrays(told, names)

    names = ["key", "own"] + ([] if shared is None else ["class_id", "n", "slices", "differ", *_BITS])
    more = f", class_id {kind}, n int, slices int, differ int, " + ", ".join(f"{b} long" for b in _BITS)
    return sets.select("class_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")).mapInArrow(run, "key long, own boolean" + ("" if shared is None else more))


def _place(keys: np.ndarray, power: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)


def _passes(keys: np.ndarray, power: int, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter holds."""
    place = _place(keys, power)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0


def _shared(sets: DataFrame, threshold: float) -> tuple[int, np.ndarray]:
    """The filter of keys that two sets share, one of them in its own range: the power of two of its bits, and these."""
    counts = _signed(sets, threshold).groupBy("key").agg(F.count("*").alias("n"), F.bool_or("own").alias("own")).filter("n > 1 AND own")
    keys = written(counts.select("key"))
    power = min(MOST_BITS, max(LEAST_BITS, 4 + keys.count().bit_length()))
    place = F.shiftrightunsigned("key", 64 - power)
    held = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - power}) & 63 AS INT))")).alias("bits")).toArrow()  # as many rows as words at most
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return power, bits


def _met(threshold: float):
    """Pairs of classes with a common key whose sketches do not rule them out, from rows sorted by key, own ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the own rows of the key that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            before = 0 if held is None else held.num_rows
            rows = batch if not before else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, own = rows.column("key").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False)
            n, slices, differ, *bits = (rows.column(c).to_numpy() for c in ("n", "slices", "differ", *_BITS))
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([begins, [len(key)]]))
            first, owned = np.repeat(begins, sizes), np.repeat(np.add.reduceat(own.astype(np.int64), begins), sizes)
            # Each new row meets the own rows of its key that stand before it.
            counts = np.minimum(np.arange(len(key)) - first, owned)
            counts[:before] = 0
            at = 0
            while at < len(key):
                until = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS, "right")) + at)
                some = counts[at:until]
                one = np.repeat(np.arange(at, until), some)
                other = np.arange(len(one)) - np.repeat(np.cumsum(some) - some, some) + first[one]
                small, large = np.minimum(n[one], n[other]), np.maximum(n[one], n[other])
                fits = np.flatnonzero(small >= threshold * large - 1e-9)
                one, other, total = one[fits], other[fits], (small + large)[fits]
                most = np.where(slices[one] == 1, total - 2 * np.ceil(threshold / (1 + threshold) * total - 1e-9), differ[one])
                apart = sum(np.bitwise_count((b[one] ^ b[other]).view(np.uint64)).astype(np.int64) for b in bits)
                keep = np.flatnonzero(apart <= most)
                if len(keep):
                    ends = [rows.column("class_id").take(pa.array(x[keep])) for x in (one, other)]
                    yield from pa.table(ends, names=["class_id_a", "class_id_b"]).to_batches()
                at = until
            last = np.flatnonzero((np.arange(len(key)) >= begins[-1]) & own)
            held = rows.take(pa.array(last))

    return run


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", members: DataFrame | None = None) -> DataFrame:
    """(doc_a, doc_b, similarity): all pairs of classes, by their least ids, whose word sets have a Jaccard similarity of the threshold or more.

    ``members`` is what ``classes`` gave, if it is at hand. Null texts are
    empty; texts without words are similar to none; of rows with one id
    one counts.
    """
    members = written(classes(docs, id_col, text_col)) if members is None else members
    sets = written(_representatives(docs, members, id_col, text_col))
    rows = _signed(sets, threshold, _shared(sets, threshold)).repartition("key").sortWithinPartitions("key", F.desc("own"))
    kind = sets.schema["class_id"].dataType.simpleString()
    met = rows.mapInArrow(_met(threshold), f"class_id_a {kind}, class_id_b {kind}")
    pairs = written(met.select(F.least("class_id_a", "class_id_b").alias("class_id_a"), F.greatest("class_id_a", "class_id_b").alias("class_id_b")).distinct())
    both = pairs.join(sets.select(F.col("class_id").alias("class_id_a"), F.col("words").alias("words_a")), "class_id_a").join(
        sets.select(F.col("class_id").alias("class_id_b"), F.col("words").alias("words_b")), "class_id_b"
    )
    overlap = F.size(F.array_intersect("words_a", "words_b"))
    value = overlap / (F.size("words_a") + F.size("words_b") - overlap)
    return both.select(F.least("class_id_a", "class_id_b").alias("doc_a"), F.greatest("class_id_a", "class_id_b").alias("doc_b"), value.alias("value")).filter(F.col("value") >= threshold).select(
        "doc_a", "doc_b", F.round("value", DIGITS).alias("similarity")
    )


def similar_counts(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): how many other texts are similar to each one; those of its own class are."""
    members = written(classes(docs, id_col, text_col))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    pairs = written(similar_pairs(docs, threshold, id_col, text_col, members))
    both = pairs.select(F.col("doc_a").alias("class_id"), F.col("doc_b").alias("other")).unionAll(pairs.select("doc_b", "doc_a"))
    links = both.join(sizes.select(F.col("class_id").alias("other"), "size"), "other").groupBy("class_id").agg(F.sum("size").alias("others"))
    told = sizes.join(links, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(told, "class_id").select("doc_id", "class_id", "n_links")

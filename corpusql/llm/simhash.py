"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint: a bit is set if over half of its word
shingles' XXH64 values set it. Equal fingerprints are merged before anything
is compared. The distinct ones are ordered by the population counts of their
two halves and cut into tiles of at most ``TILE``; each pair of tiles whose
counts come within the radius meets in one task, which compares them block by
block with exclusive-or and bit counts and again skips pairs of blocks whose
counts differ too much. A task returns links to one representative per local
group, at most one per fingerprint however many pairs it finds, and the links
are joined into components.

The work grows with the square of the number of distinct fingerprints, as the
method implies; the counts of two halves leave about a third of the pairs.

Defined results: null texts count as empty; a text without words, empty or
blank, has fingerprint 0 and is linked like any other; a null id takes part in
its group but is nobody's component id unless the group has no other; rows
with equal ids, repeated rows too, are rows of their own; of very long texts a
bounded number of shingles is hashed at once; a fingerprint that makes up any
share of the rows is one of at most 1,024 hot ones, which are broadcast; an
empty table gives an empty result; other columns, whatever their names and the
case of these, are ignored by ``near_duplicates`` and passed on by
``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from corpusql.llm import scratch
from corpusql.llm.columns import fresh, join_groups, quoted, with_columns
from corpusql.llm.components import components
from corpusql.llm.row_marks import without_rows

TILE = 1 << 15
BLOCK = 1 << 9
HASHED = 1 << 16  # shingles of a text hashed at once
SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    from xxhash import xxh64_digest

    # On bytes, lower() changes A-Z only and split() cuts at the six ASCII white-space characters.
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    n = len(words) - size + 1
    set_by = np.zeros(64, np.int64)
    for at in range(0, n, HASHED):
        spans = zip(starts[at : at + HASHED][: n - at].tolist(), ends[at + size - 1 : at + size - 1 + HASHED].tolist())  # noqa: B905
        rows = np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        set_by += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * set_by > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text_col: str, into: str, shingle: int) -> DataFrame:
    """Add the fingerprint as a signed long, without a shuffle."""

    def prints(texts: pa.Array) -> list[pa.Array]:
        found = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in texts), np.uint64, len(texts))
        return [pa.array(found.view(np.int64))]

    return with_columns(df, text_col, [StructField(into, LongType())], lambda: prints)


def _halves(prints: np.ndarray) -> np.ndarray:
    """Population counts of the upper and lower half, as two rows."""
    return np.stack([np.bitwise_count(prints >> np.uint64(32)), np.bitwise_count(prints & np.uint64(0xFFFFFFFF))]).astype(np.int64)


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Least difference of counts between boxes, summed over the halves."""
    gap = np.maximum(np.maximum(low_a[:, :, None] - high_b[:, None, :], low_b[:, None, :] - high_a[:, :, None]), 0)
    return gap.sum(axis=0)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking members i and j; a label is the least member of its group."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(to, further := to[to]):
            to = further
        label = to[label]


def linked(left: np.ndarray, right: np.ndarray | None, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, representative) of one pair of tiles, or of a tile with itself if ``right`` is None."""

    def blocks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        halves = _halves(prints)
        order = np.lexsort((halves[1], halves[0]))
        prints, halves = prints[order], halves[:, order]
        at = np.arange(0, len(prints), block)
        return prints, at, np.minimum.reduceat(halves, at, axis=1), np.maximum.reduceat(halves, at, axis=1)

    a, at_a, low_a, high_a = blocks(left)
    b, at_b, low_b, high_b = (a, at_a, low_a, high_a) if right is None else blocks(right)
    members = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    label = np.arange(len(members))
    near = _apart(low_a, high_a, low_b, high_b) <= radius
    if right is None:
        near &= np.arange(len(at_a))[:, None] <= np.arange(len(at_b))[None, :]
    for x, y in zip(*np.nonzero(near), strict=True):
        i, j = at_a[x], at_b[y]
        close = np.bitwise_count(a[i : i + block, None] ^ b[None, j : j + block]) <= radius
        if right is None and x == y:
            np.fill_diagonal(close, False)
        if close.any():
            p, q = np.nonzero(close)
            label = merged(label, p + i, q + j + shift)
    member = np.flatnonzero(label != np.arange(len(label)))
    return members[member], members[label[member]]


def _tile_plan(cells: list[tuple[int, int, int]], radius: int, tile: int) -> tuple[list[tuple], list[tuple]]:
    """Where each cell's fingerprints go, and which groups of tiles meet.

    ``cells`` has (upper count, lower count, fingerprints), at most 33 x 33
    rows. Neighbouring cells share a group while they fit one tile; a cell
    beyond a tile is a group of its own, split into several tiles.
    """
    where, boxes, held = [], [], tile + 1
    for upper, lower, n in sorted(cells):
        if held + n > tile:
            boxes.append([upper, lower, upper, lower, 1])
            held = 0
        held += n
        box = boxes[-1]
        boxes[-1] = [min(box[0], upper), min(box[1], lower), max(box[2], upper), max(box[3], lower), -(-held // tile)]
        where.append((upper, lower, len(boxes) - 1, boxes[-1][4]))
    edges = np.array(boxes, np.int64).reshape(-1, 5)
    apart = _apart(edges[:, :2].T, edges[:, 2:4].T, edges[:, :2].T, edges[:, 2:4].T)
    meet = [(int(g), int(h), int(edges[h, 4])) for g, h in zip(*np.nonzero(apart <= radius), strict=True)]
    return where, meet


def links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``fp`` that join all within ``radius`` bits."""
    spark = prints.sparkSession
    halves = prints.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).alias("upper"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lower"),
    )
    cells = [(r.upper, r.lower, r.n) for r in halves.groupBy("upper", "lower").agg(F.count("*").alias("n")).collect()]
    where, meet = _tile_plan(cells, radius, tile)
    placed = spark.createDataFrame(where, "upper int, lower int, g int, tiles int")
    tiles = (
        halves.join(F.broadcast(placed), ["upper", "lower"])  # at most 33 x 33 rows
        .withColumn("s", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy("g", "s")
        .agg(F.collect_list("fp").alias("prints"))
    )
    partners = spark.createDataFrame(meet, "g int, other int, others int")
    own, other = F.struct("g", "s"), F.struct(F.col("other").alias("g"), F.col("t").alias("s"))
    pairs = (
        tiles.join(F.broadcast(partners), "g")  # at most 1,089 x 1,089 rows
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .select(F.least(own, other).alias("first"), F.greatest(own, other).alias("second"), "prints")
    )

    def compare(group: pa.Table) -> pa.Table:
        sides = [np.asarray(p.values).view(np.uint64) for p in group.column("prints")]
        member, representative = linked(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pa.table({"a": member.view(np.int64), "b": representative.view(np.int64)})

    return pairs.groupBy("first", "second").applyInArrow(compare, "a long, b long")


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, n, component) for the table rows (fp, who): its rows, and the least ``who`` of its component, nulls last."""
    least = F.min("who")  # skips null
    prints = scratch.table(rows.groupBy("fp").agg(least.alias("first"), F.count("*").alias("n")), "fingerprints")
    roots = scratch.table(components(links(prints, radius)), "roots")
    joined = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    leaders = joined.groupBy("root").agg(F.min("first").alias("leader"))
    sizes = joined.groupBy("root").agg(F.count("*").alias("prints"))
    linked = joined.select("fp", "root")
    groups = join_groups(linked, leaders.join(sizes, "root"), "root", "prints", linked.count()).select("fp", "leader", F.lit(True).alias("linked"))
    grouped = prints.join(groups, "fp", "left").select(
        "fp", "n", F.when(F.col("linked"), F.col("leader")).otherwise(F.col("first")).alias("component")
    )
    return scratch.table(grouped, "grouped")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    slim = df.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    rows = scratch.table(with_fingerprints(slim, "text", "fp", shingle).drop("text"), "rows")
    groups = _grouped(rows.select("fp", F.col("doc_id").alias("who")), radius)
    return join_groups(rows, groups, "fp", "n", rows.count()).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with the smallest id, with all its columns."""
    fp, row, goes = fresh(df.columns, "fp", "row", "goes")
    marked = with_fingerprints(df, text_col, fp, shingle).withColumn(row, F.monotonically_increasing_id())
    rows = scratch.table(marked, "rows")
    # A row number settles ties between equal ids; null ids come after all others.
    who = F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), quoted(row).alias("row"))
    groups = _grouped(rows.select(quoted(fp).alias("fp"), who.alias("who")), radius)
    stay = groups.select(F.col("component.row").alias("stays")).distinct()
    gone = scratch.table(rows.select(quoted(row).alias(goes)).join(stay, quoted(goes) == F.col("stays"), "left_anti"), "gone")
    return without_rows(rows, row, gone).drop(fp, row)

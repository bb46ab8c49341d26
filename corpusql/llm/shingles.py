"""SimHash near copies at a Jaccard similarity of 0.8 or more of five-word shingles.

Every text is the set of its hashed shingles; texts with equal sets are merged
first. A set's SimHash has ``BITS`` bits, wide enough that similarity and
chance lie far apart: sets at similarity 0.8 differ in 48 bits at most on
average (39 beyond a few shingles), strangers in 128, and the radius lies some
five deviations from the one and more from the other; of pairs at 0.8 it misses
about one in 100,000, of more similar ones fewer. As in ``simhash``, fingerprints are cut into tiles, pairs
of tiles meet in one task and are compared block by block with exclusive-or
and bit counts. Tile pairs whose population counts differ beyond the radius
are skipped, and so are tiles and blocks whose numbers of shingles alone rule
similarity out, which leaves about one pair in ten. The work still grows with
the square of the number of distinct sets, as the method implies.

A tile pair's candidates are passed on as links to one representative per local
group, at most one per set, and joined into candidate components. Within such a
component the whole shingle sets are compared exactly: its members are cut into
parts of about ``PART`` shingles, and each pair of parts meets in one task, which
counts the shingles that a member shares with all others at once and links
those at ``SIMILARITY`` or more, again with at most one link per member. So no
list of pairs exists anywhere, however large a group of near copies is; a text
is copied once for each part of its component.

Defined results: null texts count as empty; texts without words are copies of
each other; a text of fewer than five words is one shingle; upper and lower
case A-Z are alike; of rows with equal ids and sets any one stays; null ids
come after all others; an empty table gives an empty result; very long texts
are cut to shingles whole; other columns, whatever their names and the case of
these, are passed on. Sets count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from corpusql.llm import scratch
from corpusql.llm.columns import fresh, join_groups, quoted, with_columns
from corpusql.llm.components import components
from corpusql.llm.row_marks import with_row_marks, without_rows
from corpusql.llm.simhash import merged

SHINGLE = 5
SIMILARITY = 0.8
BITS, RADIUS = 256, 66
FEW, FEW_RADIUS = 8, 80  # for sets of up to so many shingles, whose bits vary more
COARSE_RADIUS = 44  # of the first half of the bits, which is compared for all pairs
TILE = 1 << 15
BLOCK = 1 << 9
PART = 1 << 20
SIZE_STEPS = 4  # size classes to a factor of 1 / SIMILARITY
HEAVY = 16  # a shingle of one member in so many is counted in a dense table
SEED = 42

_WORDS = BITS // 64
_SALTS = np.random.default_rng(SEED).integers(0, 2**64, _WORDS, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n))


def wide_print(hashes: np.ndarray) -> bytes:
    """SimHash of a set of hashes: each bit is set if over half of its members' derived hashes set it."""
    set_by = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # a sum of so many bits fits a byte
        mixed = (hashes[at : at + 255, None] ^ _SALTS) * _FACTOR
        mixed ^= mixed >> np.uint64(31)
        mixed *= _FACTOR
        mixed ^= mixed >> np.uint64(29)
        set_by += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * set_by > len(hashes)).tobytes()


def with_prints(df: DataFrame, text_col: str, node: str, prints: str, size: str) -> DataFrame:
    """Add the hash of the shingle set, its fingerprint and its number of shingles, without a shuffle."""

    def measure(texts: pa.Array) -> list[pa.Array]:
        from xxhash import xxh64_intdigest

        ids, found, sizes = [], [], []
        for text in texts:
            own = shingles(text.as_py())
            ids.append(xxh64_intdigest(own.tobytes(), SEED))
            found.append(wide_print(own))
            sizes.append(len(own))
        return [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(found, pa.binary()), pa.array(sizes, pa.int64())]

    added = [StructField(node, LongType()), StructField(prints, BinaryType()), StructField(size, LongType())]
    return with_columns(df, text_col, added, lambda: measure)


def _too_far(low_a, high_a, low_b, high_b, similarity: float):
    """Whether no two sets with sizes within these bounds can be so similar."""
    return (high_a < similarity * low_b - 1e-9) | (high_b < similarity * low_a - 1e-9)


class _Side:
    """Members of one tile in order of size: fingerprint words, sizes and nodes."""

    def __init__(self, members: pa.StructArray):
        part = {f.name: members.field(f.name) for f in members.type}
        order = np.argsort(part["size"].to_numpy(), kind="stable")
        words = np.frombuffer(b"".join(part["prints"].to_pylist()), np.uint64).reshape(-1, _WORDS)
        self.words = np.ascontiguousarray(words[order].T)
        self.sizes, self.nodes = (part[name].to_numpy()[order] for name in ("size", "node"))


def candidate_links(a: _Side, b: _Side | None, similarity: float = SIMILARITY, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, representative) that join what may be similar in a pair of tiles, or in one tile."""
    own, b = b is None, a if b is None else b
    nodes, shift = (a.nodes, 0) if own else (np.concatenate([a.nodes, b.nodes]), len(a.nodes))
    label = np.arange(len(nodes))
    for i in range(0, len(a.nodes), block):
        rows = min(block, len(a.nodes) - i)
        for j in range(i if own else 0, len(b.nodes), block):
            end = min(j + block, len(b.nodes))
            if _too_far(a.sizes[i], a.sizes[i + rows - 1], b.sizes[j], b.sizes[end - 1], similarity):
                continue
            apart = np.bitwise_count(a.words[0, i : i + rows, None] ^ b.words[0, None, j:end])
            for w in range(1, _WORDS // 2):
                apart += np.bitwise_count(a.words[w, i : i + rows, None] ^ b.words[w, None, j:end])
            p, q = np.nonzero(apart <= COARSE_RADIUS)
            differ = label[p + i] != label[q + j + shift]
            p, q = p[differ], q[differ]
            if not len(p):
                continue
            small, large = np.minimum(a.sizes[p + i], b.sizes[q + j]), np.maximum(a.sizes[p + i], b.sizes[q + j])
            d = apart[p, q].astype(np.int64)
            for w in range(_WORDS // 2, _WORDS):
                d += np.bitwise_count(a.words[w, p + i] ^ b.words[w, q + j])
            near = (d <= np.where(small <= FEW, FEW_RADIUS, RADIUS)) & (small >= similarity * large - 1e-9)
            label = merged(label, p[near] + i, q[near] + j + shift)
    member = np.flatnonzero(label != np.arange(len(label)))
    return nodes[member], nodes[label[member]]


def exact_links(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, representative), numbered through ``a`` and then ``b``, that join all sets so similar in two parts, or in one."""
    right, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(a) + (0 if b is None else len(b)))
    n = len(right)
    sizes = np.array([len(x) for x in right], np.int64)
    known, place = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(place, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(known)))])
    often = np.flatnonzero(np.diff(first) * HEAVY > n)  # HEAVY times the mean size at most
    row = np.full(len(known), -1)
    row[often] = np.arange(len(often))
    table = np.zeros((len(often), n), np.uint8)
    for k, which in enumerate(often):
        table[k, owner[first[which] : first[which + 1]]] = 1
    for i, own in enumerate(a):
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        at = at[known[at] == own] if len(known) else at[:0]
        heavy = row[at]
        both = table[heavy[heavy >= 0]].sum(axis=0, dtype=np.int64)
        light = at[heavy < 0]
        counts = first[light + 1] - first[light]
        if len(light):
            runs = np.arange(counts.sum()) + np.repeat(first[light] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            both += np.bincount(owner[runs], minlength=n)
        # Rounded, as 4 of 5 is not quite 0.8 in binary.
        near = np.flatnonzero(both >= similarity * (sizes + len(own) - both) - 1e-9)
        label = merged(label, np.full(len(near), i), near + shift)
    member = np.flatnonzero(label != np.arange(len(label)))
    return member, label[member]


def _tile_plan(cells: list[tuple], tile: int) -> tuple[list[tuple], list[tuple]]:
    """Where each size class goes, and which groups of tiles meet; cells are (class, sets, least and largest bit count)."""
    where, groups, held = [], [], tile + 1
    for step, n, low, high in sorted(cells):
        if held + n > tile:
            groups.append([step, step, low, high, 1])
            held = 0
        held += n
        g = groups[-1]
        groups[-1] = [g[0], step, min(g[2], low), max(g[3], high), -(-held // tile)]
        where.append((step, len(groups) - 1))
    meet = [
        (i, j, b[4])
        for i, a in enumerate(groups)
        for j, b in enumerate(groups)
        if a[0] - SIZE_STEPS <= b[1] and b[0] - SIZE_STEPS <= a[1] and max(a[2] - b[3], b[2] - a[3]) <= FEW_RADIUS
    ]
    return [(step, g, groups[g][4]) for step, g in where], meet


def _size_class(size: Column) -> Column:
    """Sets of classes more than ``SIZE_STEPS`` apart differ in size by more than the similarity allows."""
    step = float(np.log(1 / SIMILARITY) / SIZE_STEPS)
    return F.when(size == 0, -2 * SIZE_STEPS).otherwise(F.floor(F.log(size.cast("double") + 1e-9) / step)).cast("int")


def candidates(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between nodes of the table (node, prints, size) that join all whose sets may be similar."""
    spark = nodes.sparkSession
    bits = nodes.withColumn("step", _size_class(F.col("size")))
    ones = F.length(F.regexp_replace(F.conv(F.hex(F.substring("prints", 1, 4)), 16, 2), "0", ""))
    for at in range(5, BITS // 8, 4):
        ones = ones + F.length(F.regexp_replace(F.conv(F.hex(F.substring("prints", at, 4)), 16, 2), "0", ""))
    counted = bits.groupBy("step").agg(F.count("*").alias("n"), F.min(ones).alias("low"), F.max(ones).alias("high"))
    where, meet = _tile_plan([tuple(r) for r in counted.collect()], tile)  # some hundred classes cover any size
    if not where:
        return spark.createDataFrame([], "a long, b long")
    placed = spark.createDataFrame(where, "step int, g int, tiles int")
    partners = spark.createDataFrame(meet, "g int, other int, others int")
    own, other = F.struct("g", "s"), F.struct(F.col("other").alias("g"), F.col("t").alias("s"))
    tiles = (
        bits.join(F.broadcast(placed), "step")  # a row for each class
        .withColumn("s", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .groupBy("g", "s")
        .agg(F.collect_list(F.struct("node", "prints", "size")).alias("members"))
    )
    pairs = (
        tiles.join(F.broadcast(partners), "g")  # classes by classes at most
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .select(F.least(own, other).alias("first"), F.greatest(own, other).alias("second"), "members")
    )

    def compare(group: pa.Table) -> pa.Table:
        sides = [_Side(m.values) for m in group.column("members")]
        member, representative = candidate_links(sides[0], sides[1] if len(sides) > 1 else None)
        return pa.table({"a": member, "b": representative})

    return pairs.groupBy("first", "second").applyInArrow(compare, "a long, b long")


def verified(members: DataFrame, texts: DataFrame, part: int = PART) -> DataFrame:
    """Links (a, b) between the members (node, root, size, row) of candidate components that join all who are similar."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / part).cast("int").alias("parts"))
    parted = join_groups(members, scratch.table(sizes, "sizes"), "root", "n", members.count()).select(
        "root", "node", "row", "parts", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("int").alias("part")
    )

    # Texts travel, not sets: they are smaller and compress.
    parted = scratch.table(parted, "parted")
    held = with_row_marks(texts, "row", parted.select("row"), "wanted").filter("wanted")
    wanted = held.join(parted, "row").select("root", "node", "parts", "part", "text")
    other = F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("other")
    pairs = wanted.select("root", "node", "part", "text", other).select(
        "root", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "node", "text"
    )

    def compare(group: pa.Table) -> pa.Table:
        part = group.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        nodes, held = group.column("node").to_numpy()[order], group.column("text")
        sets = [shingles(held[int(i)].as_py()) for i in order]
        cut = int(np.searchsorted(part[order], part[order][0], side="right"))
        member, representative = exact_links(sets[:cut], sets[cut:] if cut < len(sets) else None)
        return pa.table({"a": nodes[member], "b": nodes[representative]})

    return pairs.groupBy("root", "first", "second").applyInArrow(compare, "a long, b long")


def roots(nodes: DataFrame, texts: DataFrame, tile: int = TILE, part: int = PART) -> DataFrame:
    """(node, root) of the nodes that are linked to others; ``nodes`` is a table (node, prints, size, row), ``texts`` has row and text."""
    near = scratch.table(components(candidates(nodes, tile)), "candidates")
    members = scratch.table(near.join(nodes.select("node", "size", "row"), "node"), "members")
    return scratch.table(components(verified(members, texts, part)), "roots")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, part: int = PART) -> DataFrame:
    """The rows of ``df`` that stay: of each component of near copies the one with the smallest id, with all its columns."""
    node, prints, size, row, goes = fresh(df.columns, "node", "prints", "size", "row", "goes")
    rows = scratch.table(with_prints(df, text_col, node, prints, size).withColumn(row, F.monotonically_increasing_id()), "rows")
    # A row number settles ties between equal ids; null ids come after all others.
    who = F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), quoted(row).alias("row"))
    firsts = scratch.table(
        rows.groupBy(quoted(node).alias("node"))
        .agg(F.min(who).alias("who"), F.first(quoted(prints)).alias("prints"), F.first(quoted(size)).alias("size"))
        .withColumn("row", F.col("who.row")),
        "firsts",
    )
    texts = rows.select(quoted(row).alias("row"), quoted(text_col).alias("text"))
    linked = roots(firsts.select("node", "prints", "size", "row"), texts, tile, part)
    groups = firsts.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("who").alias("who"))
    stay = groups.select(F.col("who.row").alias("stays"))
    gone = scratch.table(rows.select(quoted(row).alias(goes)).join(stay, quoted(goes) == F.col("stays"), "left_anti"), "gone")
    return without_rows(rows, row, gone).drop(node, prints, size, row)

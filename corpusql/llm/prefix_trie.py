"""Prefix trie of conversations, for training on shared beginnings once.

``encode`` orders the turns of every conversation and gives each distinct
(role, text) a turn id. ``graft`` rebuilds conversations on the beginnings of
others. ``build`` makes the trie by MSD radix partitioning over turn ids: a
bucket is a node with the conversations that go on below it. In each round every bucket
that is still too large is dealt by its next ``digit_turns`` turns, in one
aggregation whose groups are the nodes between. A bucket of at most
``local_turns`` remaining turns is finished in one task by multikey quicksort,
which emits a node at each equal part; a bucket of one conversation needs no
sorting, its nodes are its rows. Sums over subtrees go from the last round back
to the first.

No group without a bound meets in a task: a hot turn, node or conversation is
counted in each task first and met by a broadcast of at most 1,024 hot groups
(``columns.join_groups``), places in a conversation come from the ranks of a
range sort, which may cut a conversation anywhere, and the ids of a node's ends
are rendered in pieces; only their SHA-256, which has no parallel form, reads
the pieces in order in one task, one by one.

There are about (length of the beginnings that more than ``local_turns`` turns
share) / ``digit_turns`` rounds.

Rows with a null conversation id belong to no conversation and take no part. Null roles and texts are
empty; turns are ordered nulls first, equal ones by a digest of role and text,
so repeated rows are repeated turns. An empty table has no node, not even a
root. Names of other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.columns import join_groups, quoted, text_or_empty
from corpusql.llm.scratch import table

#: A bucket of at most so many remaining turns is sorted in one task: some 20 MB there.
LOCAL_TURNS = 1 << 18
#: Turns of a digit: a round goes so many turns down.
DIGIT_TURNS = 8
#: Ids of a rendered piece of a node's ends.
PIECE_IDS = 1 << 11

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id long"


class Encoded(NamedTuple):
    """Conversations by turn ids."""

    turns: DataFrame  # conv, place from 1, turn_id, n_bytes of the text
    convs: DataFrame  # conv, length
    dictionary: DataFrame  # turn_id, digest, n_rows


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, in which none can be taken for part of the other."""
    role, text = text_or_empty(role), text_or_empty(text)
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def encode(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Encoded:
    """Turns with their places and dictionary-encoded ids.

    Places are ranks of a range sort by conversation and turn: a partition's
    rows are numbered where they are and begin after those that earlier
    partitions hold of the same conversation.
    """
    slim = conversations.select(
        quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), digest(quoted(role_col), quoted(text_col)).alias("digest"),
        F.octet_length(text_or_empty(quoted(text_col))).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    ).filter("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "row"]
    ordered = table(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33).alias("part")  # the partition's number stands above bit 33

    dictionary = table(ordered.groupBy("digest").agg(F.count("*").alias("n_rows")).select("digest", "n_rows", F.monotonically_increasing_id().alias("turn_id")), "dictionary")
    pieces = ordered.groupBy("conv", part).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv", "part", (F.col("first") - F.coalesce(F.sum("size").over(before), F.lit(0)) - 1).alias("zero"))
    known = join_groups(ordered, dictionary, "digest", "n_rows", ordered.count())
    turns = known.withColumn("part", part).join(starts, ["conv", "part"]).select("conv", (F.col("at") - F.col("zero")).alias("place"), "turn_id", "n_bytes")
    convs = pieces.groupBy("conv").agg(F.sum("size").alias("length"))
    return Encoded(table(turns, "turns"), table(convs, "convs"), dictionary)


def turn_texts(conversations: DataFrame, dictionary: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(turn_id, role, text) of a dictionary's turns."""
    role, text = text_or_empty(quoted(role_col)), text_or_empty(quoted(text_col))
    distinct = conversations.select(role.alias("role"), text.alias("text")).distinct()
    return distinct.withColumn("digest", digest(F.col("role"), F.col("text"))).join(dictionary, "digest").select("turn_id", "role", "text")


def graft(encoded: Encoded, base: Column, head: Column, most: int) -> Encoded:
    """Every conversation rebuilt on another: that one's first ``head`` turns, then its own after its first ``head``.

    ``base`` and ``head`` are expressions of ``conv``; a base that is absent
    gives no turn; ``head`` is never above ``most``.
    """
    plan = encoded.convs.withColumns({"base": base, "head": head.cast("long")})
    plan = plan.join(encoded.convs.select(F.col("conv").alias("base"), F.col("length").alias("has")), "base", "left")
    plan = table(plan.select("conv", "base", "head", "length", F.least("head", F.coalesce("has", F.lit(0))).alias("taken")), "grafts")
    starts = encoded.turns.filter(F.col("place") <= most).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "head"), "base").filter("place <= head")
    rests = join_groups(encoded.turns, plan, "conv", "length", encoded.turns.count()).filter("place > head")
    turns = starts.select("conv", "place", "turn_id", "n_bytes").union(rests.select("conv", F.col("taken") + F.col("place") - F.col("head"), "turn_id", "n_bytes"))
    convs = plan.select("conv", (F.col("taken") + F.greatest(F.col("length") - F.col("head"), F.lit(0))).alias("length"))
    return Encoded(table(turns, "grafted"), table(convs, "convs"), encoded.dictionary)


def _kind(going: Column, remaining: Column, local_turns: int) -> Column:
    """How a bucket goes on."""
    return F.when(going == 0, "end").when(going == 1, "single").when(remaining <= local_turns, "local").otherwise("split")


def _grow(depth: int, bucket: int, convs: list[int], runs: list[list[int]], sizes: list[list[int]]) -> list[list]:
    """The nodes below one bucket by multikey quicksort; the last row holds the sums of the bucket itself.

    ``convs`` ascend, and every part keeps their order, so the first of a part
    is its smallest and ends are rendered in order.
    """
    conv, level, above, count, own, ends, turn = [bucket], [depth], [0], [0], [0], [""], [None]
    stack = [(list(range(len(convs))), 0, 0)]
    while stack:
        part, at, parent = stack.pop()
        pivot = runs[part[len(part) // 2]][at]
        same = [m for m in part if runs[m][at] == pivot]
        if len(same) < len(part):
            for side in ([m for m in part if runs[m][at] < pivot], [m for m in part if runs[m][at] > pivot]):
                if side:
                    stack.append((side, at, parent))
        conv.append(convs[same[0]])
        level.append(depth + at + 1)
        above.append(parent)
        count.append(len(same))
        own.append((len(same) - 1) * sizes[same[0]][at])
        turn.append(pivot)
        ends.append(",".join(str(convs[m]) for m in same if len(runs[m]) == at + 1))
        if going := [m for m in same if len(runs[m]) > at + 1]:
            stack.append((going, at + 1, len(conv) - 1))
    children, leaves = [0] * len(conv), [0] * len(conv)
    for i in range(len(conv) - 1, 0, -1):  # a node stands after the one above it
        leaves[i] = leaves[i] or 1
        children[above[i]] += 1
        leaves[above[i]] += leaves[i]
        own[above[i]] += own[i]
    rows = [[conv[i], level[i], conv[above[i]], count[i], children[i], leaves[i], own[i], hashlib.sha256(ends[i].encode()).hexdigest(), turn[i]] for i in range(1, len(conv))]
    return [*rows, [bucket, depth, None, None, children[0], leaves[0], own[0], None, None]]


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of local buckets from rows sorted by depth, bucket, conversation and place."""
    schema = pa.schema([(name, pa.string() if name == "ends_sha256" else pa.int64()) for name in (x.split()[0] for x in _NODES.split(", "))])
    rows: list[list] = []
    bucket, convs, runs, sizes = None, [], [], []

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for depth, name, conv, turn, size in zip(*(batch.column(c).to_pylist() for c in ("depth", "bucket", "conv", "turn_id", "n_bytes")), strict=True):
            if (depth, name) != bucket:
                if bucket:
                    rows += _grow(*bucket, convs, runs, sizes)
                    if len(rows) > 20_000:
                        yield ready()
                bucket, convs, runs, sizes = (depth, name), [], [], []
            if not convs or convs[-1] != conv:
                convs.append(conv)
                runs.append([])
                sizes.append([])
            runs[-1].append(turn)
            sizes[-1].append(size)
    if bucket:
        rows += _grow(*bucket, convs, runs, sizes)
        yield ready()


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``PIECE_IDS`` comma-joined ids from rows sorted by depth, node and conversation."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, node, conv = (batch.column(c).to_numpy() for c in ("depth", "node", "conv"))
        new = np.flatnonzero((np.diff(depth) != 0) | (np.diff(node) != 0)) + 1
        cuts = sorted({*new.tolist(), *range(0, len(conv), PIECE_IDS)})
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(conv)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[cuts]), pa.array(node[cuts]), pa.array(conv[cuts]), pa.array(texts, pa.string())], names=["depth", "node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from pieces sorted by depth, node and first id, held one at a time."""
    key, state = None, None
    for batch in batches:
        depths, nodes, hashes = [], [], []
        for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
            if (depth, node) != key:
                if key:
                    depths.append(key[0]), nodes.append(key[1]), hashes.append(state.hexdigest())
                key, state = (depth, node), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(depths, pa.int64()), pa.array(nodes, pa.int64()), pa.array(hashes, pa.string())], names=["depth", "node", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["depth", "node", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, conv): the hash of a node's ids, ascending and joined by commas."""
    order = ["depth", "node", "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_rendered, "depth long, node long, first long, ids string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def build(encoded: Encoded, local_turns: int = LOCAL_TURNS, digit_turns: int = DIGIT_TURNS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id.

    ``saved_tokens`` sums, over a subtree, the bytes of each node's text once for every
    member but one. A node is known by its depth and conv_id.
    """
    convs, spark = encoded.convs, encoded.convs.sparkSession
    root, n_convs, n_turns, n_going = convs.agg(F.min("conv"), F.count("*"), F.sum("length"), F.count_if(F.col("length") > 0)).first()
    if not n_convs:
        return spark.createDataFrame([], _NODES)
    top_id = F.lit(root).cast("long")
    turns = table(encoded.turns.repartitionByRange("place", "conv"), "by_place")  # a round reads some places only

    members = convs.filter("length > 0").select("conv", "length", top_id.alias("bucket"), _kind(F.lit(n_going), F.lit(n_turns), local_turns).alias("kind"))
    finish, ends, rounds, depth = [], [convs.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), top_id.alias("node"), "conv")], [], 0
    while True:
        finish.append(members.filter("kind <> 'split'").withColumn("depth", F.lit(depth).cast("long")))
        split = members.filter("kind = 'split'").drop("kind")
        if split.isEmpty():
            break
        low = depth + digit_turns
        run = F.array_sort(F.collect_list(F.struct("place", "turn_id", "n_bytes")))  # at most digit_turns rows of a conversation
        block = turns.filter((F.col("place") > depth) & (F.col("place") <= low)).join(split, "conv").groupBy("conv", "bucket", "length").agg(run.alias("run"))
        block = table(block.select("conv", "bucket", "length", F.col("run.turn_id").alias("path"), F.col("run.n_bytes").alias("sizes")), f"digits_{depth}")
        steps = block.select("conv", "bucket", "path", F.posexplode("sizes").alias("k", "n_bytes"), (F.col("length") - depth - F.col("k") - 1).alias("rest"))
        nodes = steps.groupBy("bucket", F.slice("path", F.lit(1), F.col("k") + 1).alias("path")).agg(
            F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.sum("rest").alias("remaining"), F.count_if(F.col("rest") > 0).alias("going")
        )
        nodes = table(nodes.withColumn("kind", _kind(F.col("going"), F.col("remaining"), local_turns)), f"nodes_{depth}")
        placed = table(join_groups(block.drop("sizes"), nodes.select("bucket", "path", "node", "n_convs", "kind"), ["bucket", "path"], "n_convs", n_convs), f"placed_{depth}")
        ends.append(placed.filter(F.col("length") <= low).select(F.col("length").alias("depth"), "node", "conv"))
        members = placed.filter(F.col("length") > low).select("conv", "length", F.col("node").alias("bucket"), "kind")
        rounds.append((depth, nodes))
        depth = low

    last = finish[0]
    for more in finish[1:]:
        last = last.union(more)
    rest = join_groups(turns, table(last, "finish"), "conv", "length", n_turns).filter(F.col("place") > F.col("depth"))
    rest = table(rest.select("kind", "depth", "bucket", "conv", "length", "place", "turn_id", "n_bytes"), "rest")

    alone = rest.filter("kind = 'single'")
    ended = F.col("place") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = alone.select(
        F.col("conv").alias("conv_id"), F.col("place").alias("depth"), F.when(F.col("place") == F.col("depth") + 1, F.col("bucket")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(ended, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(ended, F.sha2(F.col("conv").cast("string"), 256)).otherwise(_NO_ENDS).alias("ends_sha256"), "turn_id",
    )
    order = ["depth", "bucket", "conv", "place"]
    local = table(rest.filter("kind = 'local'").select(*order, "turn_id", "n_bytes").repartition("depth", "bucket").sortWithinPartitions(*order).mapInArrow(_local_nodes, _NODES), "local")

    sums = local.filter("n_convs IS NULL").select("depth", F.col("conv_id").alias("node"), "n_children", "n_leaves", "saved_tokens")
    sums = sums.union(alone.filter("place = depth + 1").select("depth", F.col("bucket").alias("node"), one, one, none))
    parts = []
    for depth, nodes in reversed(rounds):
        below = sums.filter(F.col("depth") == depth + digit_turns).select("node", "n_children", F.col("n_leaves").alias("under"), F.col("saved_tokens").alias("spared"))
        full = nodes.join(below.withColumn("size", F.lit(digit_turns)), (nodes["node"] == below["node"]) & (F.size("path") == digit_turns), "left").drop(below["node"])
        leaves = F.when(F.col("going") == 0, 1).otherwise(F.coalesce("under", F.lit(0)))
        spared = (F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("spared", F.lit(0))
        full = full.select("bucket", "path", "node", "n_convs", "n_children", leaves.alias("leaves"), spared.alias("spared"), F.explode(F.sequence(F.lit(0), F.size("path"))).alias("k"))
        itself = F.col("k") == F.size("path")
        lifted = full.groupBy("bucket", F.slice("path", F.lit(1), F.col("k")).alias("path")).agg(
            F.max(F.when(itself, F.col("node"))).alias("node"), F.max(F.when(itself, F.col("n_convs"))).alias("n_convs"), F.max(F.when(itself, F.col("n_children"))).alias("under"),
            F.sum("leaves").alias("n_leaves"), F.sum("spared").alias("saved_tokens"), F.count_if(F.col("k") == F.size("path") - 1).alias("children"),
        )
        lifted = table(lifted.select("bucket", "path", "node", "n_convs", (F.col("children") + F.coalesce("under", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens"), f"sums_{depth}")
        sums = sums.union(lifted.filter("node IS NULL").select(F.lit(depth).cast("long"), "bucket", "n_children", "n_leaves", "saved_tokens"))
        found = lifted.filter("node IS NOT NULL").withColumn("up", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))))
        parents = lifted.filter("n_children > 0").select("bucket", F.col("path").alias("up"), F.coalesce("node", "bucket").alias("parent_conv_id"), F.col("n_children").alias("n_kids"))
        found = join_groups(found, parents, ["bucket", "up"], "n_kids", n_convs)
        parts.append(found.select(F.col("node").alias("conv_id"), (F.size("path") + depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.element_at("path", -1).alias("turn_id")))

    empty = F.lit(None).cast("long")
    top = sums.filter("depth = 0").agg(F.max("n_children").alias("n_children"), F.max("n_leaves").alias("n_leaves"), F.max("saved_tokens").alias("saved_tokens"))  # at most one row goes in
    upper = top.select(
        top_id.alias("conv_id"), none.alias("depth"), empty.alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"),
        F.coalesce("n_children", none).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"), empty.alias("turn_id"),
    )
    for part in parts:
        upper = upper.unionByName(part)
    ending = ends[0]
    for more in ends[1:]:
        ending = ending.union(more)
    hashes = ends_hashes(ending).withColumnRenamed("node", "conv_id")
    upper = upper.join(hashes, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    return upper.select(*chains.columns).union(chains).union(local.filter("n_convs IS NOT NULL"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are; ``turn_texts`` gives the texts of turn ids."""
    return build(encode(conversations, conv_col, turn_col, role_col, text_col))

"""A graph of entities as two tables, and searches and measures on it.

``vertices`` has name, entity_type, confidence and counts; ``relationships``
has src, dst, relation_type, confidence and seq; ``edges`` keeps the last
relationship of each (src, dst, relation_type). Steps along the graph are
joins on node names, reduced before each shuffle, so that a node with very
many neighbours costs one row per task in every aggregation and is split by
adaptive execution in every join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.functions.vectors import DIGITS
from corpusql.operators.nearest import nearest
from corpusql.storage import dealt, written

#: Edges up to which exact betweenness sends the whole graph to every task (16 bytes each).
BROADCAST_EDGES = 2_000_000
#: Arcs of a node up to which it is compared with others that may lead to the same nodes.
ALIKE_ARCS = 64

# Colours for drawing.
TYPE_COLOURS = {
    "PERSON": "#FF6B6B",
    "ORGANIZATION": "#4ECDC4",
    "TECHNOLOGY": "#45B7D1",
    "CONCEPT": "#96CEB4",
    "LOCATION": "#FFEAA7",
    "PRODUCT": "#DDA0DD",
}
RELATION_COLOURS = {
    "DEVELOPS": "#E74C3C",
    "USES": "#3498DB",
    "PART_OF": "#2ECC71",
    "RELATED_TO": "#95A5A6",
    "IMPROVES": "#F39C12",
    "ENABLES": "#9B59B6",
}
OTHER_TYPE, OTHER_RELATION = "#95A5A6", "#BDC3C7"


def build(entities: DataFrame, relations: DataFrame, last_wins: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, relationships, edges, chunk_entities) of merged entities and filtered relations of all documents.

    Entities of one name are one vertex: its type is the most frequent, its
    confidence the highest, its chunks those of all documents. With
    ``last_wins`` the last document's entity replaces the others. Relations
    with an end that is no vertex are left out.
    """
    order = F.struct("doc_id", "seq")
    own = entities.select("name", "entity_type", "confidence", "doc_id", "seq", "chunk_ids", "mentions")
    if last_wins:
        last = own.groupBy("name").agg(F.max_by(F.struct("entity_type", "confidence", "doc_id", "seq", "chunk_ids", "mentions"), order).alias("e"))
        own = last.select("name", "e.*")
    types = own.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    # The first type seen wins ties: ranks by count, then by the least place.
    typed = types.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "entity_type")).alias("t"))
    chunk_entities = own.select("name", F.explode("chunk_ids").alias("chunk_id")).distinct()
    spoken = own.select("name", F.explode("mentions").alias("mention")).distinct().groupBy("name").agg(F.count("*").alias("mention_count"))
    vertices = (
        own.groupBy("name")
        .agg(F.max("confidence").alias("confidence"))
        .join(typed.select("name", F.col("t.entity_type").alias("entity_type")), "name")
        .join(chunk_entities.groupBy("name").agg(F.count("*").alias("chunk_count")), "name", "left")
        .join(spoken, "name", "left")
    )
    relationships = valid(relations, vertices)
    return vertices, relationships, last_edges(relationships), chunk_entities


def valid(relationships: DataFrame, vertices: DataFrame) -> DataFrame:
    """Relationships whose ends both are vertices."""
    names = vertices.select("name")
    for end in ("src", "dst"):
        relationships = relationships.join(names.withColumnRenamed("name", end), end, "left_semi")
    return relationships


def last_edges(relationships: DataFrame) -> DataFrame:
    """One edge per (src, dst, relation_type): the last by (doc_id, seq), or by seq alone."""
    order = F.struct(*[c for c in ("doc_id", "seq") if c in relationships.columns])
    return relationships.groupBy("src", "dst", "relation_type").agg(F.max_by("confidence", order).alias("confidence"))


def query_entities(vertices: DataFrame, entity_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    found = vertices.filter(F.col("confidence") >= min_confidence)
    return (found.filter(F.col("entity_type") == entity_type) if entity_type else found).orderBy(F.col("confidence").desc(), "name")


def query_relationships(relationships: DataFrame, relation_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    found = relationships.filter(F.col("confidence") >= min_confidence)
    found = found.filter(F.col("relation_type") == relation_type) if relation_type else found
    return found.orderBy(F.col("confidence").desc(), "src", "dst", "relation_type")


def both_ways(edges: DataFrame, relation_types: list[str] | None = None) -> DataFrame:
    """Distinct (node, next) in either direction."""
    if relation_types is not None:
        edges = edges.filter(F.col("relation_type").isin(relation_types))
    return (
        edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
        .unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
        .distinct()
    )


def neighbours(origins: DataFrame, edges: DataFrame, depth: int = 2, relation_types: list[str] | None = None, keep_origin: bool = False) -> DataFrame:
    """(origin, node, distance) of nodes within ``depth`` steps of each name in column ``origin``.

    A node that was reached is not followed again. With ``keep_origin`` an
    origin that a walk of two or more steps leads back to is its own neighbour.
    """
    steps = both_ways(edges, relation_types)
    front = origins.select("origin").distinct().withColumn("node", F.col("origin"))
    seen = front.withColumn("distance", F.lit(0))
    for distance in range(1, depth + 1):
        reached = front.join(steps, "node").select("origin", F.col("next").alias("node")).distinct()
        front = reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("distance", F.lit(distance)))
    found = seen.filter("distance > 0")
    if keep_origin and depth >= 2:
        back = steps.filter("node <> next").select(F.col("node").alias("origin")).distinct()
        returns = origins.select("origin").distinct().join(back, "origin", "left_semi")
        found = found.unionByName(returns.select("origin", F.col("origin").alias("node"), F.lit(2).alias("distance")))
    return found


def paths(pairs: DataFrame, edges: DataFrame, max_length: int = 3) -> DataFrame:
    """(source, target, path, length): all simple paths within ``max_length`` steps, directions ignored, each once."""
    steps = both_ways(edges).filter("node <> next")
    open_ = pairs.select("source", "target").distinct().filter("source <> target").withColumn("path", F.array("source"))
    open_ = open_.withColumn("node", F.col("source"))
    found = None
    for length in range(1, max_length + 1):
        longer = (
            open_.join(steps, "node")
            .filter(~F.array_contains("path", F.col("next")))
            .select("source", "target", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("node"))
        )
        there = longer.filter(F.col("node") == F.col("target")).select("source", "target", "path", F.lit(length).alias("length"))
        found = there if found is None else found.unionByName(there)
        open_ = longer.filter(F.col("node") != F.col("target"))
    return found


def step_relations(relationships: DataFrame) -> DataFrame:
    """For each unordered pair its first relationship: (lo, hi, relation_type, confidence, src)."""
    order = F.struct(*[c for c in ("doc_id", "seq") if c in relationships.columns])
    return (
        relationships.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .agg(F.min_by(F.struct("relation_type", "confidence", "src"), order).alias("r"))
        .select("lo", "hi", "r.*")
    )


def connection_paths(pairs: DataFrame, edges: DataFrame, relationships: DataFrame, max_length: int = 3) -> DataFrame:
    """One row per step of each path: source, target, path, length, step, relation_type, confidence, direction."""
    found = paths(pairs, edges, max_length)
    steps = found.select("source", "target", "path", "length", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("step"))
    ends = steps.withColumn("a", F.element_at("path", F.col("step"))).withColumn("b", F.element_at("path", F.col("step") + 1))
    known = step_relations(relationships)
    return ends.join(known, (F.least("a", "b") == known["lo"]) & (F.greatest("a", "b") == known["hi"]), "left").select(
        "source", "target", "path", "length", "step", "relation_type", "confidence",
        F.when(F.col("src") == F.col("a"), "forward").when(F.col("src").isNotNull(), "reverse").alias("direction"),
    )


def shortest_paths(origins: DataFrame, edges: DataFrame, relationships: DataFrame, max_length: int = 3) -> DataFrame:
    """(origin, node, length, mean_confidence) of one shortest path to every node within reach.

    Of several the one least in order of names, seen from the origin. Only one
    path per origin and node is kept at each step, so nothing grows with the
    number of paths; and of it only its place among the paths of its length, as
    paths to one node differ before their last step.
    """
    known = step_relations(relationships)
    steps = written(
        both_ways(edges)
        .filter("node <> next")
        .join(known.select("lo", "hi", "confidence"), (F.least("node", "next") == F.col("lo")) & (F.greatest("node", "next") == F.col("hi")))
        .select("node", "next", "confidence")
    )
    front = origins.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("total"), F.lit(0).alias("place"))
    seen = front.select("origin", "node", "total", F.lit(0).alias("length"))
    for length in range(1, max_length + 1):
        reached = (
            front.join(steps, "node")
            .groupBy("origin", F.col("next").alias("node"))
            .agg(F.min("place").alias("before"), F.min_by(F.col("total") + F.col("confidence"), "place").alias("total"))
        )
        front = reached.join(seen.select("origin", "node"), ["origin", "node"], "left_anti")
        if length < max_length:
            order = F.struct("origin", "before", "node")
            front = written(_numbered(front.select("origin", "node", "total", order.alias("order")), "order", "place").drop("order"))
        seen = seen.unionByName(front.select("origin", "node", "total", F.lit(length).alias("length")))
    return seen.select("origin", "node", "length", F.coalesce(F.try_divide("total", "length"), F.lit(1.0)).alias("mean_confidence"))


def subgraph(names: DataFrame, edges: DataFrame, include_neighbours: bool = True) -> DataFrame:
    """Edges among the given names and, unless told otherwise, the nodes their edges lead to."""
    chosen = names.select("name").distinct()
    if include_neighbours:
        nexts = edges.join(chosen, edges["src"] == chosen["name"], "left_semi").select(F.col("dst").alias("name"))
        chosen = chosen.unionByName(nexts).distinct()
    for end in ("src", "dst"):
        edges = edges.join(chosen.withColumnRenamed("name", end), end, "left_semi")
    return edges


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree, degree_centrality): ends of edges at each vertex, loops twice, over the number of others."""
    ends = edges.select(F.col("src").alias("name")).unionAll(edges.select(F.col("dst").alias("name")))
    counted = vertices.select("name").join(dealt(ends.groupBy("name").agg(F.count("*").alias("n"))), "name", "left")
    total = vertices.agg((F.count("*") - 1).alias("others"))
    return counted.crossJoin(F.broadcast(total)).select(  # one row
        "name", F.coalesce("n", F.lit(0)).alias("degree"), (F.coalesce("n", F.lit(0)) / F.greatest("others", F.lit(1))).alias("degree_centrality")
    )


class _Shares:
    """Each node's share of the shortest paths from one source after another; touches only what a source reaches.

    ``kind`` names each node's class: a source counts for all nodes of its class, whose arcs lead to the same nodes.
    With ``merged`` all classes are walked from, and a walk from a class counts for those that stand before it too: nodes whose
    only arc leads to a node of it have its shortest paths, one step longer.
    """

    def __init__(self, heads: np.ndarray, tails: np.ndarray, kind: np.ndarray, merged: bool = False):
        n = len(kind)
        order = np.argsort(heads, kind="stable")
        # Places are of the type that numpy indexes by; anything else is copied at each use.
        self.tails = tails[order].astype(np.intp)
        self.first = np.searchsorted(heads[order], np.arange(n + 1)).astype(np.intp)
        self.count, self.numbers = np.diff(self.first), np.arange(max(n, len(tails)), dtype=np.intp)
        self.by_kind = np.argsort(kind, kind="stable")
        self.kind_first = np.searchsorted(kind[self.by_kind], np.arange(n + 1))
        self.unseen, self.mark = np.ones(n, bool), np.zeros(n, np.intp)
        self.ways, self.part, self.less = np.zeros(n), np.zeros(n), np.zeros(n)
        self.total, self.squares = np.zeros(n), np.zeros(n)
        self.before: dict[int, list[int]] = {}
        one = np.flatnonzero((self.count == 1) & (kind == np.arange(n))) if merged else np.zeros(0, np.intp)
        after = self.tails[self.first[one]]
        fits = self.count[after] > 1  # else that class may itself be counted by another's walk
        for source, host in zip(one[fits].tolist(), kind[after[fits]].tolist(), strict=True):
            self.before.setdefault(host, []).append(source)
        self.counted = frozenset(one[fits].tolist())

    def _members(self, source: int) -> np.ndarray:
        return self.by_kind[self.kind_first[source] : self.kind_first[source + 1]]

    def add(self, source: int, size: int = 1) -> None:
        if source in self.counted:
            return
        numbers = self.numbers
        # The walk begins at a place of its own that has the source's arcs, so nodes of its class can be reached. They lead
        # nowhere new, and each of them is an end for all others of the class.
        front, ways = np.array([source], np.intp), np.ones(1)
        levels = []
        while True:
            counts = self.count.take(front)
            ends = counts.cumsum()
            if not ends[-1]:
                break
            # The arcs of each node of the front stand together: their places are runs.
            whose = numbers[: len(front)].repeat(counts)
            place = (self.first.take(front) - ends + counts).take(whose)
            place += numbers[: ends[-1]]
            tails = self.tails.take(place)
            new = self.unseen.take(tails).nonzero()[0]
            if not len(new):
                break
            tails, whose = tails.take(new), whose.take(new)
            np.add.at(self.ways, tails, ways.take(whose))
            here = numbers[: len(tails)]
            self.mark[tails] = here  # each node keeps one of its places, so it is followed once
            reached = tails.compress(self.mark.take(tails) == here)
            self.unseen[reached] = False
            levels.append((whose, tails, ways, reached))
            front, ways = reached, self.ways.take(reached)
        groups = [(int(self.tails[self.first[s]]), self._members(s)) for s in self.before.get(source, ())]
        own = self._members(source)
        self.less[own] += 1
        for host, members in groups:
            self.less[members] += 1
            self.less[host] += len(members)
        whole = size + sum(len(members) for _, members in groups)
        found = sum(len(level[-1]) for level in levels)
        for host, members in groups:  # all paths of these nodes but the ones that end there go through it
            self.total[host] += len(members) * (found - (not self.unseen[host])) - np.count_nonzero(~self.unseen[members])
        share = None
        for whose, tails, before, nodes in reversed(levels):
            ends = whole - self.less.take(nodes)
            if share is not None:
                self.total[nodes] += share
                self.squares[nodes] += share * share
                ends += share
            # Summed by arcs, a node's part is what stands beyond it for each way to it.
            self.part[nodes] = ends / ways
            share = np.bincount(whose, weights=self.part.take(tails), minlength=len(before)) * before
            self.ways[nodes], self.unseen[nodes] = 0, True
            ways = before
        self.less[own] = 0
        for host, members in groups:
            self.less[members] = self.less[host] = 0


def _numbered_arcs(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, node) of all vertices and (s, t) of the distinct arcs between them, loops left out."""
    names = written(_numbered(vertices.select("name").distinct(), "name", "node"))
    arcs = edges.filter("src <> dst").select("src", "dst").distinct()
    for end, short in (("src", "s"), ("dst", "t")):
        arcs = arcs.join(dealt(names.select(F.col("name").alias(end), F.col("node").alias(short))), end)
    return names, written(arcs.select("s", "t"))


def _alike(arcs: DataFrame) -> DataFrame:
    """(source, size, v): nodes v that begin an arc, in classes named by their least node, whose arcs lead to the same nodes.

    A node with more than ``ALIKE_ARCS`` arcs is a class of its own, so no list of nodes is long.
    """
    heads = written(arcs.groupBy("s").agg(F.count("*").alias("k")))
    few = arcs.join(dealt(heads.filter(F.col("k") <= ALIKE_ARCS).select("s")), "s", "left_semi")
    lists = written(few.groupBy("s").agg(F.array_sort(F.collect_list("t")).alias("to")))
    classes = lists.groupBy("to").agg(F.min("s").alias("source"), F.count("*").cast("int").alias("size"))
    alike = lists.join(dealt(classes), "to").select("source", "size", F.col("s").alias("v"))
    alone = heads.filter(F.col("k") > ALIKE_ARCS).select(F.col("s").alias("source"), F.lit(1).alias("size"), F.col("s").alias("v"))
    return written(alike.unionByName(alone))


def _alone(sources: DataFrame) -> DataFrame:
    """The same columns of sources (node) that count for themselves only."""
    return sources.select(F.col("node").alias("source"), F.lit(1).alias("size"), F.col("node").alias("v"))


def _shares(names: DataFrame, arcs: DataFrame, n: int, classes: DataFrame) -> DataFrame:
    """(node, share, squares): sums, over the sources of classes (source, size, v), of each node's share of the shortest paths from all nodes of a class, and of its square.

    Each task takes some classes and adds up; where they are all there are, fewer walks do. The arcs, two numbers each, go to every task
    where there are at most ``BROADCAST_EDGES``; beyond that the same sums are made by joins, level by level.
    """
    held = arcs.limit(BROADCAST_EDGES + 1).toArrow()
    if held.num_rows > BROADCAST_EDGES:
        return _shares_by_joins(arcs, classes)
    spark = names.sparkSession
    kind = np.arange(n, dtype=np.int32)
    shared_kind = classes.filter("size > 1").select("source", "v").toArrow()  # not more rows than arcs
    kind[shared_kind.column("v").to_numpy()] = shared_kind.column("source").to_numpy()
    merged = classes.count() == len(np.unique(held.column("s").to_numpy()))
    shared = spark.sparkContext.broadcast((held.column("s").to_numpy().astype(np.int64), held.column("t").to_numpy().astype(np.int64), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = _Shares(*shared.value, merged)
        for batch in batches:
            for source, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shares.add(source, size)
        where = np.flatnonzero(shares.total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(shares.total[where]), pa.array(shares.squares[where])], ["node", "share", "squares"])

    tasks = max(1, min(math.ceil(n / 64), 4 * spark.sparkContext.defaultParallelism))
    sources = classes.filter("source = v").select("source", "size")
    return sources.repartition(tasks).mapInArrow(run, "node long, share double, squares double").groupBy("node").agg(F.sum("share").alias("share"), F.sum("squares").alias("squares"))


def _shares_by_joins(arcs: DataFrame, classes: DataFrame) -> DataFrame:
    """The same by joins on (source, node), one written table per level; ``ends`` is for how many sources a node ends a path."""
    own = classes.filter("size > 1 OR source = v").select("source", "v", F.lit(1).alias("own"))

    def told(level: DataFrame) -> DataFrame:
        return written(level.join(dealt(own), ["source", "v"], "left").select("source", "size", "v", "ways", (F.col("size") - F.coalesce("own", F.lit(0))).alias("ends")))

    begins = classes.filter("source = v").select("source", "size")
    levels = [told(begins.join(dealt(arcs), F.col("source") == F.col("s")).select("source", "size", F.col("t").alias("v"), F.lit(1.0).alias("ways")))]
    seen = levels[0].select("source", "v")
    while True:
        reached = levels[-1].join(dealt(arcs), F.col("v") == F.col("s")).groupBy("source", "size", F.col("t").alias("v")).agg(F.sum("ways").alias("ways"))
        level = told(reached.join(dealt(seen), ["source", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "v"))
    total, below = None, None
    for level in reversed(levels):
        if below is None:
            shares = level.withColumn("share", F.lit(0.0))
        else:
            up = (
                level.join(dealt(arcs), F.col("v") == F.col("s"))
                .join(dealt(below).select("source", F.col("v").alias("t"), F.col("ways").alias("ways_below"), (F.col("ends") + F.col("share")).alias("share_below")), ["source", "t"])
                .groupBy("source", "v")
                .agg(F.sum(F.col("ways") / F.col("ways_below") * F.col("share_below")).alias("share"))
            )
            shares = level.join(dealt(up), ["source", "v"], "left").fillna(0.0, ["share"])
        below = written(shares)
        some = below.filter("share > 0").select("v", "share")
        total = some if total is None else total.unionByName(some)
    return total.groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("share"), F.sum(F.col("share") * F.col("share")).alias("squares"))


def betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, betweenness): exact, directed, normalised by (n - 1)(n - 2).

    Nodes whose arcs lead to the same nodes have the same shortest paths but for their ends, so one walk counts for
    all of them, and for nodes whose only arc leads to one of them; it costs such classes times the edges each can reach.
    """
    names, arcs = _numbered_arcs(vertices, edges)
    n = names.count()
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    found = _shares(names, arcs, n, _alike(arcs))
    return names.join(dealt(found), "node", "left").select("name", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_sampled(vertices: DataFrame, edges: DataFrame, error: float = 0.01, failure: float = 0.05, first: int = 256, seed: int = 0) -> DataFrame:
    """(name, betweenness, error, sources): an unbiased estimate from a sample of sources, and how far it may be off.

    Sources are taken in the order of a hash, without repetition, ``first`` of
    them and then twice as many each time, until the bound of every vertex is
    at most ``error``, or all are taken and the values are exact. With probability
    1 - ``failure`` all true values lie within their vertex's ``error``: the empirical Bernstein bound
    of a mean of values in [0, 1], over all vertices and rounds. What that needs does not
    grow with the graph but by its logarithm, so the cost is that of so many walks along all edges.
    """
    names, arcs = _numbered_arcs(vertices, edges)
    n = names.count()
    out = written(_numbered(arcs.select(F.col("s").alias("node")).distinct().withColumn("drawn", F.xxhash64(F.lit(seed), "node")).select(F.struct("drawn", "node").alias("drawn")), "drawn", "place"))
    total = out.count()
    if n < 3 or not total:
        return names.select("name", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"), F.lit(total).cast("long").alias("sources"))
    rounds = 1 + max(0, math.ceil(math.log2(total / first)))
    doubt = math.log(3 * n * rounds / failure)
    taken, parts = 0, None
    while True:
        goal = min(total, max(first, 2 * taken))
        new = written(_shares(names, arcs, n, _alone(out.filter((F.col("place") >= taken) & (F.col("place") < goal)).select("drawn.node"))))
        parts, taken = new if parts is None else parts.unionByName(new), goal
        sums = parts.groupBy("node").agg(F.sum("share").alias("share"), F.sum("squares").alias("squares"))
        mean, square = F.col("share") / taken / (n - 2), F.col("squares") / taken / (n - 2) ** 2
        spread = F.sqrt(2 * F.greatest(square - mean * mean, F.lit(0.0)) * doubt / taken) + 3 * doubt / taken
        scale = total / (n - 1)  # other vertices begin no path
        told = sums.select("node", (mean * scale).alias("betweenness"), (F.lit(0.0) if taken == total else spread * scale).alias("error"))
        unseen = 0.0 if taken == total else 3 * doubt / taken * scale  # the bound of a vertex no sampled path went through
        if max(told.agg(F.max("error")).first()[0] or 0.0, unseen) <= error:
            break
    return names.join(dealt(told), "node", "left").select("name", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("error", F.lit(unseen)).alias("error"), F.lit(taken).cast("long").alias("sources"))


def importance(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, importance): 0.6 degree and 0.4 betweenness centrality, times the entity's confidence."""
    return (
        vertices.select("name", "confidence")
        .join(dealt(degrees(vertices, edges)), "name")
        .join(dealt(betweenness(vertices, edges)), "name")
        .select("name", F.round((0.6 * F.col("degree_centrality") + 0.4 * F.col("betweenness")) * F.col("confidence"), DIGITS).alias("importance"))
    )


def related(origins: DataFrame, edges: DataFrame, important: DataFrame, depth: int = 2, relation_types: list[str] | None = None) -> DataFrame:
    """(origin, node, importance) of neighbours; sort by falling importance, then name."""
    near = neighbours(origins, edges, depth, relation_types)
    return near.join(important.withColumnRenamed("name", "node"), "node").select("origin", "node", "importance")


def entity_context(names: DataFrame, vertices: DataFrame, edges: DataFrame, relationships: DataFrame, important: DataFrame) -> DataFrame:
    """One row per name: its entity, importance, ten related entities, and relationships in and out."""
    own = names.select("name").distinct()
    order = Window.partitionBy("origin").orderBy(F.col("importance").desc(), "node")
    near = related(own.select(F.col("name").alias("origin")), edges, important)
    top = (
        near.withColumn("place", F.row_number().over(order))
        .filter("place <= 10")
        .groupBy(F.col("origin").alias("name"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node", "importance"))), lambda x: F.struct(x["node"].alias("node"), x["importance"].alias("importance"))).alias("related"))
    )
    # A loop counts as incoming only.
    incoming = relationships.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("incoming"))
    outgoing = relationships.filter("src <> dst").groupBy(F.col("src").alias("name")).agg(F.count("*").alias("outgoing"))
    whole = own.join(vertices, "name").join(important, "name").join(top, "name", "left").join(incoming, "name", "left").join(outgoing, "name", "left")
    return whole.fillna(0, ["incoming", "outgoing"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the least name that any path leads to, directions ignored.

    Names take the least label among their neighbours, and then their label's
    label, until nothing changes.
    """
    steps = written(both_ways(edges).filter("node <> next"))
    labels = written(vertices.select("name", F.col("name").alias("component")))
    while True:
        least = (
            steps.join(labels.withColumnRenamed("name", "next"), "next")
            .groupBy(F.col("node").alias("name"))
            .agg(F.min("component").alias("offered"))
        )
        lower = labels.join(least, "name", "left").select("name", F.least("component", F.coalesce("offered", "component")).alias("component"))
        jumped = lower.join(
            lower.select(F.col("name").alias("component"), F.col("component").alias("further")), "component", "left"
        ).select("name", F.coalesce("further", "component").alias("component"))
        new = written(jumped)
        changed = new.join(labels.withColumnRenamed("component", "old"), "name").filter("component <> old")
        labels = new
        if changed.isEmpty():
            return labels


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, clustering): linked pairs among the neighbours of each vertex, directions and parallel edges ignored.

    Every triangle is found once, from its two edges at the end of least
    degree, so a node with very many neighbours does not pair them all.
    """
    steps = both_ways(edges).filter("node <> next")
    degree = steps.groupBy(F.col("node").alias("name")).agg(F.count("*").alias("k"))
    rank = lambda end: F.struct(F.col(f"{end}_k"), F.col(end))
    ranked = (
        steps.join(degree.select(F.col("name").alias("node"), F.col("k").alias("node_k")), "node")
        .join(degree.select(F.col("name").alias("next"), F.col("k").alias("next_k")), "next")
        .filter(rank("node") < rank("next"))
    )
    one = ranked.select(F.col("node").alias("a"), F.col("next").alias("b"), F.col("next_k").alias("b_k"))
    two = ranked.select(F.col("node").alias("a"), F.col("next").alias("c"), F.col("next_k").alias("c_k"))
    third = ranked.select(F.col("node").alias("b"), F.col("next").alias("c"))
    triangles = one.join(two, "a").filter(rank("b") < rank("c")).join(third, ["b", "c"])
    counts = triangles.select(F.explode(F.array("a", "b", "c")).alias("name")).groupBy("name").agg(F.count("*").alias("t"))
    share = F.coalesce(F.try_divide(2 * F.col("t"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
    return vertices.select("name").join(degree, "name", "left").join(counts, "name", "left").select("name", F.round(share, DIGITS).alias("clustering"))


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, connected_components, avg_degree, density and clustering_coefficient."""
    n = vertices.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    parts = components(vertices, edges).agg(F.countDistinct("component").alias("connected_components"))
    mean = clustering(vertices, edges).agg(F.round(F.coalesce(F.avg("clustering"), F.lit(0.0)), DIGITS).alias("clustering_coefficient"))
    whole = n.crossJoin(m).crossJoin(parts).crossJoin(mean)  # one row each
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), DIGITS)
    return whole.select(
        "nodes", "edges", "connected_components",
        ratio(2 * F.col("edges"), F.col("nodes")).alias("avg_degree"),
        ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"),
        "clustering_coefficient",
    )


def type_counts(vertices: DataFrame, relationships: DataFrame) -> DataFrame:
    """(kind, type, n, avg_confidence) over entities and relationships."""
    rows = vertices.select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"), "confidence").unionAll(
        relationships.select(F.lit("relationship"), "relation_type", "confidence")
    )
    return rows.groupBy("kind", "type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), DIGITS).alias("avg_confidence"))


def _numbered(values: DataFrame, column: str, into: str) -> DataFrame:
    """Rows in order of a column without repeats, numbered from 0: ranges are counted first, so no task sorts all of them."""
    ranges = written(values.repartitionByRange(column).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1
    return ranges.join(F.broadcast(counts.select("range", before.alias("before"))), "range").withColumn(into, (F.col("before") + place).cast("int")).drop("range", "before")


def weighted_arcs(edges: DataFrame) -> DataFrame:
    """(node, next, w): edges between two nodes in both directions, as many as there are; a loop counts 2."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionAll(edges.select("dst", "src"))
    return ends.groupBy("node", "next").agg(F.count("*").cast("double").alias("w"))


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (communities, modularity) of (name, community): the share of edges within communities, less what chance would give.

    Vertices without an edge count as communities only.
    """
    arcs = weighted_arcs(edges)
    own = members.select(F.col("name").alias("node"), F.col("community").alias("a"))
    labelled = arcs.join(dealt(own), "node").join(dealt(own.select(F.col("node").alias("next"), F.col("a").alias("b"))), "next")
    parts = labelled.groupBy("a").agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"))
    sums = parts.agg(F.sum("degree").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    value = F.coalesce(F.try_divide("inner", "m2") - F.try_divide("squares", F.col("m2") * F.col("m2")), F.lit(0.0))
    count = members.agg(F.countDistinct("community").alias("communities"))
    return count.join(sums.select(F.round(value, DIGITS).alias("modularity")), F.lit(True))  # one row each


#: A gain of modularity below this is none; so many rounds without a gain end a level.
LEAST_GAIN, PATIENCE = 1e-6, 2


def _moved(arcs: DataFrame, m2: float) -> tuple[DataFrame, float]:
    """(node, label) with the highest modularity that rounds of moves from one community per node reach, and that modularity.

    In a round every node looks for the neighbouring community to which moving
    gains most, by the weights into it and its sum of degrees; about half of the nodes,
    chosen by a hash of node and round, go there. Equal gains go to the least label.
    """
    state = written(arcs.groupBy("node").agg(F.sum("w").alias("k")).withColumn("label", F.col("node")))
    loops = arcs.filter("node = next").agg(F.sum("w")).first()[0] or 0.0
    others = written(arcs.filter("node <> next"))
    best, most, stale, turn = state, -1.0, 0, 0
    while True:
        own = state.select("node", "k", F.col("label").alias("own"))
        totals = state.groupBy("label").agg(F.sum("k").alias("total"))
        into = others.join(dealt(state.select(F.col("node").alias("next"), "label")), "next").groupBy("node", "label").agg(F.sum("w").alias("w"))
        votes = written(into.join(dealt(own), "node"))
        inner = votes.filter("label = own").agg(F.sum("w")).first()[0] or 0.0
        now = (inner + loops) / m2 - (totals.agg(F.sum(F.col("total") * F.col("total"))).first()[0] or 0.0) / m2 / m2
        if now > most + LEAST_GAIN:
            best, most, stale = state, now, 0
        elif (stale := stale + 1) >= PATIENCE:
            break
        stays = F.col("label") == F.col("own")
        gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)) / m2, 9)
        ranked = votes.join(dealt(totals), "label").groupBy("node").agg(
            F.min(F.struct((-gain).alias("minus"), F.when(stays, 0).otherwise(1).alias("moves"), "label")).alias("to"), F.max(F.when(stays, gain)).alias("stay")
        )
        alone = F.round(-F.col("k") * (F.col("total") - F.col("k")) / m2, 9)  # to stay without a neighbour in one's community
        goes = F.coalesce(-F.col("to.minus") > F.coalesce("stay", alone), F.lit(False))
        wishes = written(state.join(dealt(ranked), "node", "left").join(dealt(totals), "label").select("node", "k", "label", F.when(goes, F.col("to.label")).alias("wish")))
        wishing = wishes.filter("wish IS NOT NULL").select("node")
        if wishing.isEmpty():
            break
        half = lambda: F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == 0  # noqa: B023, E731
        while wishing.filter(half()).isEmpty():  # a round in which none of them may move is none
            turn += 1
        state = written(wishes.select("node", "k", F.when(half(), F.coalesce("wish", "label")).otherwise(F.col("label")).alias("label")))
        turn += 1
    return best.select("node", "label"), most


def louvain(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, community) by modularity: nodes move between communities, these become the nodes of a smaller weighted graph, and so on.

    Directions are ignored and edges between two nodes counted. It ends when a
    level gains nothing. Numbers follow the least name of a community; a vertex
    without an edge is its own.
    """
    names = written(_numbered(vertices.select("name").distinct(), "name", "node"))
    ids = lambda end: names.select(F.col("name").alias(end), F.col("node").alias(f"{end}_id"))
    arcs = weighted_arcs(edges).join(dealt(ids("node")), "node").join(dealt(ids("next")), "next").select(F.col("node_id").alias("node"), F.col("next_id").alias("next"), "w")
    arcs = written(arcs)
    members = names.withColumn("label", F.col("node"))
    m2, reached = arcs.agg(F.sum("w")).first()[0] or 0.0, -1.0
    while m2:
        labels, now = _moved(arcs, m2)
        if now <= reached + LEAST_GAIN:
            break
        reached = now
        up = labels.select("node", F.col("label").alias("up"))
        members = written(members.join(dealt(up), members["label"] == up["node"], "left").select("name", members["node"], F.coalesce("up", "label").alias("label")))
        there = up.select(F.col("node").alias("next"), F.col("up").alias("next_up"))
        arcs = written(arcs.join(dealt(up), "node").join(dealt(there), "next").groupBy(F.col("up").alias("node"), F.col("next_up").alias("next")).agg(F.sum("w").alias("w")))
    first = members.groupBy("label").agg(F.min("node").alias("first"))
    return members.join(dealt(first.join(dealt(_numbered(first.select("first"), "first", "community")), "first")), "label").select("name", "community")


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(name, community): label propagation on the undirected simple graph, then gaps in numbering closed.

    In each round about half of the vertices, chosen by a hash of name and
    round, take the label most of their neighbours have; a vertex whose own
    label is among the most frequent keeps it, else the least of them counts.
    It ends when no vertex would change, or after ``rounds`` if these are given.
    """
    steps = written(both_ways(edges).filter("node <> next"))
    labels = written(vertices.select("name", F.col("name").alias("label")))
    for turn in itertools.count() if rounds is None else range(rounds):
        votes = steps.join(labels.withColumnRenamed("name", "next"), "next").groupBy("node", "label").agg(F.count("*").alias("n"))
        own = labels.select(F.col("name").alias("node"), F.col("label").alias("own"))
        other = F.when(F.col("label") == F.col("own"), 0).otherwise(1)
        won = votes.join(own, "node").groupBy(F.col("node").alias("name")).agg(F.min(F.struct((-F.col("n")).alias("n"), other.alias("other"), "label")).alias("w"))
        moves = F.pmod(F.xxhash64(F.lit(turn), "name"), F.lit(2)) == 0
        wish = F.coalesce("w.label", "label")
        new = written(
            labels.join(won, "name", "left").select("name", F.when(moves, wish).otherwise(F.col("label")).alias("label"), (wish != F.col("label")).alias("restless"))
        )
        labels = new.select("name", "label")
        if new.filter("restless").isEmpty():
            break
    return labels.join(_numbered(labels.select("label").distinct(), "label", "community"), "label").select("name", "community")


def communities(vertices: DataFrame, edges: DataFrame, algorithm: str = "louvain", rounds: int | None = None) -> DataFrame:
    """(name, community) by 'louvain' or 'label_propagation' (at most ``rounds``); no rows for another algorithm, or fewer than two vertices."""
    ways = {"louvain": lambda: louvain(vertices, edges), "label_propagation": lambda: label_propagation(vertices, edges, rounds)}
    if algorithm not in ways or vertices.limit(2).count() < 2:
        return vertices.limit(0).select("name", F.lit(0).alias("community"))
    return ways[algorithm]()


#: Characters of a key in the index of names: a form is found by its beginning, then checked as a whole.
KEY_LENGTH = 8


def _keyed_names(vertices: DataFrame, mentions: DataFrame) -> DataFrame:
    """(key, name, parts): what a query must contain for a name to count, under the beginning of its longest part.

    A name of several words counts where all its words occur, any other form where it occurs whole.
    """
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != "")
    own = vertices.select("name", F.when(F.size(words) > 1, F.array_distinct(words)).otherwise(F.array(F.lower("name"))).alias("parts"))
    spoken = mentions.select("name", F.array(F.lower("mention")).alias("parts"))
    longest = F.reduce("parts", F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return own.unionAll(spoken).distinct().select(F.substring(longest, 1, KEY_LENGTH).alias("key"), "name", "parts")


def named_in(queries: DataFrame, vertices: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, name): names of which all words, or a mention, occur in the query without regard to case.

    Every name stands in an index under the first characters of its longest
    part; a query looks up its substrings of up to that length in one equi join
    and checks the few names it meets. Neither side is held whole anywhere.
    """
    low = queries.select("query_id", F.coalesce(F.lower("query"), F.lit("")).alias("low"))
    at = F.sequence(F.lit(1), F.length("low"))
    grams = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(KEY_LENGTH), F.length("low") - i + 1)), lambda n: F.substr("low", i, n)))
    keys = low.filter(F.length("low") > 0).select("query_id", F.explode(F.array_distinct(F.flatten(grams))).alias("key"))
    met = keys.join(_keyed_names(vertices, mentions), "key").select("query_id", "name", "parts")
    return met.join(low, "query_id").filter(F.forall("parts", lambda w: F.contains("low", w))).select("query_id", "name").distinct()


def query_entities_of(queries: DataFrame, vertices: DataFrame, mentions: DataFrame, embed_names, threshold: float = 0.3) -> DataFrame:
    """(query_id, name): entities named in each query, else the three most similar ones; ``mentions`` has (name, mention)."""
    exact = written(named_in(queries, vertices, mentions))
    lone = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    if lone.isEmpty():
        return exact
    similar = nearest(embed_names(lone, "query"), embed_names(vertices.select("name"), "name"), 3, "cosine", threshold, item_id="name")
    return exact.unionByName(similar.select("query_id", F.col("item_id").alias("name")))


#: Queries whose reach is kept in one number, a bit for each.
BLOCK = 64


def numbered_queries(queries: DataFrame) -> DataFrame:
    """(query_id, block, bit) of the distinct queries, in order."""
    numbers = _numbered(queries.select("query_id").distinct(), "query_id", "number")
    return numbers.select("query_id", (F.col("number") / BLOCK).cast("int").alias("block"), (F.col("number") % BLOCK).alias("bit"))


def reach(named: DataFrame, numbers: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(block, name, own, reached): which queries of a block name an entity, and which are within ``depth`` steps of it.

    A step takes 64 queries at once along each edge, so its rows are arcs times
    blocks, however many entities the queries name.
    """
    steps = both_ways(edges).filter("node <> next")
    own = named.join(numbers, "query_id").groupBy("block", "name").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    own = written(own)
    front = own
    for _ in range(depth):
        further = front.join(steps, front["name"] == steps["node"]).groupBy("block", F.col("next").alias("name")).agg(F.bit_or("bits").alias("bits"))
        front = front.unionByName(further).groupBy("block", "name").agg(F.bit_or("bits").alias("bits"))
    mine = own.withColumnRenamed("bits", "own")
    return front.withColumnRenamed("bits", "reached").join(mine, ["block", "name"], "left").fillna(0, ["own"])


def links(named: DataFrame, wanted: DataFrame, edges: DataFrame, relationships: DataFrame) -> DataFrame:
    """(query_id, name, link) of wanted (query_id, name): the best link to an entity of the query within three steps.

    The same entity counts 1; others the mean confidence along a shortest path
    over its length plus one. Of several shortest paths from the query's entity the one least in
    order of names counts. Where there is none the row is left out.

    Both sides meet in the middle: steps from the query's entities and steps
    from the wanted ones are joined on the node between. Places on a path are compared one
    by one, no path is ever listed. A longer path can only matter to a row whose link so far is
    below the greatest confidence over the longer length, so most rows need no long ones.
    """
    known = step_relations(relationships)
    steps = written(
        both_ways(edges)
        .filter("node <> next")
        .join(known.select("lo", "hi", "confidence"), (F.least("node", "next") == F.col("lo")) & (F.greatest("node", "next") == F.col("hi")))
        .select("node", "next", "confidence")
    )
    most = steps.agg(F.max("confidence")).first()[0] or 0.0
    wanted = wanted.select("query_id", "name").distinct()
    same = wanted.join(named, ["query_id", "name"], "left_semi").withColumn("link", F.lit(1.0))
    rest = written(wanted.join(named, ["query_id", "name"], "left_anti"))
    # One step from the query's entities: what is next to them, with the first confidence.
    near = written(named.join(steps, F.col("name") == F.col("node")).select("query_id", F.col("name").alias("origin"), F.col("next").alias("a"), F.col("confidence").alias("c1")))
    key = ["query_id", "name"]

    def best(found: DataFrame, length: int) -> DataFrame:
        return found.groupBy(*key).agg(F.max(F.col("total") / length / (length + 1)).alias("link"))

    def still_open(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
        told = found.groupBy(*key).agg(F.max("link").alias("link"))
        return rows.join(told, key, "left").filter(F.coalesce("link", F.lit(0.0)) < most / (length + 1)).select(*key)

    adjacent = near.withColumnRenamed("a", "name").join(rest, key, "left_semi")
    one = written(best(adjacent.withColumn("total", F.col("c1")), 1))

    second = written(still_open(rest, one, 2))
    ahead = second.join(steps, F.col("name") == F.col("node")).select(*key, F.col("next").alias("a"), F.col("confidence").alias("c2"))
    met = near.join(ahead, ["query_id", "a"]).filter("origin <> name").join(adjacent.select(*key, "origin"), [*key, "origin"], "left_anti")
    two = written(met.groupBy(*key, "origin").agg(F.min_by(F.col("c1") + F.col("c2"), "a").alias("total")))

    found = one.unionByName(best(two, 2))
    third = written(still_open(second, found, 3))
    behind = third.join(steps, F.col("name") == F.col("node")).select(*key, F.col("next").alias("b"), F.col("confidence").alias("c3"))
    ahead = behind.join(steps, F.col("b") == F.col("node")).select(*key, "b", "c3", F.col("next").alias("a"), F.col("confidence").alias("c2"))
    nearer = adjacent.select(*key, "origin").unionByName(two.select(*key, "origin"))
    met = near.join(ahead, ["query_id", "a"]).filter("origin <> name AND origin <> b").join(nearer, [*key, "origin"], "left_anti")
    three = met.groupBy(*key, "origin").agg(F.min_by(F.col("c1") + F.col("c2") + F.col("c3"), F.struct("a", "b")).alias("total"))
    best_of_all = found.unionByName(best(three, 3)).groupBy(*key).agg(F.max("link").alias("link"))
    return same.unionByName(best_of_all)


def _picked(table: dict[str, str], column: str, other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)], F.lit(other))


def drawing_nodes(vertices: DataFrame, important: DataFrame) -> DataFrame:
    """Nodes with sizes and colours for drawing."""
    return vertices.join(dealt(important), "name", "left").select(
        F.col("name").alias("id"), F.col("name").alias("label"), F.col("entity_type").alias("type"), "confidence", "importance",
        (F.coalesce("chunk_count", F.lit(0)) * 5 + 10).alias("size"), _picked(TYPE_COLOURS, "entity_type", OTHER_TYPE).alias("color"),
    )


def drawing_edges(relationships: DataFrame) -> DataFrame:
    """Edges with widths and colours for drawing; they need no measure of the nodes."""
    return relationships.select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation_type").alias("type"), "confidence",
        (F.col("confidence") * 3 + 1).alias("width"), _picked(RELATION_COLOURS, "relation_type", OTHER_RELATION).alias("color"),
    )


def drawing(vertices: DataFrame, relationships: DataFrame, important: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with sizes, widths and colours for drawing."""
    return drawing_nodes(vertices, important), drawing_edges(relationships)

"""Search along the graph and communities against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpusql.queries as Q
from corpusql.functions.vectors import EPSILON
from corpusql.operators import graph as G
from corpusql.plans import graph as GP

SF = "/root/testdata/sf0.001"
REL = "src string, dst string, relation_type string, confidence double, seq long"


def a_graph(spark, n, m, seed):
    rng = random.Random(seed)
    names = [f"{rng.choice('abcxyz')}{i}" for i in range(n)]
    hub = names[0]
    rows = [(rng.choice([hub, rng.choice(names)]), rng.choice(names), rng.choice("UV"), round(rng.uniform(0.1, 0.9), 3), i) for i in range(m)]
    relationships = spark.createDataFrame(rows, REL)
    return names, rows, relationships, G.last_edges(relationships)


def confidences(rows):
    """The first relationship of each unordered pair."""
    first = {}
    for s, t, _, c, seq in sorted(rows, key=lambda r: r[4]):
        first.setdefault((min(s, t), max(s, t)), c)
    near = {}
    for (s, t), c in first.items():
        if s != t:
            near.setdefault(s, {})[t] = c
            near.setdefault(t, {})[s] = c
    return near


def link(near, s, t):
    """By listing all paths of up to three steps: the least in order of names among the shortest."""
    if s == t:
        return 1.0
    paths = [[s]]
    for length in range(1, 4):
        paths = [[*p, x] for p in paths for x in near.get(p[-1], {}) if x not in p]
        there = sorted(p for p in paths if p[-1] == t)
        if there:
            total = 0.0
            for a, b in itertools.pairwise(there[0]):
                total += near[a][b]
            return total / length / (length + 1)
    return None


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 40, 1), (60, 70, 2), (12, 60, 3)])
def test_links_against_listed_paths(spark, n, m, seed):
    names, rows, relationships, edges = a_graph(spark, n, m, seed)
    rng, near = random.Random(seed), confidences(rows)
    named = {q: rng.sample(names, 3) for q in range(3)}
    wanted = [(q, x) for q in named for x in rng.sample(names, 10)]
    found = G.links(spark.createDataFrame([(q, x) for q, xs in named.items() for x in xs], "query_id long, name string"), spark.createDataFrame(wanted, "query_id long, name string"), edges, relationships)
    want = {(q, x): max(v) for q, x in wanted if (v := [k for s in named[q] if (k := link(near, s, x)) is not None])}
    assert {(r.query_id, r.name): r.link for r in found.collect()} == pytest.approx(want)


def test_names_in_queries(spark):
    vertices = ["Python", "Neural Network", "AI-System", "Rain Man", "a", "Über Straße", "the the", "long unbroken name of things", "x" * 30]
    mentions = [("Python", "PYTHON"), ("AI-System", "ai system"), ("Neural Network", "neural network"), ("Python", "py")]
    queries = ["python rains on a man", "network, neural", "ÜBER die STRASSE straße", "", None, "the AI system", "y" * 50, "q" + "x" * 31, "things of name: long and unbroken", "P"]
    df = G.named_in(
        spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"),
        spark.createDataFrame([(v,) for v in vertices], "name string"), spark.createDataFrame(mentions, "name string, mention string"),
    )
    want = set()
    for i, q in enumerate(queries):
        low = (q or "").lower()
        for v in vertices:
            words = v.lower().split()
            said = [m.lower() for n, m in mentions if n == v]
            if v.lower() in low or (len(words) > 1 and all(w in low for w in words)) or any(m in low for m in said):
                want.add((i, v))
    assert {tuple(r) for r in df.collect()} == want
    assert {v for i, v in want if i == 0} == {"Python", "Rain Man", "a"}


def test_reach_equals_neighbours(spark):
    names, _, _, edges = a_graph(spark, 80, 90, 4)
    rng = random.Random(4)
    named = [(q, x) for q in range(130) for x in rng.sample(names, rng.randrange(1, 3))]
    df = spark.createDataFrame(named, "query_id long, name string")
    numbers = G.numbered_queries(df)
    place = {(r.block, r.bit): r.query_id for r in numbers.collect()}
    assert len(place) == 130 and max(b for b, _ in place) == 2
    got = {"own": set(), "reached": set()}
    for r in G.reach(df, numbers, edges).collect():
        for kind in got:
            got[kind] |= {(place[r.block, i], r.name) for i in range(64) if r[kind] >> i & 1}
    near = G.neighbours(df.select(F.col("name").alias("origin")), edges, 2)
    want = {tuple(r) for r in df.join(near, df["name"] == near["origin"]).select("query_id", "node").collect()} | set(named)
    assert got["own"] == set(named) and got["reached"] == want


@pytest.fixture(scope="module")
def searched(spark):
    asked, graph = Q._questions(spark, SF), GP.index(Q._table(spark, SF, "documents"), Q.GRAPH_CONFIG)
    return asked, graph


def test_hits_against_scoring_all(spark, searched):
    """Every chunk of every query is scored in plain Python; nothing is left out early."""
    asked, graph = searched
    queries = {r.query_id: r.query for r in asked.collect()}
    strength, important = {r.name: r.confidence for r in graph.vertices.collect()}, {r.name: r.importance for r in graph.importance.collect()}
    words = {n: [[n.lower()], n.lower().split()] for n in strength}
    said = {}
    for r in graph.mentions.collect():
        said.setdefault(r.name, []).append(r.mention.lower())
    chunk_entities, inside = {}, {}
    for r in graph.chunk_entities.collect():
        chunk_entities.setdefault(r.name, set()).add(r.chunk_id)
        inside.setdefault(r.chunk_id, set()).add(r.name)
    step = {}
    for r in G.both_ways(graph.edges).collect():
        step.setdefault(r.node, set()).add(r.next)
    order = ["doc_id", "seq"]
    rows = [(r.src, r.dst, r.relation_type, r.confidence, i) for i, r in enumerate(graph.relationships.orderBy(*order).collect())]
    near = confidences(rows)
    vectors = {r.chunk_id: r.embedding for r in graph.chunks.select("chunk_id", "embedding").collect()}
    own_vectors = {r.query_id: r.embedding for r in GP.vanilla.embedded_queries(asked, Q.GRAPH_CONFIG).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / ((math.sqrt(sum(x * x for x in a)) + EPSILON) * (math.sqrt(sum(x * x for x in b)) + EPSILON))

    memo = {}

    def known_link(s, t):
        if (s, t) not in memo:
            memo[s, t] = link(near, s, t) or 0.0
        return memo[s, t]

    some = sorted(queries)[::8]
    got = {}
    for r in GP.retrieve(asked, graph, Q.GRAPH_CONFIG).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score, r.similarity, r.graph_relevance, r.connectivity))
    checked = 0
    for q in some:
        low = queries[q].lower()
        named = {n for n, (whole, parts) in words.items() if whole[0] in low or (len(parts) > 1 and all(w in low for w in parts)) or any(m in low for m in said.get(n, []))}
        if not named:
            continue
        related = {b for a in named for b in step.get(a, set())}
        related |= {c for b in related for c in step.get(b, set())}
        score = {n: 0.8 * important[n] for n in related} | dict.fromkeys(named, 1.0)
        chunks = {c for n in score for c in chunk_entities.get(n, ())}
        graded = []
        for c in chunks:
            of = inside[c] & set(score)
            relevance = sum(score[n] * strength[n] for n in sorted(of)) * (1 + 0.1 * len(of))
            likeness = round(cosine(vectors[c], own_vectors[q]), 6)
            graded.append((c, likeness, relevance))
        # Links only where they can matter, to spare time; the bound is the greatest link, 1.
        bar = sorted((0.4 * s + 0.4 * g for _, s, g in graded), reverse=True)[:5][-1]
        whole = []
        for c, likeness, relevance in graded:
            if 0.4 * likeness + 0.4 * relevance + 0.2001 >= bar:
                connected = sum(max(known_link(s, n) for s in named) for n in inside[c]) / len(inside[c])
                whole.append((round(0.4 * likeness + 0.4 * relevance + 0.2 * connected, 6), c, likeness, round(relevance, 6), round(connected, 6)))
        best = [w for w in sorted(whole, key=lambda w: (-w[0], w[1])) if w[0] >= 0.2 * 0.7][:5]
        assert [(i + 1, w[1]) for i, w in enumerate(best)] == [g[:2] for g in sorted(got[q])]
        for w, g in zip(best, sorted(got[q]), strict=True):
            assert (w[0], w[2], w[3], w[4]) == pytest.approx(g[2:], abs=2e-6)
        checked += 1
    assert checked >= 3


def test_answers_name_what_was_found(spark, searched):
    asked, graph = searched
    named = {}
    for r in GP.named_entities(asked, graph, Q.GRAPH_CONFIG).collect():
        named.setdefault(r.query_id, set()).add(r.name)
    answers = GP.query(asked, graph, Q.GRAPH_CONFIG).collect()
    assert len(answers) == asked.count()
    for r in answers:
        assert set(r.query_entities) == named.get(r.query_id, set())
        assert 0 <= r.confidence <= 1 and (r.chunks_retrieved > 0) == bool(r.context)


def quality(groups, edges):
    m = len(edges)
    degree, inner = {}, {}
    for a, b in edges:
        degree[groups[a]] = degree.get(groups[a], 0) + 1
        degree[groups[b]] = degree.get(groups[b], 0) + 1
        if groups[a] == groups[b]:
            inner[groups[a]] = inner.get(groups[a], 0) + 1
    return sum(inner.get(c, 0) / m - (d / 2 / m) ** 2 for c, d in degree.items())


def partitions(names):
    if not names:
        yield []
        return
    for rest in partitions(names[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [names[0], *rest[i]], *rest[i + 1 :]]
        yield [[names[0]], *rest]


def framed(spark, edges, names):
    rows = [(a, b, f"T{i}", 0.5, i) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame([(n,) for n in names], "name string"), G.last_edges(spark.createDataFrame(rows, REL))


def test_louvain_finds_cliques(spark):
    cliques = [[f"{c}{i}" for i in range(5)] for c in "pqrs"]
    edges = [pair for c in cliques for pair in itertools.combinations(c, 2)] + [(cliques[i][0], cliques[(i + 1) % 4][1]) for i in range(4)]
    vertices, frame = framed(spark, edges, [n for c in cliques for n in c] + ["z"])
    groups = {r.name: r.community for r in G.communities(vertices, frame).collect()}
    assert [len({groups[n] for n in c}) for c in cliques] == [1] * 4 and sorted(set(groups.values())) == [0, 1, 2, 3, 4]
    assert groups["p0"] == 0 and groups["z"] == 4  # numbered by the least name
    told = G.modularity(G.communities(vertices, frame), frame).first()
    assert told.communities == 5 and told.modularity == pytest.approx(quality(groups, edges), abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_against_all_partitions(spark, seed):
    rng = random.Random(seed)
    names = list("abcdefg")
    edges = [tuple(rng.sample(names, 2)) for _ in range(9)] + [("a", "a")]
    vertices, frame = framed(spark, edges, names)
    groups = {r.name: r.community for r in G.louvain(vertices, frame).collect()}
    best = max(quality({n: i for i, part in enumerate(p) for n in part}, edges) for p in partitions(names))
    assert quality(groups, edges) >= 0.85 * best - 1e-9


def test_louvain_beats_label_propagation(spark):
    vertices, _, edges = Q._part_graph(spark, SF)
    one, other = (G.modularity(G.communities(vertices, edges, way), edges).first().modularity for way in ("louvain", "label_propagation"))
    assert one >= other


def test_sampled_betweenness_is_within_its_bound(spark):
    vertices, _, edges = Q._part_graph(spark, SF)
    exact = {r.name: r.betweenness for r in G.betweenness(vertices, edges).collect()}
    sampled = G.betweenness_sampled(vertices, edges, error=0.05, first=64).collect()
    assert {r.name for r in sampled} == set(exact)
    assert all(abs(r.betweenness - exact[r.name]) <= r.error + 1e-12 for r in sampled)
    whole = G.betweenness_sampled(vertices, edges, error=0.0, first=64).collect()  # never reached, so all sources are taken
    assert all(r.error == 0 for r in whole) and {r.name: r.betweenness for r in whole} == pytest.approx(exact)


def test_sampling_stops_early_and_is_unbiased(spark, monkeypatch):
    """Stars of stars: many sources, few vertices between them; the mean over seeds comes near the truth."""
    edges = [(f"l{i}", f"h{i % 3}") for i in range(900)] + [(f"h{i}", "m") for i in range(3)] + [("m", f"o{i}") for i in range(30)]
    names = sorted({x for e in edges for x in e})
    vertices, frame = framed(spark, edges, names)
    exact = {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()}
    runs = [{r.name: (r.betweenness, r.error, r.sources) for r in G.betweenness_sampled(vertices, frame, error=0.5, first=100, seed=seed).collect()} for seed in range(4)]
    assert all(run["m"][2] < 904 and run["m"][1] <= 0.5 for run in runs)
    assert all(abs(run[n][0] - exact[n]) <= run[n][1] for run in runs for n in names)
    assert sum(run["h0"][0] for run in runs) / 4 == pytest.approx(exact["h0"], rel=0.25)
    monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
    joined = {r.name: r.betweenness for r in G.betweenness_sampled(vertices, frame, error=0.5, first=100).collect()}
    assert joined == pytest.approx({n: v[0] for n, v in runs[0].items()})


def test_communities_send_no_table_of_nodes_to_the_driver(spark):
    """Tables of numbers look small in files; their joins deal both sides by key nevertheless."""
    vertices = spark.createDataFrame([(f"n{i:03}",) for i in range(60)], "name string")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i - i % 5 + j:03}", "X", 1.0) for i in range(60) for j in range(5) if i % 5 < j], "src string, dst string, relation_type string, confidence double")
    members = G.louvain(vertices, edges)
    assert len({r.community for r in members.collect()}) == 12
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") <= 2  # the ranges' counts only, a row for each; the plan is told before and after


def dependencies(arcs, n):
    """Shares of shortest paths by listing them."""
    near, total = {}, [0.0] * n
    for a, b in sorted(arcs):
        near.setdefault(a, []).append(b)
    for s in range(n):
        paths, ended = [[s]], {s}
        while paths:
            paths = [[*p, x] for p in paths for x in near.get(p[-1], []) if x not in ended]
            ways = {}
            for p in paths:
                ways.setdefault(p[-1], []).append(p)
            for same in ways.values():
                for p in same:
                    for x in p[1:-1]:
                        total[x] += 1 / len(same)
            ended |= set(ways)
    return total


@pytest.mark.parametrize("seed", range(40))
def test_walks_that_count_for_the_nodes_before_them(seed):
    """Few arcs and many, so that nodes with one arc stand before others, in chains and in circles; alike nodes are one class."""
    rng = random.Random(seed)
    n = rng.choice([5, 9, 14])
    arcs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n, 2 * n, 3 * n]))}
    arcs = np.array(sorted((a, b) for a, b in arcs if a != b), np.int64)
    to = {}
    for a, b in arcs.tolist():
        to.setdefault(a, []).append(b)
    kind, classes = np.arange(n), {}
    for a, bs in to.items():
        classes.setdefault(tuple(bs), []).append(a)
    for members in classes.values():
        kind[members] = members[0]
    shares = G._Shares(arcs[:, 0], arcs[:, 1], kind, merged=True)
    for members in classes.values():
        shares.add(members[0], len(members))
    assert shares.total.tolist() == pytest.approx(dependencies(arcs.tolist(), n))
    alone = G._Shares(arcs[:, 0], arcs[:, 1], np.arange(n))
    for a in to:
        alone.add(a)
    assert alone.total.tolist() == pytest.approx(shares.total.tolist()) and not alone.counted


def test_nodes_with_one_arc_are_not_walked_from():
    arcs = np.array([(0, 1), (1, 2), (1, 3), (2, 0), (3, 0), (4, 1), (5, 4)], np.int64)
    shares = G._Shares(arcs[:, 0], arcs[:, 1], np.array([0, 1, 2, 2, 0, 5]), merged=True)
    assert shares.counted == {0} and shares.before == {1: [0]}  # the class of 0 and 4; what 2 and 3 lead to has one arc itself

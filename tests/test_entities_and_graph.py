import pytest

from corpusql.operators import entities as E
from corpusql.operators import graph as G

TEXT = "Google develops TensorFlow. The Machine Learning system uses Python within Stanford. Dr. Ada Lovelace met Ada Lovelace at MIT, a company."


def test_mentions():
    found = E.mentions_in(TEXT)
    by = {(m.name, m.method): m for m in found}
    assert by["Google", "pattern"].entity_type == "ORGANIZATION"
    assert by["TensorFlow", "pattern"].confidence == pytest.approx(0.6)
    assert by["MIT", "pattern"].confidence == pytest.approx(0.6)  # capitals raise technologies and products only
    assert by["Google", "capitalised"].entity_type == "TECHNOLOGY"  # 'system' occurs in the chunk
    assert by["Ada Lovelace", "capitalised"].confidence == 0.6
    assert not any(m.name == "AI" for m in E.mentions_in("AI and ML"))
    assert [m.name for m in E.mentions_in("The. Figure One. When. Those")] == []
    assert E.mentions_in("") == []


def test_relations():
    found = E.mentions_in(TEXT)
    relations = E.relations_in(TEXT, found)
    stated = {(r.src, r.dst, r.relation_type): r.confidence for r in relations if r.method == "indicator"}
    assert stated["Google", "TensorFlow", "DEVELOPS"] == pytest.approx(0.8)
    loops = [r for r in relations if r.src == r.dst and r.distance == 0]
    assert loops  # a span matched twice
    assert all(0.3 <= r.confidence <= 0.8 for r in relations if r.method == "proximity")
    assert E.relations_in("an algorithm", E.mentions_in("an algorithm")) == []  # one mention alone


def test_repeated_indicator_takes_the_last_place():
    text = "alpha Python uses Docker uses Keras"
    stated = [(r.src, r.dst) for r in E.relations_in(text, E.mentions_in(text)) if r.method == "indicator"]
    assert stated == [("Python", "Keras")]


def test_long_runs_of_words_are_no_trouble():
    text = "Alpha Beta " * 2_000
    assert len(E.mentions_in(text)) == 1
    assert E.relations_in(text, E.mentions_in(text)) == []


@pytest.fixture(scope="module")
def extracted(spark):
    chunks = spark.createDataFrame(
        [("c0", 1, 0, "Machine-Learning helps Google. machine learning grows."), ("c1", 1, 1, "Google uses Python. Google uses Python in Docker."), ("c2", 2, 0, "Python and Docker run."), ("c3", 2, 1, None)],
        "chunk_id string, doc_id long, chunk_index int, content string",
    )
    return chunks, E.mentions(chunks), E.relations(chunks)


def test_merging(extracted):
    _, mentions, _ = extracted
    merged = {(r.doc_id, r.norm): r for r in E.merged(mentions).collect()}
    google = merged[1, "google"]
    assert google.chunk_ids == ["c0", "c1"] and google.mention_count == 6
    assert google.entity_type == "ORGANIZATION"  # as often as the other type, and seen first
    assert merged[1, "machine learning"].name == "machine learning" or merged[1, "machine learning"].name == "Machine"


def test_filtering(extracted):
    _, mentions, relations = extracted
    merged = E.merged(mentions)
    kept, rejected = E.filtered(relations, merged)
    rows = kept.collect()
    keys = [(r.doc_id, *sorted((r.src, r.dst)), r.relation_type) for r in rows]
    assert len(keys) == len(set(keys))
    best = {}
    names = {(r.doc_id, r.name) for r in merged.collect()}
    for r in relations.collect():
        if (r.doc_id, r.src) in names and (r.doc_id, r.dst) in names:
            key = (r.doc_id, *sorted((r.src, r.dst)), r.relation_type)
            best[key] = max(best.get(key, 0), r.confidence)
    assert {k: r.confidence for k, r in zip(keys, rows, strict=True)} == best
    assert rejected.count() + sum(1 for r in relations.collect() if (r.doc_id, r.src) in names and (r.doc_id, r.dst) in names) == relations.count()


def test_stats(extracted):
    chunks, mentions, relations = extracted
    stats = {r.chunk_id: r for r in E.extraction_stats(chunks, mentions, relations).collect()}
    assert stats["c3"].total_entities == 0 and stats["c3"].avg_entity_confidence == 0
    by_doc = {r.doc_id: r for r in E.document_stats(E.extraction_stats(chunks, mentions, relations)).collect()}
    assert by_doc[1].total_entities == stats["c0"].total_entities + stats["c1"].total_entities
    assert by_doc[1].sum_avg_entity_confidence == pytest.approx(stats["c0"].avg_entity_confidence + stats["c1"].avg_entity_confidence)


def test_building(extracted):
    _, mentions, relations = extracted
    merged = E.merged(mentions)
    vertices, relationships, edges, bridge = G.build(merged, E.filtered(relations, merged)[0])
    by_name = {r.name: r for r in vertices.collect()}
    assert by_name["Python"].chunk_count == 2 and {r.chunk_id for r in bridge.filter("name = 'Python'").collect()} == {"c1", "c2"}
    last = G.build(merged, E.filtered(relations, merged)[0], last_wins=True)
    assert {r.chunk_id for r in last[3].filter("name = 'Python'").collect()} == {"c2"}
    assert edges.count() <= relationships.count()


@pytest.fixture(scope="module")
def small(spark):
    """a-b-c-d in a row with a parallel edge and a loop, e-f apart, g alone."""
    rows = [("a", "b", "X", 0.9, 1), ("a", "b", "X", 0.5, 2), ("a", "b", "Y", 0.4, 3), ("b", "c", "X", 0.6, 4), ("d", "c", "Y", 0.3, 5), ("a", "a", "X", 0.2, 6), ("e", "f", "X", 0.7, 7), ("a", "c", "Z", 0.1, 8), ("q", "a", "X", 0.5, 9)]
    relationships = spark.createDataFrame(rows, "src string, dst string, relation_type string, confidence double, seq long")
    vertices = spark.createDataFrame([(n, "T", 0.5, 1, 1) for n in "abcdefg"], "name string, entity_type string, confidence double, chunk_count long, mention_count long")
    relationships = G.valid(relationships, vertices)
    return vertices, relationships, G.last_edges(relationships)


def test_edges(small):
    _, relationships, edges = small
    assert relationships.filter("src = 'q'").count() == 0
    assert {(r.src, r.dst, r.relation_type): r.confidence for r in edges.collect()}["a", "b", "X"] == 0.5
    assert edges.count() == 7


def origins(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "origin string")


def test_neighbours_and_paths(spark, small):
    _, relationships, edges = small
    near = {(r.node, r.distance) for r in G.neighbours(origins(spark, "a"), edges, 2).collect()}
    assert near == {("b", 1), ("c", 1), ("d", 2)}
    assert {(r.node, r.distance) for r in G.neighbours(origins(spark, "a"), edges, 2, ["Y"]).collect()} == {("b", 1)}
    assert ("a", 2) in {(r.node, r.distance) for r in G.neighbours(origins(spark, "a"), edges, 2, keep_origin=True).collect()}
    assert G.neighbours(origins(spark, "nobody"), edges).count() == 0
    pairs = spark.createDataFrame([("a", "d"), ("a", "e"), ("a", "a")], "source string, target string")
    assert sorted(tuple(r.path) for r in G.paths(pairs, edges).collect()) == [("a", "b", "c", "d"), ("a", "c", "d")]
    steps = G.connection_paths(pairs, edges, relationships).filter("length = 2").orderBy("step").collect()
    assert [(r.relation_type, r.confidence, r.direction) for r in steps] == [("Z", 0.1, "forward"), ("Y", 0.3, "reverse")]
    short = {r.node: (r.length, round(r.mean_confidence, 6)) for r in G.shortest_paths(origins(spark, "a"), edges, relationships).collect()}
    assert short == {"a": (0, 1.0), "b": (1, 0.9), "c": (1, 0.1), "d": (2, 0.2)}


def test_measures(spark, small):
    vertices, relationships, edges = small
    degree = {r.name: r.degree for r in G.degrees(vertices, edges).collect()}
    assert degree == {"a": 5, "b": 3, "c": 3, "d": 1, "e": 1, "f": 1, "g": 0}
    assert {r.name: r.component for r in G.components(vertices, edges).collect()} == {**dict.fromkeys("abcd", "a"), "e": "e", "f": "e", "g": "g"}
    clustering = {r.name: r.clustering for r in G.clustering(vertices, edges).collect()}
    assert clustering == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3, abs=1e-6), "d": 0, "e": 0, "f": 0, "g": 0}
    stats = G.statistics(vertices, edges).first()
    assert (stats.nodes, stats.edges, stats.connected_components) == (7, 7, 3)
    assert stats.density == pytest.approx(7 / 42, abs=1e-6)
    groups = {r.name: r.community for r in G.communities(vertices, edges).collect()}
    assert groups["a"] == groups["b"] and groups["e"] == groups["f"] and groups["a"] != groups["e"]
    assert G.communities(vertices, edges, "other").count() == 0
    assert G.subgraph(spark.createDataFrame([("b",)], "name string"), edges).count() == 1
    context = {r.name: r for r in G.entity_context(vertices.filter("name = 'a'"), vertices, edges, relationships, G.importance(vertices, edges)).collect()}
    assert (context["a"].incoming, context["a"].outgoing) == (1, 4)


def test_betweenness_both_ways(spark, monkeypatch):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "e"), ("b", "d"), ("e", "a")]
    frame = spark.createDataFrame([(*e, "X", 1.0) for e in edges], "src string, dst string, relation_type string, confidence double")
    vertices = spark.createDataFrame([(n, 1.0) for n in "abcdef"], "name string, confidence double")

    def paths(s, t):
        front, found = [[s]], []
        while front and not found:
            front = [p + [b] for p in front for a, b in edges if a == p[-1] and b not in p]
            found = [p for p in front if p[-1] == t]
        return found

    want = dict.fromkeys("abcdef", 0.0)
    for s in want:
        for t in want:
            if s != t and (found := paths(s, t)):
                for v in want:
                    if v not in (s, t):
                        want[v] += sum(v in p for p in found) / len(found) / 20
    one = {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()}
    monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
    two = {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()}
    assert one == pytest.approx(want) and two == pytest.approx(want)


def test_shortest_paths_keep_no_paths(spark):
    """Of equal paths the one least in order of names counts; only numbers are aggregated, so by hashing and without a sort."""
    rows = [("a", "b", 0.1), ("a", "c", 0.9), ("b", "z", 0.2), ("c", "d", 0.8), ("b", "d", 0.3), ("c", "z", 0.7), ("z", "y", 0.4), ("d", "y", 0.6)]
    edges = spark.createDataFrame([(a, b, "USES", c, i) for i, (a, b, c) in enumerate(rows)], "src string, dst string, relation_type string, confidence double, seq long")
    found = G.shortest_paths(origins(spark, "a"), edges.drop("seq"), edges)
    own = {r.node: (r.length, round(r.mean_confidence, 6)) for r in found.collect()}
    assert own == {"a": (0, 1.0), "b": (1, 0.1), "c": (1, 0.9), "z": (2, 0.15), "d": (2, 0.2), "y": (3, round((0.1 + 0.3 + 0.6) / 3, 6))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(" in plan and "array(" not in plan and "concat(" not in plan


def test_tables_of_the_part_graph_are_written(spark):
    """Planned from the file of parts they would be broadcast, 896 MB of it at 60 times sf0.1."""
    from corpusql.queries import _part_graph

    for table in _part_graph(spark, "/root/testdata/sf0.001"):
        assert not any("part.parquet" in file for file in table.inputFiles())


def test_patterns_are_tried_only_where_a_match_can_begin():
    import re
    import sys

    for letter in "abcdefghijklmnopqrstuvwxyz":  # whatever equals a letter for the patterns does so here
        like = re.findall(letter, "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000), re.IGNORECASE)
        assert all(E.folded_words(c) == {letter} for c in like)
    text = "A NEURAL network by Dr. Ann Lee and Bo Chan PhD in C++x, ſYSTEM, lİbrary, GPT-4; an apikey is no match. "
    plain = [(m.group().strip(), kind) for kind, pattern, _, _ in E._ENTITIES for m in pattern.finditer(text) if len(m.group().strip()) > 2]
    assert plain == [(m.name, m.entity_type) for m in E.mentions_in(text) if m.method == "pattern"] and len(plain) >= 6


def test_merging_reads_a_table_and_not_the_extraction(spark):
    import corpusql.queries as Q

    for name, most in (("entities_merged", 0), ("entity_mentions", 1)):
        plan = Q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == most
        assert name == "entities_merged" or "RepartitionByExpression" in plan  # one row group is not one task


def test_betweenness_walks_once_for_nodes_alike(spark, monkeypatch):
    """Nodes with the same arcs are one class, on cycles too, and the values are those of a walk from each."""
    edges = [(f"{x}{i}", y) for x, ends in (("p", "ab"), ("q", "c"), ("r", "ad")) for i in range(6) for y in ends]
    edges += [("a", "c"), ("b", "c"), ("c", "d"), ("d", "p0"), ("d", "p1"), ("c", "q2"), ("a", "r0"), ("d", "e")]
    frame = spark.createDataFrame([(*e, "X", 1.0) for e in edges], "src string, dst string, relation_type string, confidence double")
    nodes = sorted({n for e in edges for n in e} | {"z"})
    vertices = spark.createDataFrame([(n, 1.0) for n in nodes], "name string, confidence double")
    nexts = {n: [b for a, b in edges if a == n] for n in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            front, found = [[s]], []
            while front and not found and s != t:
                front = [[*p, b] for p in front for b in nexts[p[-1]] if b not in p]
                found = [p for p in front if p[-1] == t]
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found) / (len(nodes) - 1) / (len(nodes) - 2)
    walks = []
    add = G._shares
    monkeypatch.setattr(G, "_shares", lambda names, arcs, n, classes: walks.append(classes.filter("source = v").count()) or add(names, arcs, n, classes))
    assert {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()} == pytest.approx(want)
    monkeypatch.setattr(G, "BROADCAST_EDGES", 2)
    assert {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()} == pytest.approx(want)
    assert walks == [6, 6]  # p, q, r, a, d, and c; b has the arcs of q
    monkeypatch.setattr(G, "ALIKE_ARCS", 1)
    assert {r.name: r.betweenness for r in G.betweenness(vertices, frame).collect()} == pytest.approx(want)


def test_drawn_edges_measure_nothing(spark, small, monkeypatch):
    """The query of edges for drawing needs no importance of the nodes."""
    from corpusql import queries

    vertices, relationships, edges = small
    monkeypatch.setattr(queries, "_part_graph", lambda spark, sf_dir: (vertices, relationships, edges))
    monkeypatch.setattr(G, "importance", lambda *tables: pytest.fail("importance was computed"))
    assert queries.graph_drawing_edges(spark, "").count() == relationships.count()
    assert {r.id for r in G.drawing_nodes(vertices, vertices.selectExpr("name", "0.5D AS importance")).collect()} == set("abcdefg")

"""DuckDB SQL for the core queries that SQL can express."""

from __future__ import annotations

_WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_CLEAN = _strip(
    rf"regexp_replace(regexp_replace(coalesce(text, ''), '[{_WS}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_{_WS}.,!?;:\-()\[\]{{}}\"''/]', '', 'g')"
)
CLEANED = f"cleaned AS (SELECT doc_id, {_CLEAN} AS content FROM documents)"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{_WS}]+'), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[.!?]+'), lambda s: {_strip('s')}), lambda s: s <> '')"


def _hash(x: str) -> str:
    return f"md5({x})"


def fixed_chunks(size: int = 512, overlap: int = 50) -> str:
    """CTEs up to ``chunks(doc_id, chunk_index, content)`` of cleaned documents; after WITH RECURSIVE."""
    chunk = f"substr(content, start, {size})"
    blank = f"CASE WHEN position(' ' IN reverse({chunk})) = 0 THEN -1 ELSE len({chunk}) - position(' ' IN reverse({chunk})) END"
    end = f"""CASE WHEN start + {size} - 1 < len(content) AND substr(content, start + {size}, 1) <> ' ' AND ({blank}) > {size // 2}
                   THEN start + ({blank}) ELSE start + {size} END"""
    return f"""
        {CLEANED}, walk AS (
            SELECT doc_id, content, 1 AS start, 0 AS part, ''::VARCHAR AS piece FROM cleaned WHERE trim(content) <> ''
            UNION ALL
            SELECT doc_id, content, greatest(start + {size} - {overlap}, {end}), part + 1, trim(substr(content, start, {end} - start))
            FROM walk WHERE start <= len(content)
        ), chunks AS (
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chunk_index, piece AS content
            FROM walk WHERE part > 0 AND piece <> ''
        )"""


def semantic_chunks(size: int, overlap: int, least: int, name: str = "chunks") -> str:
    """CTEs from ``cleaned`` to ``name(doc_id, chunk_index, content)``, by sentences; needs WITH RECURSIVE."""
    return f"""
        {name}_s AS (
            SELECT doc_id, {_sentences("content")} AS s FROM cleaned
        ), {name}_p AS (
            SELECT doc_id, s, list_prepend(0::HUGEINT, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: len(x))))) AS p
            FROM {name}_s WHERE len(s) > 0
        ), {name}_w AS (
            SELECT doc_id, s, p, 0::BIGINT AS first, 0::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS b FROM {name}_p
            UNION ALL
            SELECT doc_id, s, p,
                   CASE WHEN i < len(s) AND full_ AND {overlap} > 0 AND i - first >= 2
                        THEN coalesce(list_filter(range(first, i), lambda j: p[i + 1] - p[j + 1] <= {overlap})[1], i)
                        WHEN i < len(s) AND full_ THEN i ELSE first END,
                   i + 1,
                   CASE WHEN i = len(s) OR full_ THEN first END,
                   CASE WHEN i = len(s) OR full_ THEN i END
            FROM (SELECT *, i > first AND i < len(s) AND p[i + 2] - p[first + 1] > {size} AS full_ FROM {name}_w WHERE i <= len(s))
        ), {name}_c AS (
            SELECT doc_id, i, trim(array_to_string(s[a + 1:b], ' ')) AS content FROM {name}_w WHERE b IS NOT NULL
        ), {name} AS (
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, content
            FROM {name}_c WHERE len(content) >= {least}
        )"""


def _embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs up to ``name(key, bucket, value)``: unit vectors of word counts by bucket."""
    return f"""
        {name}_b AS (
            SELECT {key}, (('0x' || substr(md5(w), 1, 8))::UBIGINT % 64)::INT AS bucket, count(*)::DOUBLE AS c
            FROM (SELECT {key}, unnest({_words(f"lower({text})")}) AS w FROM {source}) GROUP BY ALL
        ), {name} AS (SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS value FROM {name}_b)"""


_EPS = "(1.0::DOUBLE + 1e-8) * (1.0::DOUBLE + 1e-8)"

def _exact_hits(questions: str = "qv", scored: str = "scored") -> str:
    """CTEs from ``chunks`` to hits(query_id, chunk_id, doc_id, content, score, rank) of the exact search; the names given keep it apart from other searches."""
    return f"""named AS (
            SELECT doc_id::VARCHAR || '_fixed_size_' || chunk_index::VARCHAR AS chunk_id, * FROM chunks
        ), {_embedded("named", "chunk_id", "content", "cv")}, {_embedded("benchmark", "item_id", "text", questions)}, {scored} AS (
            SELECT q.item_id AS query_id, c.chunk_id, round(sum(q.value * c.value) / ({_EPS}), 6) AS score
            FROM {questions} q JOIN cv c USING (bucket) GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {scored} WHERE score >= 0.5
        ), hits AS (SELECT query_id, rank, chunk_id, doc_id, content, score FROM ranked JOIN named USING (chunk_id) WHERE rank <= 5)"""


#: Hits of the exact search on fixed-size chunks.
_HITS = f"WITH RECURSIVE {fixed_chunks()}, {_exact_hits()}"


def _preview(x: str, n: int = 200) -> str:
    return f"CASE WHEN len({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END"


def _chunk_rows(strategy: str) -> str:
    return f"""SELECT doc_id::VARCHAR || '_{strategy}_' || chunk_index::VARCHAR AS chunk_id, doc_id, chunk_index, content,
                      len(content)::INT AS chunk_size, (len(content) // 4)::INT AS token_count, '{strategy}' AS strategy FROM chunks"""


def _vector_search(score: str, k: int | None, threshold: float | None = None) -> str:
    limit = f"WHERE rank <= {k}" if k else ""
    floor_ = f"WHERE score >= {threshold}" if threshold is not None else ""
    return f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (
            SELECT q.vec_id AS query_id, e.vec_id AS item_id, round({score}, 6) AS score FROM e q JOIN e ON q.vec_id % 20 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s {floor_})
        SELECT query_id, item_id, score, rank FROM r {limit}"""


_COSINE = (
    "list_inner_product(q.v, e.v) / ((sqrt(list_inner_product(q.v, q.v)) + 1e-8) * (sqrt(list_inner_product(e.v, e.v)) + 1e-8))"
)

_MEASURES = f"""
        SELECT query_id, round(count(*) FILTER (good) / 10.0::DOUBLE, 6) AS precision_at_k,
               round(count(*) FILTER (good) / any_value(total)::DOUBLE, 6) AS recall_at_k,
               round(coalesce(1.0::DOUBLE / min(rank) FILTER (good), 0), 6) AS reciprocal_rank
        FROM (
            SELECT h.query_id, h.rank, a.label = b.label AS good, t.total
            FROM ({_vector_search(_COSINE, 10)}) h JOIN embeddings a ON a.vec_id = h.query_id JOIN embeddings b ON b.vec_id = h.item_id
            JOIN (SELECT label, count(*) AS total FROM embeddings GROUP BY label) t ON t.label = a.label
        ) GROUP BY query_id"""

_SIMILAR = f"""own AS (SELECT doc_id, list_sort(list_distinct({_words("lower(coalesce(text, ''))")})) AS w FROM documents),
        cls AS (SELECT w, min(doc_id) AS class_id, count(*) AS size FROM own WHERE len(w) > 0 GROUP BY w),
        prs AS (
            SELECT least(a.class_id, b.class_id) AS doc_a, greatest(a.class_id, b.class_id) AS doc_b,
                   len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity
            FROM cls a JOIN cls b ON (len(a.w), a.class_id) < (len(b.w), b.class_id) AND len(a.w) >= 0.8::DOUBLE * len(b.w) - 1e-9
            WHERE similarity >= 0.8::DOUBLE
        )"""

_TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text, b.text AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"

_PARTS = """
        p AS (
            SELECT *, p_name || ' ' || (p_partkey // 20)::VARCHAR AS item, 'size ' || p_size::VARCHAR AS size, (p_retailprice - 900) / 100 AS confidence,
                   CASE p_type WHEN 'ECONOMY' THEN 'USES' WHEN 'SMALL' THEN 'IMPROVES' WHEN 'MEDIUM' THEN 'ENABLES' WHEN 'PROMO' THEN 'RELATED_TO' ELSE 'DEVELOPS' END AS kind
            FROM part
        ),
        rel AS (
            SELECT p_brand AS src, item AS dst, kind AS relation_type, confidence, p_partkey * 4 AS seq FROM p
            UNION ALL SELECT item, p_type, 'PART_OF', confidence, p_partkey * 4 + 1 FROM p
            UNION ALL SELECT item, size, 'USES', confidence, p_partkey * 4 + 2 FROM p
            UNION ALL SELECT p_type, size, 'RELATED_TO', confidence, p_partkey * 4 + 3 FROM p
        ),
        vertices AS (
            SELECT name, entity_type, count(*) AS chunk_count, confidence FROM (
                SELECT p_brand AS name, 'ORGANIZATION' AS entity_type, 0.9::DOUBLE AS confidence FROM p UNION ALL SELECT item, 'PRODUCT', 0.6 FROM p
                UNION ALL SELECT p_type, 'CONCEPT', 0.8 FROM p UNION ALL SELECT size, 'TECHNOLOGY', 0.7 FROM p
            ) GROUP BY ALL
        ),
        edges AS (SELECT src, dst, relation_type, arg_max(confidence, seq) AS confidence FROM rel GROUP BY ALL),
        step AS (SELECT src AS node, dst AS nxt FROM edges UNION SELECT dst, src FROM edges),
        brands AS (SELECT name AS origin FROM vertices WHERE entity_type = 'ORGANIZATION'),
        pair AS (SELECT origin AS source, lead(origin) OVER (ORDER BY origin) AS target FROM brands QUALIFY target IS NOT NULL),
        deg AS (SELECT v.name, count(e.name) AS degree FROM vertices v LEFT JOIN (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) e USING (name) GROUP BY v.name)"""

#: No directed path of the graph is longer than three steps; ``far`` has the length and number of the shortest ones.
_BETWEEN = f"""{_PARTS}, arc AS (SELECT DISTINCT src AS s, dst AS t FROM edges),
        one AS (SELECT s, t, 1 AS d, 1::BIGINT AS ways FROM arc),
        two AS (SELECT a.s, b.t, 2 AS d, count(*) AS ways FROM arc a JOIN arc b ON a.t = b.s WHERE NOT EXISTS (FROM arc c WHERE c.s = a.s AND c.t = b.t) GROUP BY ALL),
        three AS (
            SELECT a.s, b.t, 3 AS d, sum(a.ways)::BIGINT AS ways FROM two a JOIN arc b ON a.t = b.s
            WHERE NOT EXISTS (FROM arc c WHERE c.s = a.s AND c.t = b.t) AND NOT EXISTS (FROM two c WHERE c.s = a.s AND c.t = b.t) GROUP BY ALL
        ),
        far AS (FROM one UNION ALL FROM two UNION ALL FROM three),
        share AS (
            SELECT a.t AS name, sum(a.ways * b.ways / c.ways::DOUBLE) AS share
            FROM far a JOIN far b ON a.t = b.s JOIN far c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY ALL
        ),
        btw AS (SELECT name, coalesce(share, 0) / ((count(*) OVER () - 1) * (count(*) OVER () - 2)) AS betweenness FROM vertices LEFT JOIN share USING (name)),
        imp AS (
            SELECT name, round((0.6::DOUBLE * (degree / (count(*) OVER () - 1)::DOUBLE) + 0.4::DOUBLE * betweenness) * confidence, 6) AS importance
            FROM deg JOIN btw USING (name) JOIN vertices USING (name)
        )"""

_NEAR_PART = """near AS (
            SELECT origin, node, min(distance)::INT AS distance FROM (
                SELECT b.origin, s.nxt AS node, 1 AS distance FROM brands b JOIN step s ON s.node = b.origin
                UNION ALL
                SELECT b.origin, t.nxt, 2 FROM brands b JOIN step s ON s.node = b.origin JOIN step t ON t.node = s.nxt
            ) WHERE node <> origin GROUP BY ALL
        )"""
_NEAR = f"{_PARTS}, {_NEAR_PART}"
_NEAR_IMPORTANT = f"{_BETWEEN}, {_NEAR_PART}"

_SHORTEST = f"""{_PARTS}, known AS (
            SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(confidence, seq) AS c FROM rel GROUP BY ALL
        ), steps AS (SELECT node, nxt, c FROM step JOIN known ON lo = least(node, nxt) AND hi = greatest(node, nxt) WHERE node <> nxt),
        l0 AS (SELECT origin, origin AS node, [origin] AS path, 0::DOUBLE AS total FROM brands)"""
for _n in (1, 2, 3):
    _seen = " AND ".join(f"NOT EXISTS (FROM l{_m} s WHERE s.origin = f.origin AND s.node = t.nxt)" for _m in range(_n))
    _SHORTEST += f""", l{_n} AS (
            SELECT f.origin, t.nxt AS node, min(list_append(f.path, t.nxt)) AS path, arg_min(f.total + t.c, list_append(f.path, t.nxt)) AS total
            FROM l{_n - 1} f JOIN steps t ON t.node = f.node WHERE {_seen} GROUP BY ALL
        )"""

_PATHS = f"""{_PARTS}, found AS (
            SELECT source, target, [source, target] AS path FROM pair JOIN step ON node = source AND nxt = target
            UNION ALL
            SELECT source, target, [source, a.nxt, target] FROM pair JOIN step a ON a.node = source JOIN step b ON b.node = a.nxt AND b.nxt = target
            WHERE a.nxt NOT IN (source, target)
            UNION ALL
            SELECT source, target, [source, a.nxt, b.nxt, target] FROM pair JOIN step a ON a.node = source JOIN step b ON b.node = a.nxt JOIN step c ON c.node = b.nxt AND c.nxt = target
            WHERE a.nxt NOT IN (source, target) AND b.nxt NOT IN (source, target, a.nxt)
        )"""

_TRIANGLES = f"""{_PARTS},
        clus AS (
            SELECT name, coalesce(round(t.n::DOUBLE / (k.k * (k.k - 1)), 6), 0) AS clustering FROM vertices
            LEFT JOIN (SELECT node, count(*) AS k FROM step GROUP BY node) k ON k.node = name
            LEFT JOIN (SELECT a.node, count(*) AS n FROM step a JOIN step b ON a.node = b.node AND a.nxt <> b.nxt
                       JOIN step c ON c.node = a.nxt AND c.nxt = b.nxt GROUP BY a.node) t ON t.node = name
        ),
        reach(name, other) AS (SELECT name, name FROM vertices UNION SELECT r.name, s.nxt FROM reach r JOIN step s ON s.node = r.other)"""

_METRICS = """
        m AS (
            SELECT event_type AS rag_name, user_id::VARCHAR AS query_id, (f % 97) / 100.0::DOUBLE AS retrieval_time, (f % 89) / 50.0::DOUBLE AS generation_time,
                   (f % 97) / 100.0::DOUBLE + (f % 89) / 50.0::DOUBLE AS total_time, (f % 101) / 100.0::DOUBLE AS confidence_score,
                   (f % 6)::INT AS chunks_retrieved, (f % 1999)::INT AS response_length, f % 17 = 0 AS failed
            FROM (SELECT event_type, user_id, min(event_id) AS f FROM events GROUP BY ALL)
        ),
        ok AS (SELECT * FROM m WHERE NOT failed),
        sc AS (
            SELECT query_id, rag_name, round(
                CASE WHEN top > 0 THEN 0.6::DOUBLE * confidence_score / top ELSE 0 END
                + CASE WHEN low > 0 THEN 0.3::DOUBLE * low / total_time ELSE 0 END
                + CASE WHEN longest > 0 THEN 0.1::DOUBLE * least(1.0::DOUBLE, response_length / greatest(1000.0::DOUBLE, 0.7::DOUBLE * longest)) ELSE 0 END, 6) AS score
            FROM (SELECT *, max(confidence_score) OVER q AS top, min(total_time) OVER q AS low, max(response_length) OVER q AS longest FROM ok WINDOW q AS (PARTITION BY query_id))
        ),
        won AS (SELECT query_id, rag_name AS winner, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rag_name) = 1),
        own AS (
            SELECT rag_name, avg(total_time) AS mt, avg(confidence_score) AS mc, count(*) AS n,
                   (SELECT count(*) FROM won WHERE winner = rag_name) / (SELECT count(DISTINCT query_id) FROM m)::DOUBLE AS wr
            FROM ok GROUP BY rag_name
        ),
        sm AS (SELECT rag_name, round(mt, 6) AS mean_time, round(mc, 6) AS mean_confidence, round(coalesce(1 / nullif(mt, 0), 0), 6) AS queries_per_second, round(wr, 6) AS win_rate, n FROM own)"""

_LONG = " UNION ALL ".join(
    f"SELECT rag_name, '{c}' AS metric, {c}::DOUBLE AS value FROM ok"
    for c in ("retrieval_time", "generation_time", "total_time", "confidence_score", "chunks_retrieved", "response_length")
)


def _extreme(column: str, direction: str) -> str:
    return f"(array_agg(rag_name ORDER BY {column} {direction}, rag_name))[1]"


def _summary(x: str) -> str:
    parts = f"string_split({x}, '. ')"
    first = f"{parts}[1:2]"
    lines = f"list_transform(string_split({x}, chr(10)), lambda s: {_strip('s')})"
    marked = r"(starts_with(s, '#') OR starts_with(s, '**') OR (regexp_matches(s, '\p{Lu}') AND NOT regexp_matches(s, '\p{Ll}')))"
    heading = f"list_filter({lines}, lambda s: {marked} AND NOT contains(array_to_string({first}, ' '), s))[1:1]"
    joined = f"array_to_string(list_concat({first}, {heading}), '. ')"
    return f"CASE WHEN len({parts}) <= 3 THEN {x} WHEN ends_with({joined}, '.') THEN {joined} ELSE {joined} || '.' END"


_SECTIONS = f"""WITH RECURSIVE {fixed_chunks()}, {semantic_chunks(800, 100, 200, "sections")}"""

_TREE = f"""{_SECTIONS}, cw AS (SELECT doc_id, chunk_index, content, list_distinct({_words("lower(content)")}) AS w FROM chunks),
        sw AS (SELECT doc_id, chunk_index AS section_index, list_distinct({_words("lower(content)")}) AS w FROM sections),
        assigned AS (
            SELECT doc_id, c.chunk_index, section_index, c.content FROM cw c JOIN sw s USING (doc_id)
            QUALIFY row_number() OVER (PARTITION BY doc_id, c.chunk_index ORDER BY len(list_intersect(c.w, s.w)) DESC, section_index) = 1
        ), nodes AS (
            SELECT doc_id::VARCHAR || '_doc' AS node_id, doc_id, 0 AS level, NULL::VARCHAR AS parent_id, 0 AS seq, content, {_summary("content")} AS summary FROM cleaned
            UNION ALL
            SELECT doc_id::VARCHAR || '_sec_' || chunk_index::VARCHAR, doc_id, 1, doc_id::VARCHAR || '_doc', chunk_index, content, {_summary("content")} FROM sections
            UNION ALL
            SELECT doc_id::VARCHAR || '_chunk_' || chunk_index::VARCHAR, doc_id, 2, doc_id::VARCHAR || '_sec_' || section_index::VARCHAR, chunk_index, content, NULL FROM assigned
        )"""

_STAGES = f"""{_TREE}, {_embedded("nodes", "node_id", "content", "nv")}, {_embedded("benchmark", "item_id", "text", "qv")}, scored AS (
            SELECT q.item_id AS query_id, n.node_id, round(sum(q.value * n.value) / ({_EPS}), 6) AS score FROM qv q JOIN nv n USING (bucket) GROUP BY ALL
        ), one AS (
            SELECT query_id, node_id, doc_id, level, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS rank
            FROM scored JOIN nodes USING (node_id) WHERE level < 2 AND score >= 0.5 QUALIFY rank <= 10
        ), par AS (SELECT query_id, doc_id, min(score) AS parent_similarity, count(*) AS times FROM one GROUP BY ALL), two AS (
            SELECT p.query_id, n.node_id AS chunk_id, doc_id, coalesce(s.score, 0) AS similarity, parent_similarity, times,
                   round(0.7::DOUBLE * coalesce(s.score, 0) + 0.3::DOUBLE * parent_similarity, 8) AS score
            FROM par p JOIN nodes n USING (doc_id) LEFT JOIN scored s ON s.query_id = p.query_id AND s.node_id = n.node_id WHERE n.level = 2
        ), rep AS (SELECT *, unnest(range(0, times)) AS copy FROM two),
        top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, doc_id, score, similarity, parent_similarity FROM two WHERE score >= 0.4 QUALIFY rank <= 5)"""

#: Both searches beside each other, for the job that compares them: ends with top and hits.
SYSTEMS_SQL = f"{_STAGES}, {_exact_hits('vq', 'vanilla_scored')}"


def vector_texts(source: str, key: str, text: str) -> str:
    """CTEs up to ``vectors(key, vector)``: the whole unit vector in millionths, joined by commas."""
    return f"""{_embedded(source, key, text, "v")}, vectors AS (
            SELECT {key}, string_agg(coalesce(round(value * 1000000)::BIGINT, 0)::VARCHAR, ',' ORDER BY b.bucket) AS vector
            FROM (SELECT {key}, unnest(range(64))::INT AS bucket FROM {source}) b LEFT JOIN v USING ({key}, bucket) GROUP BY {key}
        )"""


ORACLES: dict[str, str] = {
    "summaries": f"SELECT doc_id, {_summary('text')} AS summary FROM documents",
    "hierarchy_nodes": f"{_TREE} SELECT node_id, doc_id, level, parent_id, seq, content, summary FROM nodes",
    "hierarchy_children": f"{_TREE} SELECT parent_id, string_agg(node_id, ',' ORDER BY seq, node_id) AS children_ids FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "hierarchy_stage_one": f"{_STAGES} SELECT node_id, query_id, score, rank, doc_id, level FROM one",
    "hierarchy_retrieve": f"{_STAGES} SELECT query_id, rank, chunk_id, doc_id, score, similarity, parent_similarity FROM top",
    "hierarchy_retrieve_repeats": f"""{_STAGES} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, doc_id, score, similarity, parent_similarity
        FROM rep WHERE score >= 0.4 QUALIFY rank <= 5""",
    "hierarchy_coverage": f"""{_STAGES} SELECT query_id, doc_id, count(*) AS chunks, round(avg(score), 9) AS avg_similarity, round(avg(similarity), 9) AS avg_hierarchical FROM top GROUP BY ALL""",
    "clean_text": f"WITH {CLEANED} SELECT doc_id, content FROM cleaned",
    "doc_profile": f"""WITH {CLEANED} SELECT doc_id, len({_words("content")})::INT AS word_count, (len(content) // 4)::INT AS token_count,
        len({_sentences("content")})::INT AS sentences, {_preview("content", 60)} AS preview,
        CASE WHEN len(content) // 4 <= 20 THEN content ELSE substr(content, 1, 80) END AS truncated FROM cleaned""",
    "document_ids": f"""WITH {CLEANED} SELECT doc_id, 'doc_' || substr(md5('/docs/' || doc_id::VARCHAR || '.txt'), 1, 8) || '_' || substr(md5(content), 1, 8) AS document_id FROM cleaned""",
    "sentences": f"""WITH {CLEANED}, s AS (SELECT doc_id, {_sentences("content")} AS s FROM cleaned)
        SELECT doc_id, unnest(range(0, len(s)))::INT AS seq, unnest(s) AS sentence FROM s""",
    "split_text": f"""
        WITH a AS (SELECT doc_id, CASE WHEN len(text) <= 200 THEN [text] ELSE list_filter(list_transform(string_split(text, chr(10)), lambda s: {_strip("s")}), lambda s: s <> '') END AS p
                   FROM documents WHERE text <> ''),
        b AS (SELECT doc_id, list_filter(flatten(list_transform(p, lambda x: CASE WHEN len(x) <= 200 THEN [x] ELSE
                list_filter(list_transform(string_split(x, '. '), lambda s: {_strip("s")}), lambda s: s <> '') END)), lambda s: {_strip("s")} <> '') AS p FROM a)
        SELECT doc_id, unnest(range(0, len(p)))::INT AS seq, unnest(p) AS part FROM b""",
    "jaccard_turns": f"""WITH {_TURNS}, w AS (SELECT conv_id, turn, list_distinct({_words("lower(text)")}) AS a, list_distinct({_words("lower(reply)")}) AS b FROM turns)
        SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS similarity FROM w""",
    "similar_pairs": f"WITH {_SIMILAR} SELECT doc_a, doc_b, round(similarity, 6) AS similarity FROM prs",
    "similar_counts": f"""WITH {_SIMILAR}, lnk AS (
            SELECT class_id, sum(size) AS others FROM (
                SELECT doc_a AS class_id, size FROM prs JOIN cls ON cls.class_id = doc_b UNION ALL SELECT doc_b, size FROM prs JOIN cls ON cls.class_id = doc_a
            ) GROUP BY class_id
        )
        SELECT doc_id, coalesce(c.class_id, doc_id) AS class_id, coalesce(size - 1 + coalesce(others, 0), 0)::BIGINT AS n_links
        FROM own LEFT JOIN cls c USING (w) LEFT JOIN lnk ON lnk.class_id = c.class_id""",
    "json_profile": """SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' END AS json_type,
        array_to_string(json_keys(props), ',') AS json_keys, len(json_keys(props))::INT AS json_length FROM events""",
    "json_fields": """SELECT event_id, j.fullkey[3:] AS path, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, j.atom->>'$' AS value
        FROM events e, json_tree(e.props) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')""",
    "chunk_fixed": f"WITH RECURSIVE {fixed_chunks()} {_chunk_rows('fixed_size')}",
    "chunk_semantic": f"WITH RECURSIVE {CLEANED}, {semantic_chunks(400, 50, 100)} {_chunk_rows('semantic')}",
    "chunk_overlapping": f"""WITH {CLEANED}, w AS (
            SELECT doc_id, pos AS part, trim(substr(content, pos + 1, 512)) AS content
            FROM (SELECT doc_id, content, unnest(range(0, greatest(1, len(content) - 50), 462)) AS pos FROM cleaned WHERE content <> '')
        ), chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chunk_index, content FROM w WHERE content <> '')
        {_chunk_rows('overlapping')}""",
    "chunk_stats": f"""WITH RECURSIVE {fixed_chunks()}, r AS ({_chunk_rows('fixed_size')})
        SELECT count(*) AS total_chunks, sum(chunk_size)::BIGINT AS total_characters, sum(token_count)::BIGINT AS total_tokens, round(avg(chunk_size), 6) AS avg_chunk_size,
               min(chunk_size) AS min_chunk_size, max(chunk_size) AS max_chunk_size, 'fixed_size' AS strategies FROM r""",
    "hash_embed": f"""WITH {CLEANED}, {_embedded("cleaned", "doc_id", "content", "v")} SELECT doc_id, bucket, round(value, 6) AS value FROM v""",
    "vector_cache": """
        WITH d AS (SELECT coalesce(text, '') AS t FROM documents), b AS (SELECT t FROM d UNION ALL SELECT coalesce(text, '') FROM conversations),
        s AS (
            SELECT 'first' AS load, count(*) AS n_rows, count(DISTINCT t) AS n_texts, count(DISTINCT t) AS n_embedded FROM d
            UNION ALL
            SELECT 'second', count(*), count(DISTINCT t), count(DISTINCT t) FILTER (t NOT IN (SELECT t FROM d)) FROM b
        )
        SELECT load, n_rows, n_texts, n_embedded, round(1 - n_embedded / n_rows, 6) AS hit_rate FROM s""",
    "embed_once": f"""SELECT doc_id, CASE WHEN len({_words("text")}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents""",
    "cosine_topk": _vector_search(_COSINE, 5),
    "dot_topk": _vector_search("list_inner_product(q.v, e.v)", 5),
    "euclidean_topk": _vector_search("1 / (1 + list_distance(q.v, e.v))", 5),
    "cosine_threshold": _vector_search(_COSINE, None, 0.4),
    "normalized_vectors": """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2 + 1) AS v FROM embeddings)
        SELECT vec_id, unnest(range(0, len(v)))::INT AS i, round(unnest(v) / sqrt(list_inner_product(v, v)), 6) AS x FROM d""",
    "similarity_columns": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
        SELECT e.vec_id, round({_COSINE}, 6) AS cosine, round(list_inner_product(q.v, e.v), 6) AS dot, round(1 / (1 + list_distance(q.v, e.v)), 6) AS euclidean
        FROM v e JOIN v q ON q.vec_id + 1 = e.vec_id""",
    "retrieval_measures": _MEASURES,
    "mean_measures": f"""SELECT round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(reciprocal_rank), 6) AS mrr FROM ({_MEASURES})""",
    "rouge_turns": f"""WITH {_TURNS}, a AS (SELECT conv_id, turn, unnest({_words("lower(text)")}) AS w FROM turns), b AS (SELECT conv_id, turn, unnest({_words("lower(reply)")}) AS w FROM turns),
        ca AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT conv_id, turn, w, count(*) AS n FROM b GROUP BY ALL),
        s AS (SELECT conv_id, turn, sum(least(ca.n, cb.n))::BIGINT AS s FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL),
        t AS (SELECT conv_id, turn, coalesce(s, 0) AS s, len({_words("text")}) AS m, len({_words("reply")}) AS k FROM turns LEFT JOIN s USING (conv_id, turn))
        SELECT conv_id, turn, coalesce(round(s::DOUBLE / nullif(m, 0), 6), 0) AS precision, coalesce(round(s::DOUBLE / nullif(k, 0), 6), 0) AS recall,
               coalesce(round(2.0::DOUBLE * s / nullif(m + k, 0), 6), 0) AS f1 FROM t""",
    "vanilla_retrieve": f"{_HITS} SELECT query_id, rank, chunk_id, doc_id, score FROM hits",
    "format_context": f"""{_HITS}, p AS (
            SELECT query_id, string_agg(rank::VARCHAR || '. [Source: ' || doc_id::VARCHAR || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS blocks FROM hits WHERE rank <= 2 GROUP BY query_id
        ), q AS (
            SELECT item_id AS query_id, CASE WHEN blocks IS NULL THEN '' ELSE 'Based on the following information:' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' END AS prompt
            FROM benchmark LEFT JOIN p ON p.query_id = item_id
        ) SELECT query_id, prompt, CASE WHEN len(prompt) // 4 <= 50 THEN prompt ELSE substr(prompt, 1, 200) END AS compressed FROM q""",
    "vanilla_answer": f"""{_HITS}, g AS (
            SELECT query_id, count(*) AS n, avg(score) FILTER (score > 0) AS mean,
                   string_agg('Context ' || rank::VARCHAR || ' [Source: ' || doc_id::VARCHAR || ']:' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context,
                   string_agg(rank::VARCHAR || '. ' || {_preview("content")} || ' (similarity: ' || format('{{:.3f}}', score) || ')', chr(10) ORDER BY rank) FILTER (rank <= 3) AS lines,
                   array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ',') AS sources
            FROM hits GROUP BY query_id
        )
        SELECT item_id AS query_id, text AS query, coalesce(context, '') AS context, coalesce(round(least(mean * least(n / 5.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE), 6), 0) AS confidence,
               coalesce(n, 0)::INT AS chunks_retrieved, coalesce(sources, '') AS sources,
               CASE WHEN n IS NULL THEN 'I don''t have enough information to answer your question.' ELSE
                 'Based on the provided context, here''s what I found regarding your query: ''' || text || '''' || chr(10) || chr(10) || 'I found ' || n::VARCHAR || ' relevant pieces of information:' || chr(10) || lines
                 || CASE WHEN n > 3 THEN chr(10) || '... and ' || (n - 3)::VARCHAR || ' more relevant sources.' ELSE '' END || chr(10) || chr(10)
                 || 'Note: This is a demonstration response. In a production system, this would be generated by a language model using the retrieved context.' END AS response
        FROM benchmark LEFT JOIN g ON g.query_id = item_id""",
    "conversation_context": """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context
        FROM conversations""",
    "section_assign": f"""{_SECTIONS}, c AS (SELECT doc_id, chunk_index, list_distinct({_words("lower(content)")}) AS w FROM chunks),
        s AS (SELECT doc_id, chunk_index AS section_index, list_distinct({_words("lower(content)")}) AS w FROM sections)
        SELECT doc_id, c.chunk_index, section_index, len(list_intersect(c.w, s.w))::INT AS overlap FROM c JOIN s USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY doc_id, c.chunk_index ORDER BY overlap DESC, section_index) = 1""",
    "hierarchy_unattached": f"""{_SECTIONS} SELECT doc_id, count(*) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM sections) GROUP BY doc_id""",
    "graph_edges": f"WITH {_PARTS} SELECT src, dst, relation_type, confidence FROM edges",
    "graph_entities_by_type": f"WITH {_PARTS} SELECT name, entity_type, chunk_count, confidence FROM vertices WHERE entity_type = 'PRODUCT' AND confidence >= 0.5",
    "graph_relationships_by_type": f"WITH {_PARTS} SELECT src, dst, relation_type, confidence, seq FROM rel WHERE relation_type = 'IMPROVES' AND confidence >= 0.1",
    "neighbours_k2": f"WITH {_NEAR} SELECT origin, node, distance FROM near",
    "paths_le3": f"WITH {_PATHS} SELECT source, target, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM found",
    "connection_paths": f"""WITH {_PATHS}, st AS (SELECT source, target, path, (len(path) - 1)::INT AS length, unnest(range(1, len(path)))::INT AS step FROM found),
        k AS (SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, arg_min(relation_type, seq) AS relation_type, arg_min(confidence, seq) AS confidence, arg_min(src, seq) AS src FROM rel GROUP BY ALL)
        SELECT source, target, array_to_string(path, '>') AS path, length, step, k.relation_type, k.confidence, CASE WHEN k.src = path[step] THEN 'forward' ELSE 'reverse' END AS direction
        FROM st JOIN k ON lo = least(path[step], path[step + 1]) AND hi = greatest(path[step], path[step + 1])""",
    "subgraph": f"""WITH {_PARTS}, c AS (SELECT origin AS name FROM brands WHERE origin LIKE '%1' UNION SELECT dst FROM edges JOIN brands ON src = origin WHERE origin LIKE '%1')
        SELECT src, dst, relation_type, confidence FROM edges WHERE src IN (FROM c) AND dst IN (FROM c)""",
    "degrees": f"WITH {_PARTS} SELECT name, degree, round(degree / (count(*) OVER () - 1)::DOUBLE, 6) AS degree_centrality FROM deg",
    "importance": f"WITH {_BETWEEN} SELECT name, importance FROM imp",
    "related_entities": f"WITH {_NEAR_IMPORTANT} SELECT origin, node, importance FROM near JOIN imp ON name = node",
    "betweenness": f"WITH {_BETWEEN} SELECT name, round(betweenness, 6) AS betweenness FROM btw",
    "neighbours_typed": f"""WITH {_PARTS}, ts AS (SELECT src AS node, dst AS nxt FROM edges WHERE relation_type IN ('IMPROVES', 'USES') UNION SELECT dst, src FROM edges WHERE relation_type IN ('IMPROVES', 'USES')),
        n AS (SELECT origin, nxt AS node, 1 AS distance FROM brands JOIN ts ON node = origin
              UNION ALL SELECT origin, b.nxt, 2 FROM brands JOIN ts a ON a.node = origin JOIN ts b ON b.node = a.nxt)
        SELECT origin, node, min(distance)::INT AS distance FROM n GROUP BY ALL""",
    "shortest_paths": f"""WITH {_SHORTEST} SELECT origin, node, len(path)::INT - 1 AS length, coalesce(round(total / nullif(len(path) - 1, 0), 6), 1) AS mean_confidence
        FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)""",
    "entity_context": f"""WITH {_NEAR_IMPORTANT}, top AS (
            SELECT origin, node, importance FROM near JOIN imp ON name = node QUALIFY row_number() OVER (PARTITION BY origin ORDER BY importance DESC, node) <= 10
        ), r AS (SELECT origin AS name, string_agg(node, ',' ORDER BY importance DESC, node) AS related FROM top GROUP BY origin)
        SELECT name, entity_type, confidence, chunk_count, importance, related, (SELECT count(*) FROM rel WHERE dst = name) AS incoming,
               (SELECT count(*) FROM rel WHERE src = name AND src <> dst) AS outgoing
        FROM vertices JOIN imp USING (name) JOIN r USING (name) WHERE entity_type = 'ORGANIZATION'""",
    "graph_components": f"""WITH RECURSIVE {_PARTS}, reach(name, other) AS (SELECT name, name FROM vertices UNION SELECT r.name, s.nxt FROM reach r JOIN step s ON s.node = r.other)
        SELECT name, min(other) AS component FROM reach GROUP BY name""",
    "clustering": f"WITH RECURSIVE {_TRIANGLES} SELECT name, clustering FROM clus",
    "graph_statistics": f"""WITH RECURSIVE {_TRIANGLES} SELECT (SELECT count(*) FROM vertices) AS nodes, (SELECT count(*) FROM edges) AS edges,
        (SELECT count(DISTINCT c) FROM (SELECT name, min(other) AS c FROM reach GROUP BY name)) AS connected_components,
        (SELECT round(2.0::DOUBLE * (SELECT count(*) FROM edges) / count(*), 6) FROM vertices) AS avg_degree,
        (SELECT round((SELECT count(*) FROM edges)::DOUBLE / (count(*) * (count(*) - 1)), 6) FROM vertices) AS density,
        (SELECT round(avg(clustering), 6) FROM clus) AS clustering_coefficient""",
    "graph_type_counts": f"""WITH {_PARTS} SELECT 'entity' AS kind, entity_type AS type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM vertices GROUP BY ALL
        UNION ALL SELECT 'relationship', relation_type, count(*), round(avg(confidence), 6) FROM rel GROUP BY relation_type""",
    "graph_drawing_nodes": f"""WITH {_BETWEEN} SELECT name AS id, name AS label, entity_type AS type, confidence, importance, chunk_count * 5 + 10 AS size,
        CASE entity_type WHEN 'ORGANIZATION' THEN '#4ECDC4' WHEN 'PRODUCT' THEN '#DDA0DD' WHEN 'CONCEPT' THEN '#96CEB4' ELSE '#45B7D1' END AS color
        FROM vertices JOIN imp USING (name)""",
    "graph_drawing_edges": f"""WITH {_PARTS} SELECT src AS source, dst AS target, relation_type AS type, confidence, confidence * 3 + 1 AS width,
        CASE relation_type WHEN 'DEVELOPS' THEN '#E74C3C' WHEN 'USES' THEN '#3498DB' WHEN 'PART_OF' THEN '#2ECC71' WHEN 'RELATED_TO' THEN '#95A5A6' WHEN 'IMPROVES' THEN '#F39C12' ELSE '#9B59B6' END AS color FROM rel""",
    "winners": f"WITH {_METRICS} SELECT query_id, winner, score FROM won",
    "comparison_analysis": f"""WITH {_METRICS}, e AS (SELECT *, CASE WHEN chunks_retrieved > 0 THEN confidence_score / chunks_retrieved ELSE 0 END AS eff FROM ok)
        SELECT query_id, {_extreme("total_time", "ASC")} AS fastest_system, {_extreme("total_time", "DESC")} AS slowest_system, round(max(total_time) - min(total_time), 6) AS speed_difference,
               {_extreme("confidence_score", "DESC")} AS highest_confidence_system, {_extreme("confidence_score", "ASC")} AS lowest_confidence_system,
               round(max(confidence_score) - min(confidence_score), 6) AS confidence_spread, {_extreme("eff", "DESC")} AS most_efficient_system, round(max(eff), 6) AS efficiency_score
        FROM e GROUP BY query_id""",
    "aggregate_analysis": f"""WITH {_METRICS}, l AS ({_LONG})
        SELECT rag_name, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
               round(median(value), 6) AS median, count(*) AS count FROM l GROUP BY ALL""",
    "comparison_cube": f"""WITH {_METRICS}
        SELECT ['system_kind', 'system', 'kind', 'all'][grouping(rag_name, kind)::INT + 1] AS level, rag_name AS system, kind, count(*) AS n,
               {", ".join(f"round(avg({c}), 6) AS mean_{c}, round(median({c}::DOUBLE), 6) AS median_{c}" for c in ("total_time", "confidence_score", "chunks_retrieved"))}
        FROM (SELECT *, 'kind ' || (query_id::BIGINT % 3)::VARCHAR AS kind FROM ok) GROUP BY CUBE (rag_name, kind)""",
    "comparison_summary": f"WITH {_METRICS} SELECT rag_name, mean_time, mean_confidence, queries_per_second, win_rate, n FROM sm",
    "rankings": f"""WITH {_METRICS}, l AS ({_LONG}), v AS (
            SELECT 'overall' AS metric, rag_name, round(CASE WHEN max(mean_time) OVER () > 0 THEN 0.3::DOUBLE * (1 - mean_time / max(mean_time) OVER ()) ELSE 0 END
                   + 0.4::DOUBLE * mean_confidence + 0.3::DOUBLE * win_rate, 6) AS value FROM sm
            UNION ALL SELECT metric, rag_name, round(avg(value), 6) FROM l WHERE metric IN ('total_time', 'confidence_score', 'chunks_retrieved', 'response_length') GROUP BY ALL
        ) SELECT metric, rag_name, value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'total_time' THEN value ELSE -value END, rag_name)::INT AS rank FROM v""",
    "last_comparisons": f"""WITH {_METRICS} SELECT query_id, rag_name, total_time, confidence_score, winner FROM m LEFT JOIN won USING (query_id)
        WHERE query_id IN (SELECT DISTINCT query_id FROM m ORDER BY query_id DESC LIMIT 10)""",
    "windowed_events": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL""",
}

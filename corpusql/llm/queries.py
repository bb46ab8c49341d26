"""Queries of this subpackage for the driver's entry file, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.exact_dedup import exact_duplicates
from corpusql.llm.langid import languages
from corpusql.llm.licenses import license_scan, templates
from corpusql.llm.lm import score
from corpusql.llm.mixing import mix
from corpusql.llm.packing import pack
from corpusql.llm.prefix_trie import Encoded, build, encode, graft
from corpusql.llm.simhash import near_duplicates
from corpusql.llm.tokens import token_counts
from corpusql.llm.topk import top_k
from corpusql.llm.toxicity import toxicity
from corpusql.llm.url_rules import Stated, url_verdicts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/lang/doc_id."""
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string"))
    return license_scan(_documents(spark, sf_dir), "doc_id", "text", path, every_term=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score is that of pieces and words learnt from the training fold; that of the pieces alone stands beside it."""
    found = score(_documents(spark, sf_dir), rounds=3).withColumnsRenamed({"score": "piece_score", "adapted_score": "score"})
    return found.select(*[c for c in found.columns if c != "piece_score"], "piece_score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def grafted(conversations: DataFrame) -> Encoded:
    """Each conversation c rebuilt on the first crc32(c) mod 9 turns of c - c % 5."""
    conv = F.col("conv")
    return graft(encode(conversations), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(grafted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("turn_id")


#: What is known of hosts beforehand; these rules label the URLs they fit.
URL_RULES = [Stated("allow", "org", "/"), Stated("block", "example.org", "/es/"), Stated("block", "example.org", "/en/1"), Stated("allow", "com", "/fr/"), Stated("block", "com", "/de/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_token_counts, op4_licenses, op5_packing, op6_language, op7_toxicity, op8_exact_dedup, op9_lm_scores, op10_topk, op11_prefix_trie, op12_url_filters)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_NOTICES = ", ".join(f"({n}, '{name}', '{notice}')" for n, (name, notice) in enumerate(templates()))

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLES: dict[str, str] = {
    "op4_licenses": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, text, '/' || concat_ws('/', source, lang, doc_id::VARCHAR) AS path FROM documents
        ), notice(template, license, words) AS (VALUES {_NOTICES}),
        tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS.format("words")}) AS term FROM notice) GROUP BY ALL),
        df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT row, unnest({_TERMS.format("text")}) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
        w AS (SELECT template, license, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
        seg AS (
            SELECT row, -1 AS part, text AS t FROM d
            UNION ALL
            SELECT row, unnest(range(0, len(p))), unnest(p) FROM (SELECT row, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS p FROM d)
        ),
        sw AS (SELECT row, part, term, count(*) AS tf FROM (SELECT row, part, unnest({_TERMS.format("t")}) AS term FROM seg) GROUP BY ALL),
        sv AS (SELECT row, part, term, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM d)) + 1) AS value FROM sw LEFT JOIN idf USING (term)),
        len AS (SELECT row, part, sqrt(sum(value * value)) AS length FROM sv GROUP BY ALL),
        sim AS (
            SELECT row, part, license, round(sum(value * weight) / any_value(length), 6) AS similarity
            FROM sv JOIN w USING (term) JOIN len USING (row, part) GROUP BY row, part, template, license
        ),
        own AS (
            SELECT row, license, similarity, min(part) OVER (PARTITION BY row) = -1 AS whole FROM sim WHERE similarity >= 0.8
            QUALIFY row_number() OVER (PARTITION BY row ORDER BY similarity DESC, license) = 1
        ),
        f AS (SELECT d.row, doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, similarity, whole FROM d LEFT JOIN own USING (row)),
        ld AS (SELECT dir AS licensed, path AS up_path, license AS up_license, similarity AS up_similarity FROM f WHERE whole
               QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path, license) = 1),
        up AS (
            SELECT dir, ld.* FROM (
                SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS licensed
                FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM f))
            ) JOIN ld USING (licensed) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1
        )
        SELECT doc_id, path, coalesce(license, up_license) AS license, coalesce(similarity, up_similarity) AS similarity,
               CASE WHEN license IS NOT NULL THEN 'own' WHEN up_license IS NOT NULL THEN 'inherited' END AS origin,
               CASE WHEN license IS NOT NULL THEN path ELSE up_path END AS from_path
        FROM f LEFT JOIN up USING (dir)
    """,
    "op2_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS draw
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
            FROM d GROUP BY source
        ), l AS (
            SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT::DOUBLE
                       - 2.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)::BIGINT::DOUBLE)
                      / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT)::DOUBLE AS level
            FROM s
            WINDOW w AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source ASC NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size,
                   CASE WHEN level * weight >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size
                        ELSE (max(level) FILTER (level * weight < 2.0::DOUBLE * source_size) OVER ()) * weight END AS target
            FROM l
        ), r AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies FROM t
        ), f AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0
                           ELSE floor((target / source_size - copies) * 281474976710656.0::DOUBLE)::BIGINT END AS draws_below FROM r
        ), c AS (
            SELECT f.source, seed, abs(sum(CASE WHEN (draw + seed * 8796093022208) & 281474976710655 < draws_below THEN size ELSE 0 END)::BIGINT
                                       + any_value(copies) * any_value(source_size) - any_value(target)) AS missed
            FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, range(32) t(seed) GROUP BY f.source, seed
        ), b AS (
            SELECT source, seed FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY missed, seed) = 1
        ), n AS (
            SELECT doc_id, size, source_size, target,
                   copies + CASE WHEN (draw + seed * 8796093022208) & 281474976710655 < draws_below THEN 1 ELSE 0 END AS n_copies
            FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, size, source_size, target, (size * n_copies)::BIGINT AS taken, n_copies::BIGINT AS n_copies FROM n
    """,
    "op10_topk": """
        WITH e AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.row <> q.row AND len(c.v) = len(q.v)
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32.format('conv_id::VARCHAR')} % 9 AS head FROM t GROUP BY conv_id),
        r AS (
            SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = base WHERE place <= head
            UNION ALL SELECT c.conv_id, 9 + place, role, text FROM c JOIN t USING (conv_id) WHERE place > head
        ), q AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY place) AS turns FROM r GROUP BY conv_id),
        p AS (
            SELECT conv_id, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth, turns[1:depth] AS prefix
            FROM (SELECT conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN q USING (conv_id))
        ), n AS (
            SELECT prefix, depth, min(conv_id) AS node, count(*) AS n_convs, bool_and(length = depth) AS leaf,
                   CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(prefix[-1].text)) END AS saved,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
            FROM p GROUP BY prefix, depth
        ), u AS (SELECT depth - above AS depth, prefix[1:depth - above] AS prefix, above, leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM n)),
        s AS (SELECT prefix, depth, count(*) FILTER (above = 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY prefix, depth)
        SELECT n.node AS conv_id, n.depth, a.node AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s USING (prefix, depth) LEFT JOIN n a ON a.prefix = n.prefix[1:n.depth - 1] AND a.depth = n.depth - 1
    """,
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
}

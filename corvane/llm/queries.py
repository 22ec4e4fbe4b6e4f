"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_leaks
from .hamerly import cluster_vectors
from .html_extract import extract_pages
from .language_id import identify
from .lattice_lm import score_texts
from .line_dedup import line_dedup
from .mixing import mix_sources
from .ngram_jaccard import jaccard_join
from .packing import pack
from .prefix_trie import prefix_trie
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .voronoi_topk import topk_join

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_lines=1, counts=("n_lines", "n_removed"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    found = identify(table(spark, sf_dir, "documents"), training=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(doc_id as string)) % 10 = 0")
    found = score_texts(table(spark, sf_dir, "documents"), training=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "known_score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join(table(spark, sf_dir, "embeddings"))


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_language_id": op6_language_id,
    "op7_lattice_lm": op7_lattice_lm,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_voronoi_topk": op10_voronoi_topk,
    "op11_hamerly_clusters": op11_hamerly_clusters,
    "op12_pivotal_mixing": op12_pivotal_mixing,
    "op13_prefix_trie": op13_prefix_trie,
}

LINES_SQL = """
    SELECT doc_id, k, line, CASE WHEN filled THEN CAST(sum(CAST(filled AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) END AS pos
    FROM (SELECT doc_id, k, line, trim(line, concat(' ', chr(9), chr(13))) <> '' AS filled
          FROM (SELECT doc_id, unnest(range(len(a))) AS k, unnest(a) AS line
                FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM {docs} WHERE text IS NOT NULL)))
"""

LATER_SQL = """
    SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM {lines} WHERE pos IS NOT NULL)
    WHERE nth > 1
"""


def clusters_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Lloyd's rounds, one after another, every distance of each."""
    parts = [f"""
        v AS MATERIALIZED (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v ORDER BY 1 LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
        a{i} AS MATERIALIZED (
            SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) AS nth
                FROM (SELECT vec_id, v, c, CAST(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) + list_inner_product(CAST(m AS DOUBLE[]), CAST(m AS DOUBLE[])) - 2 * list_inner_product(CAST(v AS DOUBLE[]), CAST(m AS DOUBLE[])) AS BIGINT) AS d FROM v, c{i}))
            WHERE nth = 1)""")
        if i < rounds:
            parts.append(f"""
        s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range({dim})) AS j, unnest(v) AS x FROM a{i}) GROUP BY c, j),
        c{i + 1} AS MATERIALIZED (
            SELECT c, coalesce(any_value(l), m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS l FROM s{i} GROUP BY c) USING (c) GROUP BY c, m)""")
    return f"""
        WITH {','.join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)
    """


#: The remainder by 4 of the CRC-32 of a decimal number: eight steps for each of its bytes.
HEAD_SQL = """
    list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST({0} AS VARCHAR), '')]),
        lambda a, x: list_reduce(list_prepend(xor(a, x), CAST(range(8) AS BIGINT[])), lambda b, i: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END))
"""

TRIE_SQL = rf"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, xor({HEAD_SQL.format("conv_id")}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
          UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
    p AS (SELECT conv_id, row_number() OVER o AS depth, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER o AS key, len(regexp_extract_all(text, '[^ 	-
]+')) AS words
          FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
          UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
    n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
          FROM e GROUP BY key, depth),
    k AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
    s AS (SELECT left(key, 64 * a) AS key, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL)
    SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(m.ids) AS ends_sha256
    FROM m JOIN s USING (key) LEFT JOIN n u ON m.depth > 0 AND u.key = left(m.key, 64 * (m.depth - 1))
"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": f"""
        WITH l AS ({LINES_SQL.format(docs="documents")}), g AS ({LATER_SQL.format(lines="l")})
        SELECT l.doc_id, count(l.pos) AS n_lines, count(g.pos) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE g.pos IS NULL), '') AS text
        FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos
        GROUP BY l.doc_id
    """,
    "op10_voronoi_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v d ON d.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_hamerly_clusters": clusters_sql(),
    "op13_prefix_trie": TRIE_SQL,
}

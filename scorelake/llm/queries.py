"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .fingerprints import compare_with_edits
from .html_text import extract_text
from .licenses import license_spans
from .mixing import mixed_positions
from .ngram_join import jaccard_components
from .packing import packed
from .phrases import collocations
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .secrets import secret_spans
from .sharding import assign_shards
from .topk_search import exact_top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_positions(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_source_mixing": op2_source_mixing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.c, x.c) DESC, x.vec_id))::INTEGER AS rank, x.vec_id, list_inner_product(q.c, x.c)::BIGINT AS score
        FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id QUALIFY rank <= 10""",
    "op12_conversation_trie": r"""
        WITH turns AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
          FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (SELECT c AS conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda crc, code: list_reduce(list_prepend(xor(crc, code), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
          FROM (SELECT DISTINCT conv_id AS c FROM turns)),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(crc, 4294967295) % 4 AS h FROM bits),
        chain AS (
          SELECT c.conv_id, 0 AS own, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE place < h
          UNION ALL SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t USING (conv_id) WHERE place >= h),
        steps AS (SELECT conv_id, own, place, role, text, row_number() OVER w AS depth, sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY own, place) OVER w) AS key
          FROM chain WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)),
        seen AS MATERIALIZED (
          SELECT conv_id, depth::BIGINT AS depth, key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, lag(key, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM steps
          UNION ALL SELECT conv_id, 0, '', 0, NULL FROM convs),
        sizes AS (SELECT conv_id, max(depth) AS size FROM seen GROUP BY conv_id),
        nodes AS MATERIALIZED (
          SELECT depth, key, any_value(above) AS above, any_value(words) AS words, min(s.conv_id) AS conv_id, count(*) AS n_convs, bool_and(size = depth) AS leaf,
                 sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (size = depth), '')) AS ends_sha256
          FROM seen s JOIN sizes USING (conv_id) GROUP BY depth, key),
        pairs AS (SELECT DISTINCT a.depth AS depth, a.key AS key, b.depth AS below, b.key AS below_key FROM seen a JOIN seen b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        sums AS (SELECT p.depth, p.key, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, (count(*) FILTER (leaf))::BIGINT AS n_leaves, (count(*) FILTER (below = p.depth + 1))::BIGINT AS n_children
          FROM pairs p JOIN nodes b ON b.depth = below AND b.key = below_key GROUP BY p.depth, p.key)
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = n.above""",
    "op13_phrase_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        grams AS (
          SELECT lang, n, ws[i:i + n - 1] AS ws
          FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS lengths(n))),
        f AS MATERIALIZED (SELECT lang, n, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
        candidates AS (SELECT * FROM f WHERE n > 1),
        parts AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:n], ' ') AS q FROM candidates c JOIN (VALUES (1), (2)) AS firsts(k) ON k < n),
        cuts AS (
          SELECT c.lang, c.phrase, c.n AS size, c.ws, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
          FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM candidates, (VALUES (1), (2)) AS places(i) WHERE n = 3 GROUP BY ALL),
        kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase AND w.size = 2 WHERE longer IS NULL OR 100 * longer < 50 * w.a),
        totals AS (SELECT lang, count(*) AS n FROM grams WHERE n = 1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
        FROM kept JOIN totals t USING (lang) QUALIFY rank <= 2000""",
}

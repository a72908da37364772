"""Queries of the operators over the driver's tables, and their DuckDB SQL.

Every query applies its operator, with production parameters, to the whole
table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import exact_mph, fingerprints, html_cetr, line_winnow, lm_katz, mixing, near_circulant, packing, quality, url_trie
from lexmill.workers import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_katz.score_documents(spark, _table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_trie.read_rules(url_trie.PRODUCTION_LIST), "entry string, action string")
    return url_trie.filter_urls(spark, _table(spark, sf_dir, "pages"), rules)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_circulant.near_dedup_report(spark, _table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_windows(spark, _table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cetr.extract_pages(_table(spark, sf_dir, "pages"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_classes(spark, _table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_mph.exact_dedup_report(spark, _table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_winnow.dedup_lines(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    known = (
        op1_lm_scoring, op2_url_filters, op3_source_mixing, op4_minhash_near_dedup, op5_packing, op6_html_extraction,
        op7_document_fingerprints, op8_quality_classifier, op9_exact_dedup, op10_line_dedup,
    )
    return {f.__name__: f for f in known}


OP2_SQL = r"""
    WITH rules(entry, action) AS (VALUES {rules}),
    urls AS (
        SELECT page_id, url,
            regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)', 1)),
                '^.*@', ''), ':[0-9]*$', ''), '^\.+|\.+$', '', 'g') AS host,
            list_filter(string_split(regexp_replace(regexp_replace(url,
                '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#\s]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS segments
        FROM pages),
    parts AS (
        SELECT *, string_split(host, '.') AS labels FROM urls),
    keys AS (
        SELECT page_id, array_to_string(labels[i:], '.') AS key, len(labels) - i + 1 AS depth
        FROM parts, range(1, len(labels) + 1) t(i)
        UNION ALL
        SELECT page_id, host || '/' || array_to_string(segments[:i], '/'), len(labels) + i
        FROM parts, range(1, len(segments) + 1) t(i)),
    best AS (
        SELECT page_id, max_by(action, depth) AS action, max_by(entry, depth) AS entry, max(depth) AS depth
        FROM keys JOIN rules ON key = entry GROUP BY page_id)
    SELECT page_id, url, coalesce(action, 'allow') AS action, entry, coalesce(depth, 0)::INT AS depth
    FROM pages LEFT JOIN best USING (page_id)""".replace(
    "{rules}", ", ".join(f"('{entry}', '{action}')" for entry, action in url_trie.read_rules(url_trie.PRODUCTION_LIST))
)

OP1_SQL = r"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9_]|[^\x00-\x7F])+') AS words FROM documents),
    tokens AS (
        SELECT r, unnest(list_concat([NULL, '<s>'], words)) AS u, unnest(list_concat(['<s>'], words, [NULL])) AS h, unnest(list_concat(words, ['</s>', NULL])) AS w
        FROM texts WHERE len(words) > 0),
    said AS (SELECT * FROM tokens WHERE w IS NOT NULL),
    uni AS (SELECT w, count(*) AS c FROM said GROUP BY w),
    bi AS (SELECT h, w, count(*) AS c FROM said GROUP BY h, w),
    tri AS (SELECT u, h, w, count(*) AS c FROM said WHERE u IS NOT NULL GROUP BY u, h, w),
    often AS (
        SELECT 1 AS n, c AS r, count(*)::DOUBLE AS m FROM uni WHERE c <= 6 GROUP BY c
        UNION ALL SELECT 2, c, count(*)::DOUBLE FROM bi WHERE c <= 6 GROUP BY c
        UNION ALL SELECT 3, c, count(*)::DOUBLE FROM tri WHERE c <= 6 GROUP BY c),
    common AS (SELECT n, 6 * coalesce(max(m) FILTER (r = 6), 0) / max(m) FILTER (r = 1) AS q FROM often GROUP BY n),
    raw AS (
        SELECT a.n, a.r, ((a.r + 1) * coalesce(b.m, 0) / (a.r * a.m) - q) / (1 - q) AS d, q
        FROM often a LEFT JOIN often b ON a.n = b.n AND b.r = a.r + 1 JOIN common ON common.n = a.n WHERE a.r <= 5),
    disc AS (SELECT n, r, CASE WHEN q < 1 AND d > 0 AND d <= 1 THEN d ELSE 1 END AS d FROM raw),
    total AS (
        SELECT CASE WHEN sum((1 - coalesce(d, 1)) * c) < 1e-9 THEN sum(c) + 1 ELSE sum(c) END::DOUBLE AS t
        FROM uni LEFT JOIN disc ON n = 1 AND r = uni.c),
    p1 AS (SELECT w, uni.c, coalesce(d, 1) * uni.c / t AS p FROM uni CROSS JOIN total LEFT JOIN disc ON n = 1 AND r = uni.c),
    s2 AS (
        SELECT bi.h, bi.w, bi.c, coalesce(d, 1) * bi.c AS s, p1.p AS below FROM bi JOIN p1 USING (w) LEFT JOIN disc ON n = 2 AND r = bi.c),
    h2 AS (
        SELECT h, s, below, CASE WHEN 1 - below < 1e-12 THEN s WHEN u.c - s < 1e-9 THEN u.c + 1 ELSE u.c END AS total
        FROM (SELECT h, sum(s) AS s, sum(below) AS below FROM s2 GROUP BY h) JOIN uni u ON u.w = CASE WHEN h = '<s>' THEN '</s>' ELSE h END),
    p2 AS (SELECT s2.h, s2.w, s2.c, s2.s / total AS p FROM s2 JOIN h2 USING (h)),
    s3 AS (
        SELECT tri.u, tri.h, tri.w, coalesce(d, 1) * tri.c AS s, p2.p AS below
        FROM tri JOIN p2 ON p2.h = tri.h AND p2.w = tri.w LEFT JOIN disc ON n = 3 AND r = tri.c WHERE tri.c >= 2),
    h3 AS (
        SELECT g.u, g.h, s, below, CASE WHEN 1 - below < 1e-12 THEN s WHEN bi.c - s < 1e-9 THEN bi.c + 1 ELSE bi.c END AS total
        FROM (SELECT u, h, sum(s) AS s, sum(below) AS below FROM s3 GROUP BY u, h) g JOIN bi ON bi.h = g.u AND bi.w = g.h),
    scored AS (
        SELECT x.r, x.u IS NOT NULL AND s3.s IS NULL AS backed,
            ln(CASE WHEN s3.s IS NOT NULL THEN s3.s / h3.total
                WHEN h3.s IS NOT NULL THEN (1 - h3.s / h3.total) / (1 - h3.below) * p2.p ELSE p2.p END) AS lp
        FROM said x JOIN p2 ON p2.h = x.h AND p2.w = x.w
        LEFT JOIN s3 ON s3.u = x.u AND s3.h = x.h AND s3.w = x.w LEFT JOIN h3 ON h3.u = x.u AND h3.h = x.h),
    sums AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (backed) AS n_backoff, sum(lp) AS lp FROM scored GROUP BY r)
    SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_backoff, 0) AS n_backoff, round(lp, 4) AS log_prob
    FROM texts LEFT JOIN sums USING (r)"""

OP9_SQL = """
    SELECT min(doc_id) AS doc_id, count(*) AS n_members, 0::BIGINT AS chunk, list_sort(list(doc_id)) AS members
    FROM documents WHERE text IS NOT NULL GROUP BY text
    UNION ALL
    SELECT doc_id, 1::BIGINT, 0::BIGINT, [doc_id] FROM documents WHERE text IS NULL"""


OP10_SQL = r"""
    WITH texts AS (
        SELECT doc_id, text, regexp_extract_all(text, '[^\t\n\v\f\r ]+[\t\n\v\f\r ]*') AS pieces,
            regexp_extract_all(text, '[^\t\n\v\f\r ]+') AS words, regexp_extract(text, '^[\t\n\v\f\r ]*') AS head
        FROM documents),
    runs AS (
        SELECT doc_id, i, md5(array_to_string(words[i:i + 29], ' ')) AS run FROM texts, range(1, len(words) - 28) t(i)),
    later AS (
        SELECT doc_id, i FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
    word AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM texts),
    marked AS (
        SELECT doc_id, i, piece, coalesce(i - max(later.i) OVER (PARTITION BY doc_id ORDER BY i) < 30, false) AS gone
        FROM word LEFT JOIN later USING (doc_id, i)),
    edges AS (
        SELECT *, lag(gone, 1, false) OVER d AS before, lead(gone, 1, false) OVER d AS after FROM marked WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    made AS (
        SELECT doc_id, string_agg(piece, '' ORDER BY i) FILTER (NOT gone) AS kept, count(*) AS n,
            list(i - 1 ORDER BY i) FILTER (gone AND NOT before) AS starts, list(i ORDER BY i) FILTER (gone AND NOT after) AS stops
        FROM edges GROUP BY doc_id)
    SELECT doc_id, head || coalesce(kept, '') AS text, coalesce(n, 0)::INT AS n_words,
        coalesce(flatten(list_transform(list_zip(starts, stops), lambda x: [x[1], x[2]])), [])::INT[] AS removed
    FROM texts LEFT JOIN made USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query, where SQL can express it."""
    return {"op1_lm_scoring": OP1_SQL, "op2_url_filters": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL}

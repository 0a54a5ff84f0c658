"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_model, judge_quality

    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_model(docs, table(spark, sf_dir, "labels")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_quality_rules, op3_near_dedup, op4_packing, op5_html_text, op6_url_filter, op7_language_id,
        op8_substring_dedup, op9_byte_bpe, op10_exact_dedup,
    )
}

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url
        FROM f
    """,
    "op8_substring_dedup": r"""
        WITH marked AS (
          SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?][\x20\x09\x0B-\x0D]+)', '\1' || chr(1), 'g') AS text FROM documents
        ), segments AS (
          SELECT doc_id, unnest(string_split(text, chr(1))) AS segment, generate_subscripts(string_split(text, chr(1)), 1) AS i FROM marked
        ), counted AS (
          SELECT *, translate(trim(regexp_replace(segment, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
          FROM segments
        ), sized AS (
          SELECT *, CASE WHEN norm = '' THEN 0 ELSE length(norm) - length(replace(norm, ' ', '')) + 1 END AS n FROM counted
        ), placed AS (
          SELECT *, coalesce(sum(length(segment)) OVER w, 0) AS s, coalesce(sum((n >= 8)::INT) OVER w, 0) AS u, sum(n) OVER (PARTITION BY doc_id) AS total,
            max(CASE WHEN n > 0 THEN i END) OVER (PARTITION BY doc_id) AS last_word
          FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), named AS (
          SELECT doc_id, i, segment, norm, n, s, CASE WHEN i > last_word THEN max(CASE WHEN i <= last_word THEN u END) OVER (PARTITION BY doc_id) ELSE u END AS u
          FROM placed WHERE total > 0
        ), units AS (
          SELECT doc_id, u, min(s)::BIGINT AS s, sum(n) AS n, string_agg(segment, '' ORDER BY i) AS raw, string_agg(CASE WHEN norm <> '' THEN norm END, ' ' ORDER BY i) AS norm
          FROM named GROUP BY doc_id, u
        ), ranked AS (
          SELECT *, s + length(raw) AS e, first_value(doc_id) OVER w AS kd, first_value(s) OVER w AS ks FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id, s)
        ), later AS (
          SELECT *, u - row_number() OVER (PARTITION BY doc_id ORDER BY u) AS run FROM ranked WHERE doc_id <> kd OR s <> ks
        ), runs AS (
          SELECT doc_id, run, min(s) AS s, max(e) AS e, arg_min(kd, u) AS kd, arg_min(ks, u) AS ks FROM later GROUP BY doc_id, run HAVING sum(n) >= 20
        ), spans AS (
          SELECT doc_id, count(*) AS n, string_agg(s || ',' || e || ',' || kd || ',' || ks, ';' ORDER BY s) AS removed FROM runs GROUP BY doc_id
        ), rest AS (
          SELECT u.doc_id, string_agg(u.raw, '' ORDER BY u.u) AS text
          FROM units u WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = u.doc_id AND u.s >= r.s AND u.s < r.e) GROUP BY u.doc_id
        )
        SELECT d.doc_id, CASE WHEN sp.doc_id IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text,
          coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed_spans
        FROM documents d LEFT JOIN rest r USING (doc_id) LEFT JOIN spans sp USING (doc_id)
    """,
    "op6_url_filter": """
        WITH parsed AS (
          SELECT page_id,
            CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
          FROM pages
        ), split AS (
          SELECT page_id,
            coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM parsed
        ), judged AS (
          SELECT *,
            CASE
              WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/'
            END AS rule,
            len(list_intersect(string_split_regex(host, '[.-]'), ['bets', 'casino', 'pills', 'poker', 'porn', 'viagra', 'xxx'])) > 0 AS listed
          FROM split
        )
        SELECT page_id, host, path, rule,
          CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
               WHEN rule IS NOT NULL THEN 'block'
               WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
          listed
        FROM judged
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
          doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
}

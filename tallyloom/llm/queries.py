"""The corpus operators' queries on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import conversations, exact, media, mixing, packing, quality, secret_scan, simhash, substring_dedup, topk, toxicity, urlfilter, whitening
from tallyloom.llm.common import documents, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.drop_repeated_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"), "n_removed_words")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "text", "copy", "copies", "mix_key")


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_quality_bytenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_documents(documents(spark, sf_dir)))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_quality_bytenet": op6_quality_bytenet,
    "op7_url_filters": op7_url_filters,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_media_columns": op10_media_columns,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

_TARGET_ROWS = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in mixing.TARGETS.items())
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op4_source_mixing": f"""
        WITH targets(pool, weight) AS (VALUES {_TARGET_ROWS}),
        pooled AS (
            SELECT row_number() OVER () AS nth, doc_id, source, text,
                   CASE WHEN source IN (SELECT pool FROM targets WHERE pool <> '*') THEN source ELSE '*' END AS pool
            FROM documents
        ),
        sizes AS (SELECT pool, sum(length(coalesce(text, ''))) AS size FROM pooled GROUP BY pool),
        present AS (SELECT pool, weight, size FROM targets JOIN sizes USING (pool) WHERE size > 0),
        rates AS (SELECT pool, weight / (SELECT sum(weight) FROM present) * (SELECT sum(size) FROM sizes) / size AS rate FROM present),
        means AS (SELECT pool, greatest(1, ceil(rate / {mixing.DRAW_MEAN})) AS draws, rate / greatest(1, ceil(rate / {mixing.DRAW_MEAN})) AS mean FROM rates),
        terms AS (SELECT pool, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS term FROM means, range(0, 100) r(k)),
        cdf AS (SELECT pool, k, least(sum(term) OVER (PARTITION BY pool ORDER BY k), 1.0) AS p FROM terms),
        draws AS (
            SELECT d.*, m.draws, unnest(range(1, CAST(m.draws AS BIGINT) + 1)) AS j FROM pooled d JOIN means m USING (pool)
        ),
        hashed AS (
            SELECT *, CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN j > 1 THEN ':' || j ELSE '' END), 1, 13)
                           AS BIGINT) / 4503599627370496.0::DOUBLE AS u
            FROM draws
        ),
        counted AS (
            SELECT d.nth, d.doc_id, d.source, d.text, count(c.k) AS copies
            FROM hashed d JOIN cdf c ON c.pool = d.pool AND c.p <= d.u
            GROUP BY d.nth, d.doc_id, d.source, d.text
        )
        SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, CAST(copies AS INTEGER) AS copies,
               substr(md5('{mixing.SEED}:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 16) AS mix_key
        FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
    """,
    "op7_url_filters": f"""
        WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
        parsed AS (
            SELECT page_id,
                   CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*(/[^?#]*)', 1) ELSE '' END AS path
            FROM pages
        ),
        matched AS (
            SELECT p.page_id, p.host, p.path, r.verdict, r.host || r.path AS rule,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC, r.verdict DESC) AS place
            FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, '{urlfilter.DEFAULT}') AS verdict FROM matched WHERE place = 1
    """,
    "op11_exact_top_k": f"""
        WITH whole AS (
            SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.nth, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
        ),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}
    """,
}

"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, cotrain, credentials, decontam, langid, order_minhash, substring_dedup, suffix_array, url_templates
from tessera.session import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _dedup_digest(rows: DataFrame) -> DataFrame:
    return rows.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup_digest(substring_dedup.deduplicated(_documents(spark, sf_dir).select("doc_id", "text")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.class_ids(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") != F.col("class_id")).alias("duplicate"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup_digest(suffix_array.deduplicated(_documents(spark, sf_dir).select("doc_id", "text")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.scored(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge(pages).select("row.page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.predict(docs).select(
        "row.doc_id", F.coalesce(langid.held_out("row.doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return credentials.report(docs).select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_order_minhash": op2_order_minhash,
        "op3_suffix_array": op3_suffix_array,
        "op4_quality": op4_quality,
        "op5_decontaminate": op5_decontaminate,
        "op6_url_filter": op6_url_filter,
        "op7_language": op7_language,
        "op8_neighbours": op8_neighbours,
        "op9_bpe": op9_bpe,
        "op10_secrets": op10_secrets,
    }


def _windows_sql(n: int) -> str:
    """Words of windows of n that start in a smaller document too."""
    return f"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), starts AS (
      SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM words WHERE len(w) >= {n} AND doc_id IS NOT NULL
    ), windows AS (
      SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS k FROM starts
    ), least AS (
      SELECT k, min(doc_id) AS d FROM windows GROUP BY k
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j FROM windows JOIN least USING (k) WHERE d < doc_id
    ), lists AS (
      SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' '), '')) AS kept_sha256
    FROM words LEFT JOIN lists USING (doc_id)
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _windows_sql(substring_dedup.WINDOW),
        "op3_suffix_array": _windows_sql(suffix_array.WINDOW),
        "op5_decontaminate": r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), bw AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (
      SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
    ), hits AS (
      SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)
    ), hit AS (
      SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
    ), items AS (
      SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS joined
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    }

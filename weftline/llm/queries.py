"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import codes, trie
from weftline.llm.common import prepare, table


def op1_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import archive_pages, capture_digests

    return capture_digests(archive_pages(table(spark, sf_dir, "pages")))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.sharding import shuffle_into_shards

    return shuffle_into_shards(table(spark, sf_dir, "documents"))


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.lines import line_dedup_digests

    return line_dedup_digests(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _prepared(f)
    for f in (
        op1_hierarchical_language_id,
        op2_simhash_neardup,
        op3_bin_slack_packing,
        op4_collision_counting_ann,
        op5_warc_transactions,
        op6_kneser_ney_toxicity,
        op7_bloom_exact_dedup,
        op8_pivotal_mixing,
        op9_hypergeometric_sharding,
        op10_ownership_secrets,
        op11_vector_code_compression,
        op12_line_dedup,
        op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_vector_code_compression": codes.oracle(),
    "op13_conversation_trie": trie.ORACLE_SQL,
    "op12_line_dedup": """
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM t, unnest(range(1, len(lines) + 1)) AS u(i)),
        m AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM l)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r, doc_id""",
    "op5_warc_transactions": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keep FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN keep <> page_id THEN keep END AS refers_to FROM k""",
    "op7_bloom_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}

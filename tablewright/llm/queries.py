"""The corpus operators as queries over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, embedding_dedup, fingerprints, line_dedup, minhash_dedup, packing, substring_dedup, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how much of it repeats earlier documents, where, and the digest of what stays."""
    done = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return done.select("doc_id", F.size("removed").cast("long").alias("n_spans"), "n_removed", spans.alias("spans"), F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, i, parts[i] AS line, translate(trim(parts[i], {_BLANKS}), {_AZ}) AS key
            FROM split, range(1, len(parts) + 1) AS r(i)),
        common AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AND l.doc_id <> c.keeper AS dropped
            FROM lines l LEFT JOIN common c ON l.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT payload_digest, max(page_id) AS newest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
            CASE WHEN newest IS NULL OR newest = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN newest <> d.page_id THEN newest END AS refers_to
        FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND d.payload_bytes >= 1000""",
    "op5_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
            FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
        reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
        c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
        FROM s LEFT JOIN c ON id = doc_id""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.e = b.e OR list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
        c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON id = vec_id""",
}

"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seshat.llm import chat_hmm, lm_scoring, warc_fixity
from seshat.llm._io import table
from seshat.llm.decontaminate import contaminated
from seshat.llm.hard_negatives import hard_negatives
from seshat.llm.minhash_dedup import near_duplicates
from seshat.llm.mixing import mixture, sizes
from seshat.llm.nn_descent import neighbours
from seshat.llm.private_spans import private_spans
from seshat.llm.secret_forest import scan
from seshat.llm.token_counts import token_counts
from seshat.llm.toxicity import toxicity
from seshat.llm.whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc_fixity.audit(warc_fixity.records(pages), warc_fixity.damaged(pages)).drop("replica_offset")


OP3_SQL = """
WITH bodies AS (
    SELECT page_id, url, html, CASE WHEN page_id % 50 = 3 THEN regexp_replace(html, '[tT]', '7', 'g') ELSE html END AS body,
        page_id % 50 = 11 AS lost
    FROM pages
), texts AS (
    SELECT page_id, lost,
        'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(html) || n || n || html || n || n AS a,
        'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(body) || n || n || body || n || n AS b
    FROM bodies, (SELECT chr(13) || chr(10) AS n)
), placed AS (
    SELECT page_id, page_id >> 12 AS archive, lost, CAST(strlen(a) AS BIGINT) AS record_length, sha256(a) AS digest, sha256(b) AS other,
        CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY page_id >> 12 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset
    FROM texts
)
SELECT page_id, archive, record_offset, record_length, digest, CASE WHEN NOT lost THEN other END AS replica_digest,
    CASE WHEN lost THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE lost OR digest <> other
"""


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    raw = chat_hmm.as_transcripts(turns)
    # one transcript in five is not learned from
    known = raw.where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0)
    return chat_hmm.parse(raw, chat_hmm.fit(known))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives(rows)


OP13_SQL = """
WITH x AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN (SELECT * FROM scores WHERE NOT same) USING (anchor_id)
WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_lm_scoring, op3_warc_fixity, op4_nn_descent, op5_chat_formatting, op6_secret_scans, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_toxicity, op10_token_counts, op11_private_spans, op12_whitening, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_fixity": OP3_SQL, "op13_hard_negatives": OP13_SQL}

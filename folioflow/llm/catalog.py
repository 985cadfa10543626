"""Queries of this subpackage with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, htmltext, langid, neardup, quality, secretscan, substring, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs.where(~langid.held_out("doc_id"))))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_read(spark, sf_dir, "documents")).drop("found")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.rules(docs, quality.fit(docs, quality.trusted_ids(_read(spark, sf_dir, "labels"))))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_read(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_read(spark, sf_dir, "conversations"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_bpe_round_trip, op3_benchmark_decontamination, op4_warc_round_trip, op5_secret_scan, op6_quality_rules, op7_near_duplicates, op8_fuzzy_passages, op9_perspective_rotation, op10_main_text)
    return {f.__name__: f for f in own}


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '{_WORDS}') AS w, regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '{_WORDS}') AS gaps FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_AZ}', '{_az}'), '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM i),
r AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, s, r.size, item_id FROM r JOIN i ON r.run = i.run AND r.size = i.size),
hp AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h)),
hr AS (SELECT doc_id, min(p) AS a, max(p) AS b, count(*) AS n FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hp) GROUP BY doc_id, k),
hs AS (SELECT hr.doc_id, a, n, list_sum(list_transform(gaps[1 : a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1 : a - 1], lambda x: length(x))), 0) AS x,
  list_sum(list_transform(gaps[1 : b], lambda x: length(x))) + list_sum(list_transform(w[1 : b], lambda x: length(x))) AS y FROM hr JOIN d ON hr.doc_id = d.doc_id),
hit AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hit, string_agg(x || ':' || y, ',' ORDER BY a) AS spans FROM hs GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1 AS BIGINT), 1)" for i in range(8) for shift in (15, 10, 5, 0))
_OP4 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""

_OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": _OP3, "op4_warc_round_trip": _OP4, "op7_near_duplicates": _OP7, "op9_perspective_rotation": chat.ORACLE}

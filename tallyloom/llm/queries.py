"""Queries of the operators on training texts, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.blocks import clean_documents, document_blocks
from tallyloom.llm.cooccurrence import associated, cooccurrence, latest_baskets
from tallyloom.llm.encoding import encode
from tallyloom.llm.packing import balance, pack_documents
from tallyloom.llm.pii import personal_information, sanitised
from tallyloom.llm.repetition import repetition_cases, repetition_shares
from tallyloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return document_blocks(table(spark, d, "doc_bodies"), table(spark, d, "sections"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_documents(table(spark, d, "doc_bodies"), table(spark, d, "sections"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return associated(cooccurrence(latest_baskets(table(spark, d, "frontmatter"))))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair, with its lift and log-likelihood ratio."""
    pairs = cooccurrence(latest_baskets(table(spark, d, "frontmatter")))
    return pairs.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition_cases(table(spark, d, "doc_bodies"), table(spark, d, "sections"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition_shares(table(spark, d, "doc_bodies"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "context_windows"))


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    return balance(p9_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(table(spark, d, "documents"), table(spark, d, "name_parts"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return sanitised(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p4_found, p4_pairs, p6_found, p6_shares, p8_ids, p9_packed, p9_balance, p10_found, p10_clean)}

_BASKETS = r"""
WITH last AS (SELECT id, arg_max(tags, ingested_at) AS tags FROM frontmatter WHERE id IS NOT NULL GROUP BY id),
baskets AS (SELECT DISTINCT id, lower(trim(t)) AS tag FROM (SELECT id, unnest(tags) AS t FROM last) WHERE trim(t) <> ''),
single AS (SELECT tag, count(*) AS c FROM baskets GROUP BY tag),
pairs AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM baskets a JOIN baskets b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL
),
judged AS (
  SELECT tag_a, tag_b, n_ab, x.c AS n_a, y.c AS n_b, (SELECT count(*) FROM last) AS n
  FROM pairs JOIN single x ON x.tag = tag_a JOIN single y ON y.tag = tag_b
)"""

SQL = {
    "p4_pairs": _BASKETS
    + """, cells AS (SELECT *, CAST(n_ab AS DOUBLE) AS o, CAST(n_a AS DOUBLE) AS x, CAST(n_b AS DOUBLE) AS y, CAST(n AS DOUBLE) AS w FROM judged),
parts AS (
  SELECT *, o * w / (x * y) AS far,
    2 * (o * ln(o * w / (x * y)) + CASE WHEN x > o THEN (x - o) * ln((x - o) * w / (x * (w - y))) ELSE 0 END
      + CASE WHEN y > o THEN (y - o) * ln((y - o) * w / ((w - x) * y)) ELSE 0 END + CASE WHEN w - x - y + o > 0 THEN (w - x - y + o) * ln((w - x - y + o) * w / ((w - x) * (w - y))) ELSE 0 END) AS g
  FROM cells
)
SELECT tag_a, tag_b, n_ab, n_a, n_b, n, round(far, 6) AS lift, round(CASE WHEN far < 1 THEN -g ELSE g END, 4) AS llr FROM parts""",
    "p4_found": _BASKETS + " SELECT tag_a, tag_b FROM judged WHERE n_ab >= 6 AND 2000 * n_ab >= n AND n_ab * n >= 3 * n_a * n_b",
}

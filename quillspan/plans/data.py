"""Queries of the core data operators over the supplied tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators import quarantine, skew, units
from quillspan.runtime import ship


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.diagnose(_t(spark, d, "raw_records")).select("record_id", "reason").distinct()


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.load_valid(_t(spark, d, "raw_records")).selectExpr(
        "record_id", "docno", "cast(day as string) as day", "section", "length", "text"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = units.to_common_units(_t(spark, d, "doc_numbers"), _t(spark, d, "unit_list"))
    return got.where("amount is not null").select("number_id", "common_unit", "amount").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    postings = _t(spark, d, "postings")
    counts = skew.key_counts(postings, "term")
    total = counts.selectExpr("sum(_n)").first()[0] or 0
    return skew.salted_postings_stats(postings, counts=counts).where(f"n_rows > 0.02 * {total}").select("term")


def p7_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.salted_postings_stats(_t(spark, d, "postings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p3_found, p3_valid, p5_found, p7_found, p7_term_stats)
}

_CSV_OK = r"""regexp_full_match(raw, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')"""
_CSV_FIELDS = r"""regexp_extract_all(',' || raw, '(?s),("(?:[^"]|"")*"|[^",]*)', 1)"""
_TREC = (
    r"(?s)\s*<DOC>\s*<DOCNO>((?:[^<]|<[^/DSLT])*)</DOCNO>\s*<DAY>([^<]*)</DAY>\s*<SECTION>([^<]*)</SECTION>\s*<LENGTH>([^<]*)</LENGTH>"
    r"\s*(?:<TEXT>.*</TEXT>\s*)</DOC>\s*"
)
_TAGS = "</?(?:DOC|DOCNO|DAY|SECTION|LENGTH|TEXT)>"
_ORDER = "<DOC><DOCNO></DOCNO><DAY></DAY><SECTION></SECTION><LENGTH></LENGTH>(?:<TEXT></TEXT>)+</DOC>"

_P3 = rf"""
  WITH a AS (
    SELECT record_id, fmt, raw, raw IS NULL OR NOT regexp_matches(raw, '\S') AS empty,
      fmt = 'csv' AND NOT {_CSV_OK} AS quoting,
      CASE WHEN fmt = 'csv' THEN {_CSV_FIELDS} END AS f,
      fmt = 'trec' AND NOT (regexp_full_match(array_to_string(regexp_extract_all(raw, '{_TAGS}'), ''), '{_ORDER}')
        AND regexp_full_match(raw, '{_TREC}')) AS tags
    FROM raw_records),
  b AS (
    SELECT *, CASE WHEN fmt = 'csv'
      THEN list_transform(f, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END)
      ELSE list_transform(['DOCNO', 'DAY', 'SECTION', 'LENGTH'], lambda t: regexp_extract(raw, '(?s)<' || t || '>(.*?)</' || t || '>', 1))
        || [array_to_string(regexp_extract_all(raw, '(?s)<TEXT>(.*?)</TEXT>', 1), chr(10))] END AS g FROM a),
  c AS (
    SELECT *, list_transform(g, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS h FROM b),
  d AS (
    SELECT *, CASE
      WHEN empty THEN 'empty' WHEN quoting THEN 'quoting' WHEN fmt = 'csv' AND len(f) <> 5 THEN 'columns' WHEN tags THEN 'tags'
      WHEN NOT regexp_full_match(h[1], '[A-Z]{{3}}[0-9]{{6}}-[0-9]{{7}}') THEN 'docno'
      WHEN NOT regexp_full_match(h[2], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(h[2] AS DATE) IS NULL THEN 'day'
      WHEN NOT regexp_full_match(h[4], '[0-9]{{1,9}}') THEN 'length'
      WHEN h[5] = '' THEN 'text' END AS reason FROM c)
"""

ORACLE: dict[str, str] = {
    "p3_found": f"{_P3} SELECT record_id, reason FROM d WHERE reason IS NOT NULL",
    "p3_valid": f"{_P3} SELECT record_id, h[1] AS docno, h[2] AS day, h[3] AS section, h[4]::BIGINT AS length, g[5] AS text FROM d WHERE reason IS NULL",
    "p7_found": """
      SELECT term FROM postings WHERE term IS NOT NULL GROUP BY term
      HAVING count(*) > 0.02 * (SELECT count(term) FROM postings)""",
    "p7_term_stats": """
      SELECT term, count(*) AS n_rows, count(DISTINCT doc_id) AS df, coalesce(sum(tf), 0)::BIGINT AS tf
      FROM postings WHERE term IS NOT NULL GROUP BY term""",
}

"""The same results in SQL over the whole tables, where SQL can express them."""

_IN_FORCE = """(
  SELECT doc_id, kind, key, max_by(tf, tf_at) AS tf FROM (
    SELECT doc_id, kind, key, tf, (coalesce(loaded_at, TIMESTAMPTZ '0001-01-01 00:00:00+00'), tf) AS tf_at
    FROM doc_terms WHERE key IS NOT NULL AND tf IS NOT NULL)
  GROUP BY doc_id, kind, key)"""

_TERMS = f"(SELECT doc_id, lower(key) AS term, sum(tf)::BIGINT AS tf FROM {_IN_FORCE} WHERE kind = 'term' GROUP BY doc_id, lower(key))"

_TOP = f"""(
  SELECT doc_id, key AS entity, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, key DESC) AS r
  FROM {_IN_FORCE} WHERE kind = 'entity')"""

_SIZED = r"""(
  SELECT doc_id, replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '_', '-') AS source,
         coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{Z}\x{1c}-\x{1f}\x{85}\p{L}\p{N}_]+')), 0) AS tokens
  FROM documents)"""

_ENTROPY = f"""
  WITH t AS (SELECT * FROM {_TERMS} WHERE tf >= 1),
  s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf, sum(tf * ln(tf)) AS x FROM t GROUP BY term),
  w AS (SELECT term, df, total_tf, 1 - (ln(total_tf) - x / total_tf) / ln((SELECT count(*) FROM documents_map)) AS weight FROM s)
  SELECT doc_id, term, tf, df, total_tf, weight, ln(1 + tf) * weight AS score FROM t JOIN w USING (term)"""

_MARKED = f"""
  SELECT term, tf, df, CASE WHEN df <= 2 THEN 'rare' WHEN 3 * df > (SELECT count(*) FROM documents_map) THEN 'common' END AS mark
  FROM (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM {_TERMS} GROUP BY term)"""

# Shared runs: every stretch of 200 characters of every text, grouped by its characters.
_WINDOWS = """
  w AS (SELECT doc_id, i, substring(text, i, 200) AS s FROM (
    SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
  sh AS (SELECT s, min(doc_id) AS a FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
  x AS (SELECT doc_id, i - 1 AS i, s, doc_id > a AS again FROM w JOIN sh USING (s)),
  p AS (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT s, doc_id FROM x) a JOIN (SELECT DISTINCT s, doc_id FROM x) b USING (s)
    WHERE a.doc_id < b.doc_id)"""


def _islands(name: str, where: str) -> str:
    return f"""
  {name} AS (SELECT doc_id, min(i) AS i, max(i) + 200 AS j FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
    SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true)::INTEGER AS new FROM (SELECT DISTINCT doc_id, i FROM x WHERE {where}))) GROUP BY doc_id, g)"""


_STRETCHES = f"""{_islands('every', 'true')}, {_islands('later', 'again')},
  cuts AS (SELECT doc_id, i AS start FROM every UNION SELECT doc_id, j FROM every UNION SELECT doc_id, i FROM later UNION SELECT doc_id, j FROM later),
  pieces AS (SELECT doc_id, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM cuts),
  spans AS (SELECT p.doc_id, start, stop - start AS length, l.doc_id IS NOT NULL AS repeated FROM pieces p
    JOIN every e ON e.doc_id = p.doc_id AND e.i <= start AND stop <= e.j LEFT JOIN later l ON l.doc_id = p.doc_id AND l.i <= start AND stop <= l.j)"""

ORACLE: dict[str, str] = {
    "p10_found": f"WITH {_WINDOWS} SELECT * FROM p",
    "p10_links": f"""WITH {_WINDOWS},
      c AS (SELECT text, min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
      l AS (SELECT a AS class_id, count(*) AS n FROM (
        SELECT doc_id_a AS a, doc_id_b AS b FROM p UNION ALL SELECT doc_id_b, doc_id_a FROM p) WHERE a IN (SELECT class_id FROM c) AND b IN (SELECT class_id FROM c) GROUP BY a)
      SELECT doc_id, coalesce(c.class_id, doc_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(n, 0) AS n_links
      FROM documents d LEFT JOIN c ON c.text = d.text LEFT JOIN l ON l.class_id = c.class_id""",
    "p10_spans": f"WITH {_WINDOWS}, {_STRETCHES} SELECT doc_id, start::INTEGER AS start, length::INTEGER AS length, repeated FROM spans",
    "p10_report": f"""WITH {_WINDOWS}, {_STRETCHES},
      s AS (SELECT doc_id, sum(length)::BIGINT AS a, coalesce(sum(length) FILTER (repeated), 0)::BIGINT AS b FROM spans GROUP BY doc_id)
      SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(a, 0) AS shared_chars, coalesce(b, 0) AS repeated_chars,
        coalesce(coalesce(a, 0) / nullif(length(text), 0), 0.0)::DOUBLE AS shared_part FROM documents LEFT JOIN s USING (doc_id)""",
    "p10_lines": r"""
      WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
      o AS (SELECT doc_id, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS length,
        trim(regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', ' ', 'g')) AS unit FROM l),
      u AS (SELECT *, md5(unit) AS digest FROM o WHERE length(unit) >= 40),
      f AS (SELECT digest, min({'d': doc_id, 's': start}) AS first FROM u GROUP BY digest HAVING count(*) > 1)
      SELECT doc_id, start, length, first.d AS first_doc_id, first.s AS first_start, NOT (doc_id = first.d AND start = first.s) AS repeated FROM u JOIN f USING (digest)""",

    "p1_found": f"SELECT doc_id, entity FROM {_TOP} WHERE r <= 5",
    "p1_document_map": f"""
      SELECT doc_id, name, max_tf, length, coalesce(l, '') AS dominant_entities
      FROM documents_map LEFT JOIN (
        SELECT doc_id, string_agg(entity || ':' || tf, '; ' ORDER BY r) AS l FROM {_TOP} WHERE r <= 5 GROUP BY doc_id) USING (doc_id)""",
    "p4_found": f"""
      WITH t AS (SELECT * FROM {_TERMS}), s AS (SELECT term, count(*) AS df FROM t GROUP BY term)
      SELECT doc_id, term FROM t JOIN s USING (term) JOIN documents_map USING (doc_id)
      WHERE length >= 40 AND tf / length * log10((SELECT count(*) FROM documents_map) / df) >= 0.25""",
    "p4_log_entropy": f"""
      SELECT doc_id, term, tf, df, total_tf, round(weight, 6) + 0.0 AS weight, round(score, 6) + 0.0 AS score FROM ({_ENTROPY})""",
    "p6_found": f"SELECT term, mark FROM ({_MARKED}) WHERE mark IS NOT NULL",
    "p6_dictionary": _MARKED,
    "p6_text_grams": r"""
      WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
      g AS (
        SELECT doc_id, 1 AS n, unnest(w) AS gram FROM t
        UNION ALL
        SELECT doc_id, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM t WHERE len(w) > 1)
      SELECT n, gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY n, gram""",
    "p8_found": f"SELECT doc_id FROM {_SIZED} WHERE tokens > 512",
    "p8_placed": f"""SELECT doc_id, tokens AS n_tokens, ceil(tokens / 512)::BIGINT AS n_parts, tokens AS placed_tokens, false AS wrong FROM {_SIZED}""",
    "p9_targets": rf"""
      WITH m AS (SELECT source, CASE WHEN weight > 0 AND NOT isnan(weight) THEN weight ELSE 0 END AS weight, max_repeats FROM mix_targets),
      o AS (SELECT source AS name, sum(tokens)::BIGINT AS own, count(*) AS docs FROM {_SIZED} GROUP BY source),
      t AS (SELECT *, weight / (SELECT sum(weight) FROM m) AS share, (SELECT sum(tokens) FROM {_SIZED}) AS total
        FROM m LEFT JOIN o ON name = replace(lower(regexp_replace(m.source, '^\s+|\s+$', '', 'g')), '_', '-'))
      SELECT source, round(share, 6) AS target_share, coalesce(own, 0) AS own_tokens, coalesce(docs, 0) AS own_documents,
        round(share * total, 3)::DOUBLE AS target_tokens, share * total > max_repeats * coalesce(own, 0) AS short, true AS met FROM t""",
    "p9_found": rf"""
      WITH m AS (SELECT source, CASE WHEN weight > 0 AND NOT isnan(weight) THEN weight ELSE 0 END AS weight, max_repeats FROM mix_targets),
      o AS (SELECT source AS name, sum(tokens) AS own FROM {_SIZED} GROUP BY source)
      SELECT m.source FROM m LEFT JOIN o ON name = replace(lower(regexp_replace(m.source, '^\s+|\s+$', '', 'g')), '_', '-')
      WHERE weight / (SELECT sum(weight) FROM m) * (SELECT sum(tokens) FROM {_SIZED}) > max_repeats * coalesce(own, 0)""",
}

"""The search engine's queries in SQL, written apart from the DataFrame code: tokens, words and numbers as rows."""

from __future__ import annotations

from quillspan.functions import lexicon as L
from quillspan.plans.porter_sql import stems
from quillspan.plans.topics import TOPICS


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _map(table: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN {_list([k for k, v in table.items() if v == out])} THEN {repr(out)}" for out in dict.fromkeys(table.values())) + " END"


def _cut(x: str) -> str:
    return rf"""regexp_replace({x}, '[.,!:"\-|\]?;\\/><\[]+$', '')"""


def _num(x: str) -> str:
    return rf"regexp_full_match({x}, '\d[\d,]*(?:\.[\d,]*)?')"


def _fmt(v: str) -> str:
    return rf"""CASE WHEN isinf({v}) THEN '' ELSE rtrim(rtrim(regexp_extract(printf('%.9f', {v}), '^(\d+\.\d\d\d)', 1), '0'), '.') END"""


_STOP = _list(L.STOP_WORDS)
_SKIP = _list([*L.POSTFIXES, *L.DOLLARS, *L.MONTHS, *L.PERCENTS, *L.DISTANCES, *L.WEIGHTS])
_NUMERIC = r"\d+(?:,\d)*(?:\.\d+)?"
_OK = lambda x: rf"(length({x}) >= 2 AND NOT regexp_full_match({x}, '\d[\d,]*(?:\.[\d,]*)?[KkmMBbTt]'))"


def _rules(text: str, value: str, follow: str, beyond: str, fraction: bool) -> tuple[str, str]:
    """(rule, key) as CASE expressions, first rule that applies."""
    after = f"(CASE WHEN {follow} IN {_list(L.POSTFIXES)} THEN {beyond} ELSE {follow} END)"
    percent = (f"{after} IN {_list(L.PERCENTS)}", "percent", f"({_fmt(value)}) || '%'")
    dollars = (
        f"({after} IN {_list(L.DOLLARS)} OR prev IN {_list(L.DOLLARS)})", "dollars",
        f"CASE WHEN {value} > 1000000 THEN ({_fmt(f'({value} / 1000000)')}) || ' M Dollars' ELSE {text} || ' Dollars' END",
    )
    units = [
        (f"({_map(t, follow)}) IS NOT NULL", n, f"({_fmt(value)}) || ' ' || ({_map(t, follow)})")
        for t, n in ((L.DISTANCES, "distance"), (L.WEIGHTS, "weight"))
    ]
    if fraction:
        chain, rest = [dollars, percent, *units], "fraction"
    else:
        month = f"coalesce({_map(L.MONTHS, 'prev')}, {_map(L.MONTHS, 'nxt')})"
        chain = [
            (f"(length(num) <= 2 OR length(num) = 4) AND ({month}) IS NOT NULL", "date",
             f"CASE WHEN length(num) <= 2 THEN ({month}) || '-' || lpad(num, 2, '0') ELSE num || '-' || ({month}) END"),
            percent, dollars, *units,
            (f"prev IN {_list(L.BETWEEN)} AND nxt IN {_list(L.AND)} AND {_num('next2')}", "between", "num || '-' || next2"),
        ]
        rest = "plain"
    plain = (
        f"CASE WHEN {value} >= 1e9 THEN ({_fmt(f'({value} / 1e9)')}) || 'B' WHEN {value} >= 1e6 THEN ({_fmt(f'({value} / 1e6)')}) || 'M' "
        f"WHEN {value} >= 1e3 THEN ({_fmt(f'({value} / 1e3)')}) || 'K' ELSE {text if fraction else '(' + _fmt(value) + ')'} END"
    )
    rule = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in chain) + f" ELSE '{rest}' END"
    key = "CASE " + " ".join(f"WHEN {t} THEN {k}" for t, _, k in chain) + f" ELSE {plain} END"
    return rule, key


_TIMES = lambda c: f"coalesce({_map(L.POSTFIXES, c)}, 1.0)"
_FR, _FK = _rules("('0 ' || num || nxt)", "fv", "next2", "next3", True)
_PR, _PK = _rules("num", "pv", "nxt", "next2", False)


def chain(p: str, source: str) -> str:
    """CTEs from ``source`` (doc_id, sec, body) to ``{p}bags`` (doc_id, kind, key, tf); ``p`` keeps several chains apart."""
    return rf"""
  {p}clean AS (SELECT doc_id, sec, string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '[{{}}()|@#^&*+=_'']', '', 'g'), ' ') AS toks FROM ({source})),
  {p}tok AS (SELECT doc_id, sec, i, toks[i] AS t, coalesce(toks[i - 1], '') AS t0, coalesce(toks[i + 1], '') AS t1,
      coalesce(toks[i + 2], '') AS t2, coalesce(toks[i + 3], '') AS t3
    FROM (SELECT doc_id, sec, toks, unnest(generate_series(1, len(toks))) AS i FROM {p}clean)),
  {p}num0 AS (SELECT *, regexp_extract_all(t, '{_NUMERIC}') AS ns, string_split_regex(t, '{_NUMERIC}') AS gaps FROM {p}tok WHERE regexp_matches(t, '\d')),
  {p}num1 AS (SELECT *, ns[j] AS num, coalesce(list_sum(list_transform(gaps[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ns[1:j - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(generate_series(1, len(ns))) AS j FROM {p}num0)),
  {p}num2 AS (SELECT *, substring(t, 1, s::BIGINT) AS pre, substring(t, (s + length(num) + 1)::BIGINT) AS suf FROM {p}num1),
  {p}num3 AS (SELECT *, CASE WHEN pre <> '' THEN pre ELSE t0 END AS prev, CASE WHEN suf <> '' THEN suf ELSE t1 END AS r1,
      CASE WHEN suf <> '' THEN t1 ELSE t2 END AS r2, CASE WHEN suf <> '' THEN t2 ELSE t3 END AS r3 FROM {p}num2),
  {p}num AS (SELECT doc_id, sec, (i - 1)::INTEGER AS "at", (j - 1)::INTEGER AS nth, num, prev, {_cut('r1')} AS nxt,
      CASE WHEN {_cut('r1')} <> r1 THEN '' ELSE {_cut('r2')} END AS next2,
      CASE WHEN {_cut('r1')} <> r1 OR {_cut('r2')} <> r2 THEN '' ELSE {_cut('r3')} END AS next3 FROM {p}num3),
  {p}kind AS (SELECT *, instr(nxt, '/') = 1 AND {_num('nxt[2:]')} AS numerator,
      prev <> '' AND instr(prev, '/') = length(prev) AND {_num('prev[:-2]')} AS denominator,
      instr(nxt, '/') > 1 AND {_num("nxt[1:instr(nxt, '/') - 1]")} AND {_num("nxt[instr(nxt, '/') + 1:]")} AS whole FROM {p}num),
  {p}val AS (SELECT *, replace(num, ',', '')::DOUBLE * {_TIMES('nxt')} AS pv,
      CASE WHEN numerator THEN CASE WHEN replace(nxt[2:], ',', '')::DOUBLE = 0 THEN CASE WHEN replace(num, ',', '')::DOUBLE = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END
        ELSE replace(num, ',', '')::DOUBLE / replace(nxt[2:], ',', '')::DOUBLE END END * {_TIMES('next2')} AS fv FROM {p}kind),
  {p}ruled AS (SELECT doc_id, CASE WHEN numerator THEN {_FR} WHEN NOT denominator AND NOT whole THEN {_PR} END AS rule,
      CASE WHEN numerator THEN {_FK} WHEN NOT denominator AND NOT whole THEN {_PK} END AS key FROM {p}val),
  {p}hyph AS (SELECT doc_id, key FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9A-Za-z_]+(?:-[0-9A-Za-z_]+)+')) AS key FROM {p}tok) WHERE {_OK('key')}),
  {p}w0 AS (SELECT doc_id, sec, i, t, regexp_replace(regexp_extract(t1, '^[\p{{L}}\p{{Nd}}-]*'), '-+$', '') AS nw,
      list_filter(regexp_extract_all(regexp_replace(t, '([-$<>])', '\1\1', 'g'), '[-$<]?[\p{{L}}\p{{N}}\p{{M}}_]+[->]?'), lambda x: regexp_full_match(x, '[A-Za-z0-9_]+')) AS ws FROM {p}tok),
  {p}w1 AS (SELECT *, ws[j] AS w FROM (SELECT *, unnest(generate_series(1, len(ws))) AS j FROM {p}w0)),
  {p}w2 AS (SELECT *, w IN {_SKIP} OR {_num('w')} AS skip, regexp_matches(w, '^\p{{Lu}}') AS cap FROM {p}w1),
  {p}w3 AS (SELECT *, NOT skip AND cap AND j = len(ws) AND regexp_matches(t, '(?:^|[^-$<\p{{L}}\p{{N}}\p{{M}}_])[A-Za-z0-9_]+$') AND regexp_matches(nw, '^\p{{Lu}}') AS pair FROM {p}w2),
  {p}w4 AS (SELECT *, pair AND NOT contains(nw, '-') AS eats, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i, j) AS n FROM {p}w3),
  {p}flags AS (SELECT doc_id, sec, regexp_replace(string_agg(CASE WHEN eats THEN 'L' ELSE 'x' END, '' ORDER BY n), 'L.', 'Lc', 'g') AS f FROM {p}w4 GROUP BY doc_id, sec),
  {p}w AS (SELECT w4.* FROM {p}w4 w4 JOIN {p}flags USING (doc_id, sec) WHERE f[n] <> 'c' AND NOT skip),
  {p}words AS (
    SELECT doc_id, lower(w) AS base, cap FROM {p}w WHERE (CASE WHEN cap THEN lower(w) ELSE w END) NOT IN {_STOP} AND {_OK('w')}
    UNION ALL SELECT doc_id, lower(nw), true FROM {p}w WHERE eats AND lower(nw) NOT IN {_STOP} AND {_OK('nw')}),
  {p}bags AS (
    SELECT doc_id, 'term' AS kind, CASE WHEN bool_and(cap) THEN upper(base) ELSE base END AS key, count(*) AS tf FROM {p}words GROUP BY doc_id, base
    UNION ALL
    SELECT doc_id, kind, key, count(*) FROM (
      SELECT doc_id, 'entity' AS kind, upper(w || ' ' || nw) AS key FROM {p}w WHERE pair
      UNION ALL SELECT doc_id, 'term', key FROM {p}hyph
      UNION ALL SELECT doc_id, 'term', key FROM {p}ruled WHERE rule = 'between' AND {_OK('key')}
      UNION ALL SELECT doc_id, 'number', key FROM {p}ruled WHERE rule <> 'between') GROUP BY doc_id, kind, key)"""


def stemmed_chain(p: str, source: str) -> str:
    """:func:`chain` with the words of each document counted by their stems; stems of one letter are left out."""
    own = f"""{stems(f'{p}stem', f'{p}words')},
  {p}stemmed AS (SELECT doc_id, stem AS base, cap FROM {p}words JOIN {p}stem ON word = base WHERE {_OK('stem')}),
  {p}bags AS ("""
    return chain(p, source).replace(f"{p}bags AS (", own).replace(f"FROM {p}words GROUP BY doc_id, base", f"FROM {p}stemmed GROUP BY doc_id, base")


_DOCS = "SELECT doc_id, 0 AS sec, '<TEXT> ' || text || ' </TEXT>' AS body FROM documents WHERE text IS NOT NULL"
_ASKED = "SELECT doc_id, 0 AS sec, '<TEXT>' || text || '</TEXT>' AS body FROM documents WHERE text IS NOT NULL AND doc_id % 100 = 0"
_TAGGED = r"""SELECT doc_id, generate_subscripts(b, 1) AS sec, unnest(b) AS body FROM (
  SELECT record_id AS doc_id, regexp_extract_all(raw, '(?s)<TEXT>.+?</TEXT>') AS b FROM raw_records WHERE fmt = 'trec')"""

_TEXT = f"WITH {chain('', _DOCS)}"


def _index(observed: bool = True) -> str:
    """CTEs from ``bags`` to dict, ent, post, dmap."""
    tf, df = ("sum(tf) - min_by(tf, doc_id)", "min_by(tf, doc_id) + count(*) - 2") if observed else ("sum(tf)", "count(*)")
    late = "AND doc_id <> first_doc" if observed else ""
    return rf"""
  dterm AS (SELECT CASE WHEN bool_or(NOT regexp_matches(key, '^\p{{Lu}}')) THEN lower(key) ELSE upper(key) END AS key, 'term' AS kind, sum(tf)::BIGINT AS tf, count(*) AS df
    FROM (SELECT * FROM bags WHERE kind = 'term') GROUP BY lower(key), upper(key)),
  dnum AS (SELECT key, 'number' AS kind, sum(tf)::BIGINT AS tf, count(*) AS df FROM bags WHERE kind = 'number' GROUP BY key),
  dent AS (SELECT key, 'entity' AS kind, ({tf})::BIGINT AS tf, ({df})::BIGINT AS df, min(doc_id) AS first_doc FROM bags WHERE kind = 'entity' GROUP BY key HAVING count(*) >= 2),
  dict AS (SELECT * FROM dterm UNION ALL SELECT * FROM dnum UNION ALL SELECT key, kind, tf, df FROM dent),
  ent AS (SELECT b.doc_id, b.key, b.tf FROM bags b JOIN dent USING (key) WHERE b.kind = 'entity' {late}),
  post AS (SELECT lower(key) AS term, doc_id, sum(tf)::BIGINT AS tf FROM (
    SELECT key, doc_id, tf FROM bags WHERE kind <> 'entity' UNION ALL SELECT key, doc_id, tf FROM ent) GROUP BY lower(key), doc_id),
  top5 AS (SELECT doc_id, key AS entity, tf, (row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, key DESC))::INTEGER AS place FROM ent QUALIFY place <= 5),
  dmap AS (SELECT d.doc_id, trim(d.docno) AS name, greatest(1, coalesce(m, 1))::BIGINT AS max_tf, coalesce(l, 0)::BIGINT AS length, coalesce(e, []) AS dominant_entities
    FROM documents d LEFT JOIN (SELECT doc_id, max(tf) AS m, sum(tf) AS l FROM bags GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, list({{'entity': entity, 'tf': tf}} ORDER BY place) AS e FROM top5 GROUP BY doc_id) USING (doc_id))"""


_INDEX = f"{_TEXT}, {_index()}"
_INTENDED = f"{_TEXT}, {_index(False)}"

_NORMAL = """
  norm AS (SELECT lower(key) AS lkey, min_by(df, CASE kind WHEN 'entity' THEN 0 WHEN 'term' THEN 1 ELSE 2 END) AS df FROM dict GROUP BY lower(key))"""


def _ranked(weight: str, terms: str, idf_plus: int = 1) -> str:
    """CTEs from the query terms to ``ranked``; ``weight`` is an aggregate per (query, key in small letters)."""
    return f"""
  {chain('q', _ASKED)},
  qt AS ({terms}),
  {_NORMAL},
  weighted AS (SELECT query_id, lower(key) AS lkey, {weight} AS weight FROM qt GROUP BY query_id, lower(key)),
  st AS (SELECT count(*) AS n, avg(length) AS avgdl FROM dmap),
  scored AS (SELECT query_id, p.doc_id, round(sum(weight * log10((n + {idf_plus}) / df) * (2 * p.tf / (p.tf + 1 - 0.3 + 0.3 * length / avgdl))), 6) + 0.0 AS score
    FROM weighted JOIN norm USING (lkey) JOIN post p ON p.term = lkey JOIN dmap USING (doc_id), st GROUP BY query_id, p.doc_id),
  ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= 50)"""


_TERMS = "SELECT doc_id AS query_id, kind, key, tf AS qtf FROM qbags"
_FIRST = "coalesce(" + ", ".join(f"nullif(sum(CASE WHEN kind = '{k}' AND key = lower(key) THEN qtf END), 0)" for k in ("term", "number", "entity", "semantic")) + ", 0)"
_FIRST_ANY = _FIRST.replace(" AND key = lower(key)", "")
_BM25 = f"{_INDEX}, {_ranked(_FIRST, _TERMS)}"

_SIMILAR = """
  wordvec AS (SELECT vec_id, lower(key) AS word, embedding::DOUBLE[] AS v FROM embeddings JOIN (
    SELECT key, row_number() OVER (ORDER BY tf DESC, key) - 1 AS vec_id FROM dterm) USING (vec_id)),
  sim AS (SELECT a.word, (row_number() OVER (PARTITION BY a.word ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.word))::INTEGER AS rank, b.word AS sim,
      round(list_cosine_similarity(a.v, b.v), 6) AS cosine
    FROM wordvec a JOIN wordvec b ON a.word <> b.word WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10)"""
_SIMILAR_ALL = _SIMILAR.replace("WHERE a.vec_id % 100 = 0 ", "")
_EXPANDED = """
  SELECT query_id, 'semantic' AS kind, sim AS key, count(*) AS qtf FROM (
    SELECT doc_id AS query_id, key FROM qbags WHERE kind = 'term') t
  JOIN (SELECT word, sim, row_number() OVER (PARTITION BY word ORDER BY rank) AS r FROM sim WHERE sim IN (SELECT lower(key) FROM dict) QUALIFY r <= 2) s ON t.key = s.word
  GROUP BY query_id, sim"""
_KIND_WEIGHT = "sum(CASE WHEN key = lower(key) THEN qtf ELSE 0 END * CASE kind WHEN 'entity' THEN 0.4 WHEN 'term' THEN 0.4 ELSE 0.1 END)"

_HASH = """(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT"""

_FLAT = "coalesce(array_to_string(list_transform(dominant_entities, lambda x: x.entity || ':' || x.tf), '; '), '')"

_TOPICS = f"""
  WITH file AS (SELECT '{TOPICS.replace("'", "''")}' AS value),
  topic AS (SELECT unnest(string_split(value, '<num> Number:')[2:]) AS t FROM file),
  lines AS (SELECT t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM topic),
  heads AS (SELECT *, CASE WHEN starts_with(line, '<desc> Description:') THEN 'desc' WHEN starts_with(line, '<narr> Narrative: ') THEN 'narr' END AS head FROM lines),
  parts AS (SELECT *, max(CASE WHEN line = '' OR line LIKE '<%' OR line LIKE '%not relevant%' THEN i END) OVER (PARTITION BY t ORDER BY i) AS cut,
    max(CASE WHEN head IS NOT NULL THEN i END) OVER (PARTITION BY t ORDER BY i) AS open FROM heads),
  body AS (SELECT t, string_agg(line || chr(10), '' ORDER BY i) AS b FROM parts WHERE cut = open AND i > open GROUP BY t)
  SELECT regexp_extract(t, '^\\s*(\\d+)', 1)::BIGINT AS query_id, trim(regexp_extract(t, '<title>([^\\n]*)', 1)) || coalesce(b, '') AS text FROM topic LEFT JOIN body USING (t)"""

_NUMBERED = "regexp_extract(docno, '-([0-9]+)$', 1)::BIGINT"
_FILED = f"""SELECT {_NUMBERED} AS doc_id, 0 AS sec, '<TEXT>' || chr(10) || coalesce(text, '') || chr(10) || '</TEXT>' AS body FROM documents"""
_TOPIC_TEXTS = r"""SELECT doc_id, 0 AS sec, '<TEXT>' || docno || regexp_replace(text, '[\r\n<]', ' ', 'g') || chr(10) || '</TEXT>' AS body
  FROM documents WHERE text IS NOT NULL AND doc_id % 100 = 0"""
_BM25_FILED = f"WITH {chain('', _FILED)}, {_index()}, {_ranked(_FIRST, _TERMS)}".replace(_ASKED, _TOPIC_TEXTS).replace(
    "FROM documents d LEFT JOIN", f"FROM (SELECT {_NUMBERED} AS doc_id, docno FROM documents) d LEFT JOIN")
_STEMMED = f"WITH {stemmed_chain('', _DOCS)}"
_BM25_STEMMED = f"{_STEMMED}, {_index()}, {_ranked(_FIRST, _TERMS)}".replace(chain('q', _ASKED), stemmed_chain('q', _ASKED)).replace(
    "(2 * p.tf / (p.tf + 1 - 0.3 + 0.3 * length / avgdl))", "(1.4 * p.tf / (p.tf + 0.4 * (1 - 0.9 + 0.9 * length / avgdl)))")
_END_TO_END = f"{_BM25_FILED} SELECT query_id || ' 0 ' || name || ' 10 9 mt' AS line FROM ranked JOIN dmap USING (doc_id)"

ORACLE: dict[str, str] = {
    "doc_split": "SELECT record_id AS doc_id, unnest(regexp_extract_all(raw, '(?s)<DOC>.+?</DOC>')) AS doc FROM raw_records WHERE fmt = 'trec'",
    "docno_extract": "SELECT record_id AS doc_id, trim(nullif(regexp_extract(raw, '(?s)<DOCNO>(.+?)</DOCNO>', 1), '')) AS docno FROM raw_records WHERE fmt = 'trec' AND raw IS NOT NULL",
    "text_sections": """
      SELECT doc_id, CASE WHEN len(b) > 0 THEN unnest(generate_series(0, greatest(len(b) - 1, 0)))::INTEGER END AS sec, unnest(CASE WHEN len(b) > 0 THEN b ELSE [NULL] END) AS body FROM (
        SELECT record_id AS doc_id, regexp_extract_all(raw, '(?s)<TEXT>.+?</TEXT>') AS b FROM raw_records WHERE fmt = 'trec' AND raw IS NOT NULL)""",
    "clean_text": r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[{}()|@#^&*+=_'']', '', 'g') AS clean FROM documents WHERE text IS NOT NULL",
    "word_tokens": f"{_TEXT} SELECT doc_id, w AS word, count(*) AS n FROM w1 GROUP BY doc_id, w",
    "hyphen_terms": f"{_TEXT} SELECT doc_id, key AS term, count(*) AS n FROM hyph GROUP BY doc_id, key",
    "numeric_tokens": f"{_TEXT} SELECT doc_id, num, count(*) AS n FROM num GROUP BY doc_id, num",
    "number_context": f'{_TEXT} SELECT doc_id, "at", nth, num, prev, nxt AS "next", next2, next3 FROM num',
    "number_format": f"SELECT v AS value, {_fmt('v')} AS text, {_fmt('(v / 1000)')} AS thousands FROM (SELECT DISTINCT l_extendedprice::DOUBLE AS v FROM lineitem)",
    **{
        f"rule_{r}": f"{_TEXT} SELECT doc_id, key, count(*) AS n FROM ruled WHERE rule = '{r}' GROUP BY doc_id, key"
        for r in ("date", "percent", "dollars", "distance", "weight", "between", "plain", "fraction")
    },
    "number_terms": f"{_TEXT} SELECT doc_id, key, tf FROM bags WHERE kind = 'number'",
    "stopword_filter": f"{_TEXT} SELECT doc_id, w AS word, count(*) AS n FROM w2 WHERE (CASE WHEN cap THEN lower(w) ELSE w END) NOT IN {_STOP} GROUP BY doc_id, w",
    "word_number_filter": f"{_TEXT} SELECT doc_id, w AS word, count(*) AS n FROM w2 WHERE NOT skip AND {_OK('w')} GROUP BY doc_id, w",
    "capital_case_fold": f"{_TEXT} SELECT doc_id, key AS term, tf FROM bags WHERE kind = 'term'",
    "entity_pairs": f"{_TEXT} SELECT doc_id, key AS entity, tf FROM bags WHERE kind = 'entity'",
    "doc_term_bags": f"{_TEXT} SELECT doc_id, kind, key, tf FROM bags",
    "tagged_doc_bags": f"WITH {chain('', _TAGGED)} SELECT doc_id, kind, key, sum(tf)::BIGINT AS tf FROM bags GROUP BY doc_id, kind, key",
    "doc_stats": f"{_INDEX} SELECT doc_id, max_tf, length FROM dmap",
    "corpus_stats": f"{_INDEX} SELECT count(*) AS n, sum(length)::BIGINT AS total_len, round(avg(length), 6) AS avgdl FROM dmap",
    "dictionary_terms": f"{_INDEX} SELECT * FROM dterm",
    "dictionary_numbers": f"{_INDEX} SELECT * FROM dnum",
    "dictionary_entities": f"{_INDEX} SELECT key, kind, tf, df FROM dent",
    "dictionary_entities_intended": f"{_INTENDED} SELECT key, kind, tf, df FROM dent",
    "dictionary_lookup": f"""{_INDEX}, a AS (SELECT DISTINCT term AS asked FROM postings WHERE term IS NOT NULL)
      SELECT asked, key, kind, tf, df FROM (SELECT asked, d.*, row_number() OVER (PARTITION BY asked
        ORDER BY CASE WHEN kind = 'entity' THEN 0 WHEN key = asked THEN 1 WHEN key = lower(key) THEN 2 ELSE 3 END, key) AS r FROM a JOIN dict d ON lower(asked) = lower(key)) WHERE r = 1""",
    "dictionary_view": f"{_INDEX} SELECT key AS term, tf FROM dict ORDER BY term",
    "postings": f"{_INDEX} SELECT * FROM post",
    "inverted_file_lines": f"""{_INDEX} SELECT term, part, term || '|' || string_agg(doc_id || ',' || tf, '|' ORDER BY doc_id) AS line FROM (
      SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 100 AS part FROM post) GROUP BY term, part""",
    "inverted_file_round_trip": f"{_INDEX} SELECT * FROM post",
    "dictionary_round_trip": f"{_INDEX} SELECT key, tf, df FROM dict",
    "document_map": f"{_INDEX} SELECT * REPLACE ({_FLAT} AS dominant_entities) FROM dmap",
    "document_map_lines": f"""{_INDEX} SELECT doc_id, doc_id || '|' || name || ',' || max_tf || ',' || length ||
      coalesce(array_to_string(list_transform(dominant_entities, lambda x: ',' || x.entity || ',' || x.tf), ''), '') AS line FROM dmap
      UNION ALL SELECT NULL, (SELECT sum(length)::BIGINT::VARCHAR FROM dmap)""",
    "document_map_round_trip": f"{_INDEX} SELECT * REPLACE ({_FLAT} AS dominant_entities) FROM dmap",
    "dominant_entities": f"{_INDEX} SELECT doc_id, place, entity, tf FROM top5",
    "synonym_cosine_top10": f"{_INDEX}, {_SIMILAR} SELECT * FROM sim",
    "synonym_filter": f"{_INDEX} SELECT DISTINCT lower(d.key) AS word FROM dictionary d WHERE lower(d.key) IN (SELECT lower(key) FROM dict)",
    "query_parse": f"WITH {chain('q', _ASKED)} {_TERMS}",
    "query_hash_ids": f"""SELECT docno, {_HASH} AS query_id FROM (
      SELECT docno, list_reduce(list_transform(string_split(docno, ''), lambda c: ascii(c)::BIGINT), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM documents)""",
    "query_expand": f"{_INDEX}, {chain('q', _ASKED)}, {_SIMILAR} {_EXPANDED}",
    "candidates": f"{_BM25} SELECT query_id, doc_id FROM scored",
    "bm25_unstemmed": f"{_BM25} SELECT * FROM ranked",
    "bm25_intended": f"{_INTENDED}, {_ranked(_FIRST_ANY, _TERMS).replace(chain('q', _ASKED), chain('q', _DOCS + ' AND doc_id % 100 = 0'))} SELECT * FROM ranked",
    "semantic_rank": f"{_INDEX}, {_SIMILAR_ALL}, {_ranked(_KIND_WEIGHT, f'{_TERMS} UNION ALL {_EXPANDED}', 0)} SELECT * FROM ranked",
    "topk_padded": f"""{_BM25}, asked AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 100 = 0 UNION ALL SELECT -1),
      places AS (SELECT query_id, unnest(generate_series(1, 50))::INTEGER AS rank FROM asked)
      SELECT query_id, rank, coalesce(doc_id, 0) AS doc_id FROM places LEFT JOIN ranked USING (query_id, rank)""",
    "run_file": f"{_BM25} SELECT query_id, rank, query_id || ' 0 ' || name || ' 10 9 mt' AS line FROM ranked JOIN dmap USING (doc_id)",
    "result_names_entities": f"""{_BM25} SELECT query_id, rank, doc_id, name, coalesce(array_to_string(e, '; '), '') AS entities FROM ranked JOIN dmap USING (doc_id)
      LEFT JOIN (SELECT doc_id, list(upper(entity) || ' appeared: ' || tf || ' times' ORDER BY tf, entity) AS e FROM top5 GROUP BY doc_id) USING (doc_id)""",
    "index_stats": f"""{_INDEX} SELECT (SELECT count(*) FROM dmap) AS documents, (SELECT count(*) FROM dict WHERE kind <> 'entity') AS terms,
      (SELECT count(*) FROM dent) AS entities, (SELECT count(*) FROM dict) AS dictionary_size, (SELECT count(*) FROM post) AS postings,
      (SELECT sum(length)::BIGINT FROM dmap) AS total_len, (SELECT round(avg(length), 6) FROM dmap) AS avgdl""",
    "topics_parse": _TOPICS,
    "corpus_to_run": _END_TO_END,
    "porter_stem": f"{_TEXT}, words_ AS (SELECT DISTINCT lower(key) AS base FROM bags WHERE kind = 'term'), {stems('stem_', 'words_')} SELECT word, stem FROM stem_",
    "doc_term_bags_stemmed": f"{_STEMMED} SELECT doc_id, kind, key, tf FROM bags",
    "bm25_stemmed": f"{_BM25_STEMMED} SELECT * FROM ranked",
}

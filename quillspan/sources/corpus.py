"""Readers: tagged corpus, stop words, synonyms, topics files, and index files in their text forms."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.plan import pinned

log = logging.getLogger("quillspan")
DOC = r"(?s)<DOC>(.+?)</DOC>"
DOCNO = r"(?s)<DOCNO>(.+?)</DOCNO>"


def split_documents(files: DataFrame, content: str = "value") -> DataFrame:
    """``(raw)``: every ``<DOC>`` element of the files' contents, tags included."""
    return files.select(F.explode(F.regexp_extract_all(content, F.lit(DOC), F.lit(0))).alias("raw"))


def docno(raw: Column, strict: bool = True) -> Column:
    """The first ``<DOCNO>``, trimmed. A document without one is an error, or null where not strict."""
    found = F.regexp_extract(raw, DOCNO, 1)
    missing = F.raise_error(F.lit("the document has no <DOCNO> tag")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(found != "", F.trim(found)).otherwise(missing)


def read_corpus(spark: SparkSession, path: str, strict: bool = True, doc_id: Column | None = None) -> DataFrame:
    """``(doc_id, docno, raw)`` of ``path/X/X`` files (name equal to the folder's).

    ``doc_id`` is a hash of file and place of the document in it, stable between runs and without a global
    count, or what the given expression over ``docno`` says. A path without such files is an error of the reader. Not strict: documents without docno
    have a null one and can be set apart.
    """
    files = spark.read.text(f"{path.rstrip('/')}/*/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("file", "/")
    own = files.where(F.element_at(parts, -1) == F.element_at(parts, -2))
    raw = own.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(DOC), F.lit(0))).alias("at", "raw"))
    named = raw.select("file", "at", docno(F.col("raw"), strict).alias("docno"), "raw")
    return named.select((F.xxhash64("file", "at") if doc_id is None else doc_id).alias("doc_id"), "docno", "raw")


def read_stop_words(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The words of a file, one per line; more than ``most`` are refused. A missing file gives none."""
    try:
        rows = spark.read.text(path).where("value <> ''").limit(most + 1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no stop words: %s does not exist", path)
        return ()
    if len(rows) > most:
        raise ValueError(f"more than {most} stop words")
    return tuple(r[0].strip() for r in rows)


def parse_synonyms(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(word, sims)`` of lines ``word,most similar,next,...``."""
    parts = F.split(line, ",")
    return lines.select(parts[0].alias("word"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("sims"))


def parse_topics(files: DataFrame, content: str = "value") -> DataFrame:
    """``(query_id, text)`` of topics files.

    The text is the title, directly followed by the lines after ``<desc> Description:`` and those after
    ``<narr> Narrative: `` up to an empty or tag line; the narrative also ends before a line that holds ``not relevant``.
    """
    body = F.regexp_replace(F.col(content), "\r\n?", "\n")
    topics = files.select(F.explode(F.slice(F.split(body, r"<num> Number:"), 2, 1 << 30)).alias("t"))
    number = F.regexp_extract("t", r"^\s*(\d+)", 1).cast("int")
    title = F.trim(F.regexp_extract("t", r"<title>([^\n]*)", 1))
    lines = r"((?:[^<\n][^\n]*(?:\n|$))*)"
    desc = F.regexp_extract("t", rf"<desc> Description:[^\n]*\n{lines}", 1)
    # A tag line that ends the narrative's predecessor is read as the next heading only if it is one.
    narr = F.regexp_extract("t", rf"<narr> Narrative: [^\n]*\n{lines}", 1)
    narr = F.regexp_replace(narr, r"(?s)(^|\n)[^\n]*not relevant.*$", "$1")
    closed = lambda c: F.when((c != "") & ~c.endswith("\n"), F.concat(c, F.lit("\n"))).otherwise(c)
    return topics.select(number.cast("long").alias("query_id"), F.concat(title, closed(desc), closed(narr)).alias("text"))


def parse_dictionary(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(key, tf, df)`` of lines ``term|tf|df|pointer``; another number of fields is an error."""
    parts = F.split(line, r"\|")
    checked = F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.lit("the dictionary file is corrupted")).cast("array<string>"))
    return lines.select(checked.alias("p")).select(F.col("p")[0].alias("key"), F.col("p")[1].cast("long").alias("tf"), F.col("p")[2].cast("long").alias("df"))


def parse_document_map(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(doc_id, name, max_tf, length, dominant_entities)`` of lines ``id|name,max_tf,length(,entity,tf)*``, the head line left out.

    Fewer than three or more than thirteen values are an error.
    """
    rows = lines.where(F.col(line).contains("|"))
    head, p = F.split(line, r"\|", 2), F.split(F.split(line, r"\|", 2)[1], ",")
    ok = F.size(p).between(3, 13) & (F.size(p) % 2 == 1)
    checked = F.when(ok, p).otherwise(F.raise_error(F.lit("the document map file is corrupted")).cast("array<string>"))
    at = F.filter(F.sequence(F.lit(3), F.lit(11), F.lit(2)), lambda i: i < F.size("p"))
    pairs = F.transform(at, lambda i: F.struct(F.get("p", i).alias("entity"), F.get("p", i + 1).cast("long").alias("tf")))
    return rows.select(head[0].cast("long").alias("doc_id"), checked.alias("p")).select(
        "doc_id", F.trim(F.col("p")[0]).alias("name"), F.col("p")[1].cast("long").alias("max_tf"), F.col("p")[2].cast("long").alias("length"),
        pairs.alias("dominant_entities"),
    )


def parse_document_map_head(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(total_len)`` of the head line."""
    return lines.where(~F.col(line).contains("|")).select(F.col(line).cast("long").alias("total_len"))


def parse_inverted_file(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(term, doc_id, tf)`` of lines ``term(|doc,tf)+``; a line is split once, not again for each of its documents."""
    cut = lines.select(pinned(F.substring_index(line, "|", 1)).alias("term"), pinned(F.split(line, r"\|")).alias("_parts"))
    rows = cut.select("term", F.explode(F.slice("_parts", F.lit(2), F.size("_parts"))).alias("p"))
    pair = F.split("p", ",")
    return rows.select("term", pair[0].cast("long").alias("doc_id"), pair[1].cast("long").alias("tf"))

"""Loading records strictly, and telling why the others failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.plan import pinned

CSV_FIELDS = ("docno", "day", "section", "length", "text")
TREC_HEAD = ("DOCNO", "DAY", "SECTION", "LENGTH")

_DOCNO = r"^[A-Z]{3}[0-9]{6}-[0-9]{7}$"
_TAGS = r"</?(?:DOC|DOCNO|DAY|SECTION|LENGTH|TEXT)>"
_TAG_ORDER = (
    "^<DOC>" + "".join(f"<{t}></{t}>" for t in TREC_HEAD) + "(?:<TEXT></TEXT>)+</DOC>$"
)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _csv(pieces: Column) -> tuple[Column, Column]:
    """(quoting is right, fields) without backtracking: the pieces between quotes alternate outside, inside."""
    last = F.size(pieces) - 1

    def outside_ok(piece: Column, i: Column) -> Column:
        opens = (i == 0) | piece.startswith(",")
        closes = (i == last) | piece.endswith(",")
        return (i % 2 == 1) | (piece == "") | (opens & closes)

    right = (last % 2 == 0) & F.forall(F.transform(pieces, outside_ok), lambda x: x)
    # A comma outside quotes becomes \x01\x03; a \x01 of the data is kept apart as \x01\x02.
    def mark(piece: Column, i: Column) -> Column:
        kept = F.replace(piece, F.lit("\x01"), F.lit("\x01\x02"))
        inner_quote = (piece == "") & (i > 0) & (i < last)
        return F.when(i % 2 == 1, kept).when(inner_quote, F.lit('"')).otherwise(
            F.replace(kept, F.lit(","), F.lit("\x01\x03"))
        )

    fields = F.split(F.array_join(F.transform(pieces, mark), ""), "\x01\x03", -1)
    return right, F.transform(fields, lambda f: F.replace(f, F.lit("\x01\x02"), F.lit("\x01")))


def _trec(raw: Column, pieces: Column) -> tuple[Column, Column]:
    """(tags are right, fields): the known tags in their order, and nothing but blanks between the elements."""
    order = F.array_join(F.regexp_extract_all(raw, F.lit(_TAGS), F.lit(0)), "")
    # With the tags in order, pieces 2, 4, 6, ... are contents and the others lie between elements.
    between = F.filter(pieces, lambda _, i: (i % 2 == 1) | (i == 0) | (i == F.size(pieces) - 1))
    right = F.coalesce(F.regexp_like(order, F.lit(_TAG_ORDER)), F.lit(False)) & F.forall(
        between, lambda p: ~p.rlike(r"\S")
    )
    contents = F.filter(pieces, lambda _, i: (i % 2 == 0) & (i > 0) & (i < F.size(pieces) - 1))
    text = F.array_join(F.slice(contents, 5, F.greatest(F.size(contents), F.lit(1))), "\n")
    return right, F.concat(F.slice(contents, 1, 4), F.array(text))


def _parsed(raw: DataFrame) -> DataFrame:
    """Adds the parts of a record and the checks on them; every check is true, false or null."""
    text = F.col("raw")
    is_csv, is_trec = F.col("fmt") == "csv", F.col("fmt") == "trec"
    # Pinned, or filters would copy the split into their lambdas and do it anew for every piece.
    pieces = pinned(F.when(is_csv, F.split(text, '"', -1)).otherwise(F.split(text, _TAGS, -1)))
    raw = raw.withColumn("_pieces", pieces)
    csv_ok, csv_fields = _csv(F.col("_pieces"))
    trec_ok, trec_fields = _trec(text, F.col("_pieces"))
    df = raw.withColumn("_empty", F.coalesce(~text.rlike(r"\S"), F.lit(True)))
    df = df.withColumn("_quoting", F.when(is_csv, csv_ok).otherwise(True))
    df = df.withColumn("_tags", F.when(is_trec, trec_ok).otherwise(True))
    df = df.withColumn(
        "_f", F.when(is_csv & F.col("_quoting"), csv_fields).when(is_trec & F.col("_tags"), trec_fields)
    )
    df = df.withColumn("_columns", F.when(is_csv & F.col("_quoting"), F.size("_f") == 5).otherwise(True))
    part = lambda i: F.coalesce(F.get("_f", F.lit(i)), F.lit(""))
    day = _trim(part(1))
    return (
        df.withColumn("docno", _trim(part(0)))
        .withColumn("_docno", F.col("docno").rlike(_DOCNO))
        .withColumn("day", F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd")))
        .withColumn("_day", F.col("day").isNotNull())
        .withColumn("section", _trim(part(2)))
        .withColumn("_len", _trim(part(3)))
        .withColumn("_length", F.col("_len").rlike(r"^[0-9]{1,9}$"))
        .withColumn("length", F.expr("try_cast(_len as bigint)"))
        .withColumn("text", part(4))
        .withColumn("_text", F.col("text").rlike(r"\S"))
    )


def _source(raw: DataFrame) -> DataFrame:
    """The columns used, and the record's offset: its id with a digest, which tells rows of a repeated or null id apart."""
    return raw.select("record_id", "file_name", "fmt", "raw").withColumn("_digest", F.xxhash64("fmt", "raw"))


def load_valid(raw: DataFrame) -> DataFrame:
    """Strict load: the conforming records as ``(record_id, file_name, docno, day, section, length, text)``.

    The text of a ``trec`` record is that of all its ``TEXT`` elements, joined by line breaks;
    the text is kept as received, the other values are trimmed. A record whose ``fmt`` is
    neither ``csv`` nor ``trec`` does not conform.
    """
    return _load(_source(raw)).select("record_id", "file_name", "docno", "day", "section", "length", "text")


def _load(source: DataFrame) -> DataFrame:
    checks = ("_quoting", "_columns", "_tags", "_docno", "_day", "_length", "_text")
    keep = F.col("fmt").isin("csv", "trec") & ~F.col("_empty")
    for c in checks:
        keep = keep & F.coalesce(F.col(c), F.lit(False))
    return _parsed(source).where(keep)


def diagnose(raw: DataFrame) -> DataFrame:
    """Records that are not valid, with the first fault: ``(record_id, file_name, fmt, raw, reason)``.

    The offsets of the strict load are subtracted from all offsets (anti-join), and only the
    remainder is diagnosed. Reasons in order: ``empty``, ``format`` (neither csv nor trec),
    ``quoting``, ``columns``, ``tags``, ``docno``, ``day``, ``length``, ``text``.
    Null raw is ``empty``; rows of a null or repeated id are judged one by one; exact repeats
    of a row come out as often as they occur. Other columns of the input are not looked at.
    """
    source = _source(raw)
    good = _load(source).select(F.col("record_id").alias("_id"), F.col("_digest").alias("_good")).distinct()
    rest = source.join(good, source["record_id"].eqNullSafe(good["_id"]) & (source["_digest"] == good["_good"]), "left_anti")
    bad = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = F.when(F.col("_empty"), "empty").when(~F.coalesce(F.col("fmt").isin("csv", "trec"), F.lit(False)), "format")
    for c in ("quoting", "columns", "tags", "docno", "day", "length", "text"):
        reason = reason.when(bad(f"_{c}"), c)
    return _parsed(rest).select("record_id", "file_name", "fmt", "raw", reason.alias("reason"))

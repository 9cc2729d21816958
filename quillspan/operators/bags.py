"""Documents to bags of numbers, terms and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.config import EngineConfig
from quillspan.functions.numbers import classified, matches
from quillspan.functions.plan import pinned
from quillspan.functions.porter import stem_column
from quillspan.functions.text import accepted, clean, emitted, items, pairs, tokens

OPEN, CLOSE = "<TEXT>", "</TEXT>"


def _sections(df: DataFrame, body: Column) -> DataFrame:
    cleaned = df.select("doc_id", F.posexplode(body).alias("sec", "body")).select("doc_id", "sec", clean(F.col("body")).alias("clean"))
    return cleaned.withColumn("tokens", tokens(F.col("clean")))


def tagged_sections(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``(doc_id, sec, clean, tokens)`` of every ``<TEXT>`` element of a raw document; each is parsed on its own."""
    return _sections(docs, F.regexp_extract_all(raw, F.lit(rf"(?s){OPEN}(.+?){CLOSE}"), F.lit(0)))


def plain_sections(docs: DataFrame, text: str = "text", glued: bool = False) -> DataFrame:
    """The same of plain texts, one section each; ``glued`` sets the tags without blanks, as free-text queries have them."""
    gap = "" if glued else " "
    body = F.concat(F.lit(OPEN + gap), F.col(text), F.lit(gap + CLOSE))
    return _sections(docs.where(F.col(text).isNotNull()), F.array(body))


def number_matches(sections: DataFrame) -> DataFrame:
    """Every numeric match with context, rule, kind and key."""
    return classified(matches(sections, "doc_id", "sec"))


def emissions(sections: DataFrame, config: EngineConfig) -> DataFrame:
    """``(doc_id, kind, base, cap)``: everything the rules emit. ``cap`` is null where the case is kept as it is."""
    numeric = sections.where(F.col("clean").rlike(r"\d"))
    numbers = number_matches(numeric).where("rule is not null").select("doc_id", "kind", F.col("key").alias("base"), F.lit(None).cast("boolean").alias("cap"))
    numbers = numbers.where((F.col("kind") == "number") | accepted(F.col("base")))
    found = sections.select("doc_id", "clean", pinned(pairs(F.col("clean"))).alias("_pairs"))
    found = found.select("doc_id", pinned(items(F.col("clean"), F.col("_pairs"), config.stop_words)).alias("_items"))
    own = emitted(found.select("doc_id", F.explode("_items").alias("_item")), "_item", config.stop_words)
    return numbers.unionByName(own)


def doc_terms(sections: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(doc_id, kind, key, tf)``, kinds ``number``, ``term`` and ``entity``.

    A word that a document has in small letters at least once is counted in small letters,
    else in capitals. Combined before the shuffle by document; stemming runs after that, on each
    document's distinct words.
    """
    capital = F.bool_and(F.coalesce("cap", F.lit(False))).alias("_capital")
    folded = emissions(sections, config).groupBy("doc_id", "kind", "base").agg(
        F.count(F.lit(1)).alias("tf"), capital, F.bool_or(F.col("cap").isNotNull()).alias("_word")
    )
    if config.stem:
        word = (F.col("kind") == "term") & F.col("_word")
        stemmed = folded.withColumn("base", F.coalesce(stem_column(F.when(word, F.col("base"))), F.col("base")))
        folded = stemmed.where(~word | accepted(F.col("base"))).groupBy("doc_id", "kind", "base").agg(
            F.sum("tf").alias("tf"), F.bool_and("_capital").alias("_capital")
        )
    upper = (F.col("kind") == "term") & F.col("_capital")
    return folded.select("doc_id", "kind", F.when(upper, F.upper("base")).otherwise(F.col("base")).alias("key"), "tf")

"""How distinctive a term is for a record: log-entropy weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.force import in_force
from quillspan.runtime import written


def term_weights(rows: DataFrame, n_records: int, term: str = "term", tf: str = "tf") -> DataFrame:
    """``(term, records, df, total_tf, top_tf, weight)`` from one row per (record, term); the weight as in :func:`log_entropy`.

    ``records`` counts all rows of the term, ``df`` and the other columns those with tf >= 1. Sums, combined before the shuffle.
    """
    used = F.col(tf) >= 1
    terms = rows.groupBy(term).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(used).alias("df"),
        F.sum(F.when(used, F.col(tf))).alias("total_tf"),
        F.max(tf).alias("top_tf"),
        F.sum(F.when(used, F.col(tf) * F.ln(tf))).alias("_tf_ln_tf"),
    ).where("df > 0")
    entropy = F.ln("total_tf") - F.col("_tf_ln_tf") / F.col("total_tf")
    weight = F.when(F.lit(n_records) > 1, 1 - entropy / F.ln(F.lit(float(max(n_records, 2))))).otherwise(1.0)
    return terms.select(F.col(term), "records", "df", "total_tf", "top_tf", weight.alias("weight"))


def log_entropy(counts: DataFrame, n_records: int, record: str = "doc_id", term: str = "term", tf: str = "tf") -> DataFrame:
    """``(record, term, tf, df, total_tf, weight, score)`` for every (record, term) of ``counts``.

    With p = tf / total_tf of the term, the spread of a term is its entropy -sum(p ln p), and

        weight = 1 - entropy / ln(n_records),   score = ln(1 + tf) * weight.

    A term evenly spread over all records has weight 0, a term of one record weight 1. Two
    aggregations: ``counts`` has one row per (record, term), and the term statistics are sums
    (entropy = ln(total) - sum(tf ln tf) / total). The join back
    is by term; a term in a third of all rows is split by the adaptive skew join.
    ``counts`` is read twice, so it is made once and written.
    Rows with null term or tf < 1 are left out. With fewer than two records the weight is 1.
    """
    rows = counts.where(F.col(term).isNotNull() & (F.col(tf) >= 1)).select(record, term, F.col(tf).cast("long").alias("tf"))
    rows = written(rows, "term-counts")
    terms = term_weights(rows, n_records, term).drop("records", "top_tf")
    return rows.join(terms, term).select(
        record, term, "tf", "df", "total_tf", "weight", (F.ln(1 + F.col("tf")) * F.col("weight")).alias("score")
    )


def term_counts(doc_terms: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``: terms in force in small letters, tf summed per document and term."""
    return in_force(doc_terms, "term").groupBy("doc_id", "lkey").agg(F.sum("tf").alias("tf")).select(
        "doc_id", F.col("lkey").alias("term"), "tf"
    )


def distinctive_terms(doc_terms: DataFrame, documents_map: DataFrame) -> DataFrame:
    """:func:`log_entropy` of the terms of every document; the collection is the documents of ``documents_map``."""
    return log_entropy(term_counts(doc_terms), documents_map.count())


def found(doc_terms: DataFrame, documents_map: DataFrame, least: float = 0.25, least_length: int = 40) -> DataFrame:
    """``(doc_id, term)`` with tf / length x log10(N / df) >= ``least`` in documents of at least ``least_length``.

    The log-entropy weight picks the candidates, an exact check follows. The entropy of a term of df records is at most
    ln(df), so its weight is at least 1 - ln(df) / ln(N), which is

        log10(N / df) <= weight x log10(N),

    and a row whose tf x weight x log10(N) is below ``least`` x length can't be a case. First the terms whose
    greatest tf fails this for the shortest length drop out, then rows by their own tf, then by the length of their document.
    ``least`` must be positive. With N < 2 there is no case.
    """
    if least <= 0:
        raise ValueError("least must be positive")
    n = documents_map.count()
    log_n = F.log10(F.lit(float(max(n, 1))))
    needed = least * least_length * (1 - 1e-9)
    rows = written(term_counts(doc_terms), "term-counts")
    weights = term_weights(rows, n).withColumn("_most", F.col("weight") * log_n)
    hopeful = written(weights.where(F.col("top_tf") * F.col("_most") >= needed).select("term", "records", "_most"), "term-weights")
    # No weight is above 1. The terms left are known by size, so Spark broadcasts them only where they are few.
    scored = rows.where(F.col("tf") * log_n >= needed).join(hopeful, "term").where(F.col("tf") * F.col("_most") >= needed)
    lengths = documents_map.where(F.col("length") >= least_length).select("doc_id", "length")
    candidates = scored.join(lengths, "doc_id").where(F.col("tf") * F.col("_most") >= F.col("length") * least * (1 - 1e-9))
    idf = F.log10(F.lit(float(max(n, 1))) / F.col("records"))
    return candidates.where(F.col("tf") / F.col("length") * idf >= least).select("doc_id", "term").distinct()

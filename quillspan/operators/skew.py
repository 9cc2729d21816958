"""Per-key results when a few keys hold most rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import written

#: A key is heavy when it holds more than one row in HEAVY_PART, so at most HEAVY_PART keys are heavy.
HEAVY_PART = 1000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(_hash, _n)``: rows per 64-bit hash of the non-null keys, combined before the shuffle and written once."""
    hashes = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_hash"))
    return written(hashes.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")), "key-counts")


def heavy_keys(counts: DataFrame, parts: int = HEAVY_PART) -> DataFrame:
    """``(_hash)`` of keys that hold more than 1/``parts`` of all rows: fewer than ``parts`` rows of 8 bytes, whatever the input.

    Keys of one hash are heavy together, which costs a salt and changes no result.
    """
    total = counts.agg(F.sum("_n"))
    return counts.where(F.col("_n") * parts > total.scalar()).select("_hash")


def salted_postings_stats(
    postings: DataFrame, salts: int = 64, key: str = "term", record: str = "doc_id", weight: str = "tf", counts: DataFrame | None = None
) -> DataFrame:
    """Rows, document frequency and total frequency of every key: ``(term, n_rows, df, tf)``.

    Stage 0 finds the heavy keys, from ``counts`` of :func:`key_counts` where given. Stage 1 appends a salt to them and aggregates per
    (key, salt, record), stage 2 per (key, salt), stage 3 merges the partials of a key.
    The salt is a hash of the record instead of a random number: a record then lies in
    exactly one salt, so distinct records may be added up, and a task that runs again after
    an executor is lost draws the same salt.

    A null key gives no row. A null weight adds nothing to ``tf``, but the row counts in
    ``n_rows`` and, with a known record, in ``df``. A null record counts in ``n_rows`` and
    ``tf`` only. Repeated rows are partial frequencies and all count. Empty input: no rows.
    """
    rows = postings.select(
        F.col(key).alias("term"), F.col(record).cast("long").alias("_record"), F.col(weight).cast("long").alias("_w")
    ).where("term is not null")
    counts = key_counts(rows, "term") if counts is None else counts
    heavy = F.broadcast(heavy_keys(counts).select("_hash", F.lit(True).alias("_heavy")))
    salted = rows.join(heavy, F.xxhash64("term") == F.col("_hash"), "left").withColumn(
        "_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64("_record"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    per_record = salted.groupBy("term", "_salt", "_record").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_tf")
    )
    per_salt = per_record.groupBy("term", "_salt").agg(
        F.sum("_n").alias("_n"), F.count("_record").alias("_df"), F.sum("_tf").alias("_tf")
    )
    return per_salt.groupBy("term").agg(
        F.sum("_n").alias("n_rows"), F.sum("_df").alias("df"), F.coalesce(F.sum("_tf"), F.lit(0)).alias("tf")
    )

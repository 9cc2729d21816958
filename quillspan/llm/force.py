"""Rows in force of a table that receives late, repeated and corrected deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_force(doc_terms: DataFrame, kind: str | None = None) -> DataFrame:
    """``(doc_id, kind, key, lkey, tf)``: of each (doc_id, kind, key) the row loaded last.

    Rows with null key or tf are left out. Of rows loaded at the same time the greatest tf
    counts; a null ``loaded_at`` is older than any time. ``lkey`` is the key in small letters.
    Null doc_id and null kind are values like others. One shuffle, by (doc_id, lkey):
    the key is part of it, so a document that holds a third of all rows is spread.
    """
    rows = doc_terms.where("key is not null and tf is not null")
    own = ["doc_id", "kind", "key"]
    if kind is not None:  # a constant needn't be shuffled
        rows, own = rows.where(F.col("kind") == kind), ["doc_id", "key"]
    at = F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**63))).alias("_at")
    spread = rows.select(*own, F.col("tf").cast("long").alias("tf"), at).repartition("doc_id", F.lower("key"))
    loads = spread.groupBy(*own, F.lower("key").alias("lkey"), "_at").agg(F.max("tf").alias("tf"))
    last = loads.groupBy(*own, "lkey").agg(F.max_by("tf", "_at").alias("tf"))
    return last.select("doc_id", F.col("kind") if kind is None else F.lit(kind).alias("kind"), "key", "lkey", "tf")

"""The N strongest items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from quillspan.llm.force import in_force


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """``(group, rank, item, score)`` of the ``n`` items with the highest score in each group.

    A mergeable aggregate keeps a heap of at most ``n`` (score, item) pairs per group; it is
    filled before the shuffle and the heaps are merged afterwards, so at most ``n`` pairs per
    group and map task move, and no task holds a group, however large. Equal scores: the
    greater item (byte order) comes first, so the order is total. Null score or item: row left
    out. A null group is a group. Repeated rows count as often as they occur; make rows
    distinct before where they should not. ``n`` < 1 is refused.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    pair: Column = F.struct(F.col(score).alias("score"), F.col(item).alias("item"))
    heaps = (
        df.where(F.col(score).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("_group"))
        .agg(InternalFunction.collect_top_k(pair, n, False).alias("_top"))
    )
    return heaps.select("_group", F.posexplode("_top").alias("_rank", "_pair")).select(
        F.col("_group").alias(group),
        (F.col("_rank") + 1).alias("rank"),
        F.col("_pair.item").alias(item),
        F.col("_pair.score").alias(score),
    )


def dominant_entities(doc_terms: DataFrame, n: int = 5) -> DataFrame:
    """``(doc_id, rank, entity, tf)``: the ``n`` entities with the highest tf of every document, from the rows in force."""
    entities = in_force(doc_terms, "entity").select("doc_id", F.col("key").alias("entity"), "tf")
    return top_n(entities, "doc_id", "tf", "entity", n)


def refreshed_map(documents_map: DataFrame, doc_terms: DataFrame, n: int = 5) -> DataFrame:
    """The document map with ``dominant_entities`` made anew: ``(doc_id, name, max_tf, length, dominant_entities)``.

    Documents without entity have an empty list. Order in the list: tf, then entity, descending.
    """
    entities = in_force(doc_terms, "entity").select("doc_id", F.col("key").alias("entity"), "tf")
    lists = (
        entities.groupBy("doc_id")
        .agg(InternalFunction.collect_top_k(F.struct("tf", "entity"), n, False).alias("_top"))
        .select("doc_id", F.transform("_top", lambda x: F.struct(x["entity"].alias("entity"), x["tf"].alias("tf"))).alias("_list"))
    )
    empty = F.array().cast("array<struct<entity:string,tf:bigint>>")
    return documents_map.select("doc_id", "name", "max_tf", "length").join(lists, "doc_id", "left").select(
        "doc_id", "name", "max_tf", "length", F.coalesce("_list", empty).alias("dominant_entities")
    )

"""Putting documents into containers of fixed capacity: best fit planned over the histogram of lengths."""

from __future__ import annotations

import bisect
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tokens import n_tokens
from quillspan.runtime import written

CAPACITY = 512
#: Items of one length that are ranked within one task.
RANKED_AT_ONCE = 100_000


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: slots ``(length, rank_from, rank_to, container_from, offset)``.

    Items of ``length`` with rank_from <= rank < rank_to lie at ``offset`` in container
    ``container_from + rank - rank_from``. Containers in the same state are kept as ranges, so the
    work and the plan depend on the capacity and not on the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free room: ranges (first container, how many)
    free: list[int] = []  # the keys of room, sorted
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                bisect.insort(free, r)
            room[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                r = free[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    free.pop(at)
            else:
                r, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = r // length
            full = min(n, left // each)
            for j in range(each if full else 0):
                slots.append((length, rank, rank + full, first, capacity - r + j * length))
                rank += full
            left -= full * each
            put(r - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer items left than one more container would take
                for j in range(left):
                    slots.append((length, rank, rank + 1, first, capacity - r + j * length))
                    rank += 1
                put(r - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            put(r, first, n)
    return slots


def pack(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, n_tokens, n_parts, part, part_tokens, token_from, container, offset)``: every document's places.

    A document of more than ``capacity`` tokens is split into full parts and a rest; no other
    is. A document without tokens (null or blank text) gives one row with 0 parts and no
    container. The histogram of part lengths, at most ``capacity`` rows, is planned on the driver;
    parts then take the planned slots by joining on their rank within the length. Ranks are
    counted in (length, hash of doc_id) cells of bounded size, to which the sizes of the cells
    before are added, so any number of parts of one length is fine. Order within a length:
    cell, doc_id, part. Repeated rows are documents of their own.
    """
    spark = documents.sparkSession
    sized = written(documents.select("doc_id", n_tokens("text").alias("n_tokens")), "sizes")
    n_parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    part = F.explode(F.sequence(F.lit(1), n_parts)).alias("part")
    items = (
        sized.where("n_tokens > 0")
        .select("doc_id", "n_tokens", n_parts.alias("n_parts"), part)
        .withColumn("token_from", (F.col("part") - 1).cast("long") * capacity)
        .withColumn("part_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("token_from")).cast("int"))
    )
    histogram = {r[0]: r[1] for r in items.groupBy("part_tokens").count().collect()}
    cells = 1 + max(histogram.values(), default=0) // RANKED_AT_ONCE
    items = items.withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))

    by_cell = Window.partitionBy("part_tokens").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = items.groupBy("part_tokens", "_cell").count().select(
        "part_tokens", "_cell", F.coalesce(F.sum("count").over(by_cell), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("part_tokens", "_cell").orderBy("doc_id", "part")
    ranked = (
        items.withColumn("_n", F.row_number().over(within))
        .join(before, ["part_tokens", "_cell"])
        .withColumn("_rank", F.col("_before") + F.col("_n") - 1)
    )
    slots = spark.createDataFrame(
        plan(histogram, capacity), "part_tokens int, _from long, _to long, _first long, offset int"
    )
    # At most capacity lengths with at most capacity ranges each: bounded whatever the input.
    placed = ranked.join(F.broadcast(slots), "part_tokens").where("_rank >= _from and _rank < _to")
    columns = ["doc_id", "n_tokens", "n_parts", "part", "part_tokens", "token_from", "container", "offset"]
    placed = placed.withColumn("container", F.col("_first") + F.col("_rank") - F.col("_from")).select(columns)
    none = sized.where("n_tokens = 0").select(
        "doc_id", "n_tokens", F.lit(0).alias("n_parts"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("part_tokens"),
        F.lit(None).cast("long").alias("token_from"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("offset"),
    )
    return placed.unionByName(none)

"""Word similarity: tables of similar words from vectors, and their reduction to an index."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.porter import stem_column
from quillspan.runtime import written

_BLOCK_ROWS = 4096


def averaged(vectors: DataFrame, stemmed: bool = False) -> DataFrame:
    """``(word, vector)`` from ``(word, vector)``: cleaned to small letters (and stems), vectors of one word averaged by element."""
    word = F.lower(F.regexp_replace("word", r"^\W+|\W+$", ""))
    rows = vectors.select((stem_column(word) if stemmed else word).alias("word"), F.posexplode("vector").alias("at", "x")).where("word <> ''")
    cells = rows.groupBy("word", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(
        "word", F.transform("v", lambda c: c["x"]).alias("vector")
    )


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector is null."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """``(word, rank, sim, cosine)``: the ``k`` words most similar to each query word, itself left out; ties by word.

    An exact search: blocks of stated queries meet blocks of all vectors. Every pair of blocks is one
    matrix product in Arrow batches that keeps ``k`` per query, so what is shuffled is blocks and short lists.
    Words without vector or with a zero vector are neither found nor asked.
    """
    import numpy as np

    norm = written(vectors.select("word", unit(F.col("vector")).alias("u")).where("u is not null"), "vectors")
    own = norm.select(F.col("word").alias("asked"), F.col("u").alias("au"))
    asked = queries.select(F.col("word").alias("asked")).distinct().join(own, "asked")
    n = norm.count()
    blocks, asks = max(1, -(-n // _BLOCK_ROWS)), max(1, -(-asked.count() // _BLOCK_ROWS))
    # Each side is copied once per block of the other, and the pair of blocks is the key.
    left = asked.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_a", F.pmod(F.xxhash64("asked"), F.lit(asks)))
    right = norm.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asks - 1).cast("long")))).withColumn("_b", F.pmod(F.xxhash64("word", F.lit(1)), F.lit(blocks)).cast("int"))

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"word": [], "sim": [], "cosine": []})
        v = v.sort_values("word", kind="stable")
        names = v["word"].to_numpy()
        dots = np.round(np.stack(q["au"].to_numpy()) @ np.stack(v["u"].to_numpy()).T, digits)
        out = []
        for w, row in zip(q["asked"], dots):
            row = np.where(names == w, -2.0, row)
            best = np.argsort(-row, kind="stable")[:k]
            out.append(pd.DataFrame({"word": w, "sim": names[best], "cosine": row[best]})[row[best] > -2])
        return pd.concat(out)

    pairs = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(meet, "word string, sim string, cosine double")
    best = Window.partitionBy("word").orderBy(F.desc("cosine"), "sim")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("word", "rank", "sim", "cosine")


def as_lists(similars: DataFrame) -> DataFrame:
    """``(word, sims)``, most similar first."""
    return similars.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "sim"))).alias("l")).select(
        "word", F.transform("l", lambda x: x["sim"]).alias("sims")
    )


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two synonym tables; where both have a word, the entry of ``first`` replaces the other."""
    return first.unionByName(second.join(first.select("word"), "word", "left_anti"))


def known(synonyms: DataFrame, entries: DataFrame) -> DataFrame:
    """Synonyms whose word is in the dictionary in whatever case."""
    keys = entries.select(F.lower("key").alias("_l")).distinct()
    return synonyms.join(keys, F.lower("word") == F.col("_l"), "left_semi")



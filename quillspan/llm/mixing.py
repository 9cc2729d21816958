"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import n_tokens
from quillspan.runtime import written

#: Documents rounded in one group, and residuals combined in one node of the reduction tree.
GROUP, FAN_IN = 20_000, 64
MAX_SOURCES = 10_000


def source_name(c: Column | str) -> Column:
    """Trimmed, small letters, ``_`` read as ``-``."""
    return F.translate(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "_", "-")


def sized_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, tokens)``, written once."""
    return written(documents.select("doc_id", source_name("source").alias("source"), n_tokens("text").alias("tokens")), "mix-sizes")


def shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source is to contribute: one row per source of ``targets``.

    ``(source, name, target_share, max_repeats, own_tokens, own_documents, used_documents, target_tokens)``;
    ``source`` as written in ``targets``, ``name`` as in :func:`source_name`. Null, NaN and negative weights are 0; a null
    ``max_repeats`` is 1. Rows of one name are added up, with the greatest ``max_repeats``.
    ``used_documents`` are those with tokens.
    """
    weight = F.when(F.col("weight") > 0, F.nanvl("weight", F.lit(0.0))).otherwise(0.0)
    rows = targets.where("source is not null").groupBy(source_name("source").alias("name")).agg(
        F.min("source").alias("source"), F.sum(weight).alias("weight"),
        F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"),
    )
    all_weights, all_tokens = rows.agg(F.sum("weight")), sized.agg(F.sum("tokens"))
    own = sized.groupBy(F.col("source").alias("name")).agg(
        F.sum("tokens").alias("own_tokens"), F.count(F.lit(1)).alias("own_documents"),
        F.count_if(F.col("tokens") > 0).alias("used_documents"),
    )
    share = F.coalesce(F.col("weight") / F.nullif(all_weights.scalar(), F.lit(0.0)), F.lit(0.0))
    joined = rows.join(own, "name", "left").select(
        "source", "name", share.alias("target_share"), "max_repeats",
        F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), F.coalesce("own_documents", F.lit(0)).alias("own_documents"),
        F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
    )
    target = F.col("target_share") * F.coalesce(all_tokens.scalar(), F.lit(0))
    return joined.withColumn("target_tokens", target)


def pivot(p: list[float], w: list[float], draw: np.random.Generator) -> tuple[list[float], int]:
    """Rounds probabilities in pairs, keeping the sum of p x w: (probabilities, index of the one left, or -1).

    Of two fractional p, mass is moved from one to the other until one of them is 0 or 1; which
    way is random so that every expected value stays. At most one stays fractional.
    """
    p = list(p)
    u = draw.random(len(p))
    open_ = -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = float(p[j] >= 0.5)
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        up, down = min((1 - p[i]) * w[i], p[j] * w[j]), min(p[i] * w[i], (1 - p[j]) * w[j])
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / w[i]
        p[j] -= move / w[j]
        settled = [k for k in (i, j) if p[k] <= 1e-9 or p[k] >= 1 - 1e-9]
        for k in settled:
            p[k] = float(p[k] >= 0.5)
        rest = [k for k in (i, j) if k not in settled]
        open_ = rest[0] if rest else -1
    return p, open_


def _rounded(level: int, last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        digest = hashlib.blake2b(repr((seed, level, *map(str, key))).encode(), digest_size=8).digest()
        draw = np.random.default_rng(int.from_bytes(digest, "little"))
        p, left = pivot(pdf["p"].tolist(), pdf["tokens"].tolist(), draw)
        if left >= 0 and last:
            p[left] = float(draw.random() < p[left])
            left = -1
        out = pdf.assign(p=p, settled=True)
        if left >= 0:
            out.iloc[left, out.columns.get_loc("settled")] = False
        return out

    return run


_SCHEMA = "doc_id long, source string, tokens long, base int, p double, cell long, settled boolean"


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    ``chosen``: ``(doc_id, source, tokens, copies)``, documents used at least once, ``source`` as
    in :func:`source_name`. ``report``: the columns of :func:`shares` and
    ``documents, copies, mixed_tokens, actual_share, short``, one row per source of ``targets``. ``short`` is read off the rounded
    copies: every document with tokens is used ``max_repeats`` times and the source still misses its target. Only then is the target more
    than max_repeats x own tokens: below that a source misses it by less than one copy of a document, and not with all of them used up.

    Every document of a source is to be used e = min(target / own tokens, max_repeats) times:
    floor(e) times for certain, once more with probability e - floor(e). These probabilities are
    rounded dependently, weighted by tokens, so that a source misses its target by less than
    its last document: first in (source, hash of doc_id) cells of bounded size, then the one residual of
    each cell in a reduction tree of ``FAN_IN`` per node. All draws come from the seed and the
    cell, so a task that runs again draws the same. Documents without source, of an unlisted
    source or without tokens are not used. Every distinct doc_id is meant to occur once;
    repeated rows are drawn one by one.
    """
    if targets.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sized = sized_documents(documents)
    want = written(shares(sized, targets), "mix-shares")
    e = F.least(F.col("target_tokens") / F.col("own_tokens"), F.col("max_repeats").cast("double"))
    wanted = want.where("own_tokens > 0 and target_tokens > 0 and max_repeats > 0").select("name", e.alias("e"), "own_documents")
    most = wanted.agg(F.max("own_documents")).first()[0] or 0
    cells = 1 + most // GROUP
    rows = (
        sized.where("tokens > 0")
        .join(F.broadcast(wanted), F.col("source") == F.col("name"))  # at most MAX_SOURCES rows
        .select(
            "doc_id", "source", "tokens", F.floor("e").cast("int").alias("base"), (F.col("e") - F.floor("e")).alias("p"),
            F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(cells)).alias("cell"), F.lit(False).alias("settled"),
        )
    )
    done, level = [], 0
    while True:
        last = cells == 1
        run = rows.groupBy("source", "cell").applyInPandas(_rounded(level, last, seed), _SCHEMA)
        run = written(run, f"mix-level{level}")
        done.append(run.where("settled"))
        if last:
            break
        cells, level = math.ceil(cells / FAN_IN), level + 1
        rows = run.where("not settled").withColumn("cell", F.floor(F.col("cell") / FAN_IN).cast("long"))
    all_done = done[0]
    for x in done[1:]:
        all_done = all_done.unionByName(x)
    chosen = all_done.select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).where("copies > 0")
    got = chosen.groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens")
    )
    total = chosen.agg(F.sum(F.col("tokens") * F.col("copies")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("documents", "copies", "mixed_tokens")}
    report = want.join(got, "name", "left").withColumns(zero)
    share = F.coalesce(F.col("mixed_tokens") / F.nullif(total.scalar(), F.lit(0)), F.lit(0.0))
    used_up = F.col("copies") == F.col("used_documents") * F.greatest("max_repeats", F.lit(0))
    short = used_up & (F.col("mixed_tokens") < F.col("target_tokens"))
    return chosen, report.withColumns({"actual_share": share, "short": short}).drop("used_documents")

"""Frequency of every distinct value, term or n-gram, from a distributed suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.plan import pinned
from quillspan.llm.force import in_force

#: Token separator inside a suffix: sorts below every character of a token, so suffixes sort token by token.
SEP = "\x01"


def suffixes(tokens: DataFrame, record: str, max_n: int) -> DataFrame:
    """``(record, suffix, tf)`` from ``(record, tokens array<string>)``: the suffixes, cut after ``max_n`` tokens."""
    at = F.explode(F.sequence(F.lit(1), F.size("tokens"))).alias("_at")
    rows = tokens.where(F.size("tokens") > 0).select(F.col(record).alias("record"), "tokens", at)
    return rows.select("record", F.array_join(F.slice("tokens", F.col("_at"), F.lit(max_n)), SEP).alias("suffix"), F.lit(1).cast("long").alias("tf"))


def _intervals(levels: int):
    """Turns a sorted stretch of the suffix array into its common-prefix intervals (n, gram, tf, df).

    Columns: the first 1, 2, ... tokens of the suffix (null where it is shorter), its frequency, and per level whether it is
    the first of its record with this prefix. Neighbours that agree in n tokens form an interval. An interval that is cut by
    the end of a batch or stretch comes out in parts, to be added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tf = batch.column(levels).to_numpy(zero_copy_only=False)
            parts = []
            for n in range(levels):
                prefix = batch.column(n)
                differs = pc.fill_null(pc.not_equal(prefix[1:], prefix[:-1]), True).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate(([True], differs)))
                fresh = batch.column(levels + 1 + n).to_numpy(zero_copy_only=False)
                grams = prefix.take(pa.array(starts))
                kept = pc.is_valid(grams)
                made = [pa.array(np.full(len(starts), n + 1, np.int32)), grams, pa.array(np.add.reduceat(tf, starts)), pa.array(np.add.reduceat(fresh, starts))]
                parts.append(pa.RecordBatch.from_arrays(made, ["n", "gram", "tf", "df"]).filter(kept))
            yield from parts

    return run


_SCHEMA = "n int, gram string, tf long, df long"


def _merged(stretches: DataFrame) -> DataFrame:
    """Intervals whose parts lie in several stretches, put together."""
    return stretches.groupBy("n", "gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def value_counts(rows: DataFrame) -> DataFrame:
    """``(n, gram, tf, df)`` of whole values, n = 1, from ``(record, value, tf)``: the suffix array of texts of one token.

    The array has an entry for every row, sorted by value and record in range partitions, so a value that holds a third of
    all rows is spread over as many stretches as it needs. The interval of a value is the run of its entries: tf is their sum, df their
    number less the within-record duplicates, i.e. entries whose predecessor in the array is of the same record. Equal (value, record) always
    lie in one stretch. A null record is a record; null values must be removed by the caller. Empty input: no rows.
    """
    array = rows.repartitionByRange("value", "record").sortWithinPartitions("value", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None

        def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last
            value, record, tf = batch.columns
            same = pc.fill_null(pc.equal(value[1:], value[:-1]), False).to_numpy(zero_copy_only=False)
            known = pc.is_valid(record).to_numpy(zero_copy_only=False)
            number = pc.fill_null(record, 0).to_numpy(zero_copy_only=False)
            same = same & (known[1:] == known[:-1]) & (number[1:] == number[:-1])
            first = last == (value[0].as_py(), record[0].as_py())
            last = (value[-1].as_py(), record[-1].as_py())
            fresh = 1 - np.concatenate(([first], same)).astype(np.int64)
            return pa.RecordBatch.from_arrays([value, tf, pa.array(fresh)], ["value", "tf", "fresh"])

        yield from _intervals(1)(marked(b) for b in batches if b.num_rows)

    return _merged(array.select("value", "record", "tf").mapInArrow(run, _SCHEMA))


def gram_counts(rows: DataFrame, max_n: int) -> DataFrame:
    """``(n, gram, tf, df)`` of all n-grams up to ``max_n`` tokens, from ``(record, suffix, tf)``.

    Yamamoto and Church's counts by common-prefix intervals: neighbours in the sorted suffixes
    that agree in n tokens form the interval of one n-gram, whose tf is the sum over the
    interval; df is the number of its suffixes less the within-record duplicates, i.e. suffixes
    that share at least n tokens with their predecessor in the same record.

    * Suffixes of equal text are summed over all records before the shuffle; only distinct suffixes are sorted.
    * A record's neighbours are looked for among its suffixes with the same first token
      (others share nothing), so a record that holds a third of all rows is spread.
    * Stretches of the array are range partitions; intervals at their edges are merged.

    Grams join their tokens by a blank. Null or empty tokens must be removed by the caller; a
    null record is a record. Empty input: no rows.
    """
    if max_n < 1:
        raise ValueError("max_n must be at least 1")
    head = F.substring_index("suffix", SEP, 1)
    near = Window.partitionBy("record", "_head").orderBy("suffix")
    own = rows.select("record", "suffix", "tf", head.alias("_head")).withColumn("_prev", F.lag("suffix").over(near))
    a, b = F.split("suffix", SEP), F.split("_prev", SEP)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.when(F.col("_prev").isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)))
    own = own.withColumn("_shared", pinned(shared))
    fresh = [F.sum(F.when(F.col("_shared") < n, 1).otherwise(0)).alias(f"fresh{n}") for n in range(1, max_n + 1)]
    distinct = own.groupBy("suffix").agg(F.sum("tf").alias("tf"), *fresh)
    array = distinct.repartitionByRange("suffix").sortWithinPartitions("suffix")
    long_enough = F.size(F.split("suffix", SEP))
    prefixes = [F.when(long_enough >= n, F.substring_index("suffix", SEP, n)).alias(f"g{n}") for n in range(1, max_n + 1)]
    columns = [*prefixes, F.col("tf"), *(F.col(f"fresh{n}") for n in range(1, max_n + 1))]
    merged = _merged(array.select(*columns).mapInArrow(_intervals(max_n), _SCHEMA))
    return merged.withColumn("gram", F.replace("gram", F.lit(SEP), F.lit(" ")))


def term_dictionary(doc_terms: DataFrame, n_records: int, rare_df: int = 2, common_part: int = 3) -> DataFrame:
    """``(term, tf, df, mark)`` of every term in force, in small letters.

    ``mark`` is ``rare`` if df <= ``rare_df``, ``common`` if common_part x df > ``n_records``
    (rare goes first), else null. A key is one token, whatever it holds.
    """
    rows = in_force(doc_terms, "term").select(F.col("doc_id").alias("record"), F.col("lkey").alias("value"), "tf")
    mark = F.when(F.col("df") <= rare_df, "rare").when(F.col("df") * common_part > n_records, "common")
    return value_counts(rows).select(F.col("gram").alias("term"), "tf", "df", mark.alias("mark"))


#: The public word/punctuation tokenizer's words.
WORD = r"[\p{L}\p{N}_]+"


def text_grams(documents: DataFrame, max_n: int = 2) -> DataFrame:
    """``(n, gram, tf, df)`` of all word n-grams of the documents' whole texts in small letters."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return gram_counts(suffixes(documents.where("text is not null").select("doc_id", words.alias("tokens")), "doc_id", max_n), max_n)

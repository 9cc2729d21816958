"""What is shown or exported: run files, dictionary view, names and entities of results, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import java_hash
from quillspan.operators.index import Index


def named_results(ranked: DataFrame, document_map: DataFrame) -> DataFrame:
    """``(query_id, rank, doc_id, name, entities)`` with the entities by tf ascending, then name; unknown documents are left out."""
    by_tf = F.array_sort(
        "dominant_entities",
        lambda a, b: F.when(a["tf"] != b["tf"], F.when(a["tf"] < b["tf"], -1).otherwise(1))
        .when(a["entity"] < b["entity"], -1).when(a["entity"] > b["entity"], 1).otherwise(0),
    )
    shown = F.transform(by_tf, lambda x: F.concat(F.upper(x["entity"]), F.lit(" appeared: "), x["tf"].cast("string"), F.lit(" times")))
    names = document_map.select("doc_id", "name", shown.alias("entities"))
    return ranked.join(names, "doc_id").select("query_id", "rank", "doc_id", "name", "entities")


def run_lines(ranked: DataFrame, document_map: DataFrame, true_values: bool = False) -> DataFrame:
    """``(query_id, rank, line)`` of an evaluation run file: ``query 0 name 10 9 mt``, or with true rank and score.

    A result that names an unknown document is an error.
    """
    names = document_map.select("doc_id", "name", F.lit(True).alias("_known"))
    rows = ranked.join(names, "doc_id", "left")
    name = F.when(F.col("_known"), F.col("name")).otherwise(
        F.raise_error(F.concat(F.lit("query result holds unknown document "), F.col("doc_id").cast("string")))
    )
    tail = [F.col("rank").cast("string"), F.col("score").cast("string")] if true_values else [F.lit("10"), F.lit("9")]
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), name, *tail, F.lit("mt"))
    return rows.select("query_id", "rank", line.alias("line"))


def write_run_file(lines: DataFrame, path: str) -> None:
    """Text files in query and rank order."""
    lines.orderBy("query_id", "rank").select("line").write.mode("overwrite").text(path)


def dictionary_view(entries: DataFrame) -> DataFrame:
    """``(term, tf)``, ascending by term."""
    return entries.select(F.col("key").alias("term"), "tf").orderBy("term")


def index_stats(index: Index) -> DataFrame:
    """``(documents, terms, entities, dictionary_size, postings, total_len, avgdl)``, one row; avgdl to six digits."""
    d = index.dictionary.agg(
        F.count_if(F.col("kind") != "entity").alias("terms"), F.count_if(F.col("kind") == "entity").alias("entities"),
        F.count(F.lit(1)).alias("dictionary_size"),
    )
    m = index.document_map.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("length").alias("total_len"), F.round(F.avg("length"), 6).alias("avgdl")
    )
    p = index.postings.agg(F.count(F.lit(1)).alias("postings"))
    return m.select(
        "documents", d.select("terms").scalar().alias("terms"), d.select("entities").scalar().alias("entities"),
        d.select("dictionary_size").scalar().alias("dictionary_size"), p.scalar().alias("postings"), "total_len", "avgdl",
    )


def results_of(ranked: DataFrame, query_id: int) -> DataFrame:
    """Results of one query in order of rank."""
    return ranked.where(F.col("query_id") == query_id).orderBy("rank")


def results_of_text(ranked: DataFrame, text: str) -> DataFrame:
    """Results of a free-text query of :func:`quillspan.operators.search.hashed_queries`, whose id is the text's hash."""
    return ranked.where(F.col("query_id") == java_hash(F.lit(text)).cast("long")).orderBy("rank")


def precision_at(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, precision, average_precision)`` against ``(query_id, doc_id)`` of relevant documents."""
    truth = relevant.select("query_id", "doc_id").distinct()
    of = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("_all"))
    hits = ranked.join(truth, ["query_id", "doc_id"]).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("_k"), F.sum(F.col("_n") / F.col("rank")).alias("_ap"))
    return of.join(per, "query_id", "left").select(
        "query_id", (F.coalesce("_k", F.lit(0)) / k).alias("precision"), (F.coalesce("_ap", F.lit(0.0)) / F.col("_all")).alias("average_precision")
    )

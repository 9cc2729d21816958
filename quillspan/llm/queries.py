"""Queries of this package over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm import distinctive, frequency, markup, mixing, packing, spans, topn, wrappers
from quillspan.runtime import ship


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.dominant_entities(_t(spark, d, "doc_terms")).select("doc_id", "entity")


def p1_document_map(spark: SparkSession, d: str) -> DataFrame:
    """The entity list as text, ``entity:tf`` in order."""
    fresh = topn.refreshed_map(_t(spark, d, "documents_map"), _t(spark, d, "doc_terms"))
    pairs = F.transform("dominant_entities", lambda x: F.concat_ws(":", x["entity"], x["tf"].cast("string")))
    return fresh.withColumn("dominant_entities", F.array_join(pairs, "; "))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.found(_t(spark, d, "doc_terms"), _t(spark, d, "documents_map"))


def p4_log_entropy(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(_t(spark, d, "doc_terms"), _t(spark, d, "documents_map")).selectExpr(
        "doc_id", "term", "tf", "df", "total_tf", "round(weight, 6) + 0.0 as weight", "round(score, 6) + 0.0 as score"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "documents_map").count()
    return frequency.term_dictionary(_t(spark, d, "doc_terms"), n).where("mark is not null").select("term", "mark")


def p6_dictionary(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "documents_map").count()
    return frequency.term_dictionary(_t(spark, d, "doc_terms"), n)


def p6_text_grams(spark: SparkSession, d: str) -> DataFrame:
    return frequency.text_grams(_t(spark, d, "documents"), 2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents")).where("n_parts > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every document: all its tokens placed, without overlap, in containers that aren't overfull."""
    places = packing.pack(_t(spark, d, "documents"))
    before = Window.partitionBy("container").orderBy("offset")
    clash = F.coalesce(F.lag(F.col("offset") + F.col("part_tokens")).over(before) > F.col("offset"), F.lit(False))
    checked = places.withColumn("_wrong", F.when(F.col("container").isNotNull(), clash | (F.col("offset") + F.col("part_tokens") > packing.CAPACITY)))
    return checked.groupBy("doc_id").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("n_parts").cast("long").alias("n_parts"), F.coalesce(F.sum("part_tokens"), F.lit(0)).alias("placed_tokens"),
        F.coalesce(F.bool_or("_wrong"), F.lit(False)).alias("wrong"),
    )


def p9_targets(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every source: its target, and that it misses what it can reach by less than its largest document."""
    documents = _t(spark, d, "documents")
    _, report = mixing.mix(documents, _t(spark, d, "mix_targets"))
    largest = mixing.sized_documents(documents).groupBy(F.col("source").alias("name")).agg(F.max("tokens").alias("_largest"))
    reach = F.least("target_tokens", F.col("max_repeats") * F.col("own_tokens"))
    met = F.abs(F.col("mixed_tokens") - reach) <= F.coalesce("_largest", F.lit(0))
    return report.join(largest, "name", "left").select(
        "source", F.round("target_share", 6).alias("target_share"), "own_tokens", "own_documents", F.round("target_tokens", 3).alias("target_tokens"), "short", met.alias("met")
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p9_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1].drop("name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.features(_t(spark, d, "documents"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.cleaned(_t(spark, d, "documents"))


def p2_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.inferred(_t(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(_t(spark, d, "documents")).pairs()


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(_t(spark, d, "documents")).spans()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(_t(spark, d, "documents")).report()


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    return spans.linked_classes(_t(spark, d, "documents"))


def p10_lines(spark: SparkSession, d: str) -> DataFrame:
    return spans.repeated_lines(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_document_map, p2_found, p2_clean, p2_wrappers, p4_found, p4_log_entropy, p6_found, p6_dictionary, p6_text_grams,
        p8_found, p8_containers, p8_placed, p9_found, p9_chosen, p9_shares, p9_targets,
        p10_found, p10_links, p10_spans, p10_report, p10_lines,
    )
}

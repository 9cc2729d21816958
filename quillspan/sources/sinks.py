"""The text forms of index files, as lines to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.runtime import written


def inverted_lines(postings: DataFrame, part: int = 100_000) -> DataFrame:
    """``(term, part, line)`` with lines ``term(|doc,tf)+`` by ascending doc_id, of at most ``part`` documents each.

    A term of more documents takes several lines, cut by rank, so that no task gathers a whole hot term, however its
    doc_ids are spread; :func:`quillspan.sources.corpus.parse_inverted_file` reads them as one. Only the rows of such terms are
    ranked: range partitions by (term, doc_id) are written with their number, rows are counted in each and ranked inside, and
    the counts of the partitions before are added.
    """
    postings = written(postings, "postings")  # read three times
    many = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part).select("term")  # at most rows / part terms
    many = written(many, "hot-terms")
    cold = postings.join(many, "term", "left_anti").select("term", F.lit(0).cast("long").alias("part"), "doc_id", "tf")
    hot = postings.join(many, "term").select("term", "doc_id", "tf").repartitionByRange("term", "doc_id")
    hot = written(hot.withColumn("_at", F.spark_partition_id()), "hot-postings")
    before = Window.partitionBy("term").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = hot.groupBy("term", "_at").agg(F.count(F.lit(1)).alias("_m")).select("term", "_at", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("term", "_at").orderBy("doc_id")
    ranked = hot.withColumn("_r", F.row_number().over(within) - 1).join(counts, ["term", "_at"])
    cut = ranked.select("term", F.floor((F.col("_before") + F.col("_r")) / part).cast("long").alias("part"), "doc_id", "tf")
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))  # compiled; array_sort calls a comparator
    lists = cold.unionByName(cut).groupBy("term", "part").agg(pairs.alias("p"))
    texts = F.transform("p", lambda x: F.concat(x["doc_id"].cast("string"), F.lit(","), x["tf"].cast("string")))
    return lists.select("term", "part", F.concat_ws("|", F.col("term"), F.array_join(texts, "|")).alias("line"))


def name_corpus_files(spark: SparkSession, place: str) -> None:
    """Turns ``file=X/part-...`` under ``place``, one part each, into the corpus layout ``X/X``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(place)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if not name.startswith("file="):
            continue
        own = jvm.org.apache.hadoop.fs.Path(root, name[5:])
        fs.rename(folder.getPath(), own)
        for f in fs.listStatus(own):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(own, name[5:]))


def dictionary_lines(entries: DataFrame, pointer: int = -1) -> DataFrame:
    """``(line)``: ``term|tf|df|pointer``. Tables need no file pointer; a constant fills its place."""
    return entries.select(F.concat_ws("|", "key", F.col("tf").cast("string"), F.col("df").cast("string"), F.lit(str(pointer))).alias("line"))


def document_map_lines(document_map: DataFrame) -> DataFrame:
    """``(doc_id, line)``: ``id|name,max_tf,length(,entity,tf)*``, and with a null doc_id the head line, the total length of all documents."""
    pairs = F.transform("dominant_entities", lambda x: F.concat(F.lit(","), x["entity"], F.lit(","), x["tf"].cast("string")))
    line = F.concat(
        F.col("doc_id").cast("string"), F.lit("|"), "name", F.lit(","), F.col("max_tf").cast("string"), F.lit(","),
        F.col("length").cast("string"), F.array_join(pairs, ""),
    )
    head = document_map.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("string").alias("line"))
    return document_map.select("doc_id", line.alias("line")).unionByName(head.select(F.lit(None).cast("long").alias("doc_id"), "line"))


def synonym_lines(synonyms: DataFrame) -> DataFrame:
    """``(line)``: ``word,sim1,sim2,...``."""
    return synonyms.select(F.concat_ws(",", "word", F.array_join("sims", ",")).alias("line"))

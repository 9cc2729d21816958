"""Dictionary, postings, document map and corpus statistics, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from quillspan.config import EngineConfig
from quillspan.operators.bags import doc_terms
from quillspan.runtime import timed, written

DOMINANT = 5
STOP_WORDS = "stop_words"
DOCUMENTS = "documents"
MAX_STOP_WORDS = 100_000


def terms_dictionary(bags: DataFrame) -> DataFrame:
    """``(key, kind, tf, df)`` of terms: small letters if any document has it without capital initial, else capitals."""
    terms = bags.where("kind = 'term'")
    small = F.bool_or(~F.col("key").rlike(r"^\p{Lu}"))
    return terms.groupBy(F.lower("key").alias("_l")).agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"), small.alias("_small")
    ).select(F.when(F.col("_small"), F.col("_l")).otherwise(F.upper("_l")).alias("key"), F.lit("term").alias("kind"), "tf", "df")


def numbers_dictionary(bags: DataFrame) -> DataFrame:
    """``(key, kind, tf, df)`` of numbers, keys as they are."""
    return bags.where("kind = 'number'").groupBy("key").agg(
        F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")
    ).select("key", F.lit("number").alias("kind"), "tf", "df")


def entities_dictionary(bags: DataFrame, observed: bool = True) -> DataFrame:
    """``(key, kind, tf, df, first_doc)`` of entities of at least two documents.

    Observed: an entity enters with its second document, with that one's frequency as tf and the
    first one's frequency as df; later documents add to both. Otherwise tf and df are the plain counts.
    """
    seen = bags.where("kind = 'entity'").groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("tf").alias("_tf"), F.min("doc_id").alias("first_doc"),
        F.min_by("tf", "doc_id").alias("_first"),
    ).where("_n >= 2")
    tf, df = (F.col("_tf") - F.col("_first"), F.col("_first") + F.col("_n") - 2) if observed else (F.col("_tf"), F.col("_n"))
    return seen.select("key", F.lit("entity").alias("kind"), tf.alias("tf"), df.alias("df"), "first_doc")


def dictionary(bags: DataFrame, observed: bool = True, entities: DataFrame | None = None) -> DataFrame:
    """``(key, kind, tf, df)`` of all kinds; ``entities`` as :func:`entities_dictionary` gives them, where they are made already."""
    entities = (entities_dictionary(bags, observed) if entities is None else entities).drop("first_doc")
    return terms_dictionary(bags).unionByName(numbers_dictionary(bags)).unionByName(entities)


def entity_bags(bags: DataFrame, observed: bool = True, entities: DataFrame | None = None) -> DataFrame:
    """The entity rows that reach the postings: of entities in the dictionary, observed without each one's first document."""
    known = (entities_dictionary(bags, observed) if entities is None else entities).select("key", "first_doc")
    rows = bags.where("kind = 'entity'").join(known, "key")
    return (rows.where("doc_id <> first_doc") if observed else rows).select("doc_id", "kind", "key", "tf")


def postings(bags: DataFrame, observed: bool = True, entities: DataFrame | None = None) -> DataFrame:
    """``(term, doc_id, tf)`` with the term in small letters, a document's rows in one partition."""
    rows = bags.where("kind <> 'entity'").select("doc_id", "kind", "key", "tf").unionByName(entity_bags(bags, observed, entities))
    return rows.repartition("doc_id").groupBy(F.lower("key").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))


def by_document(posted: DataFrame) -> DataFrame:
    """``(doc_id, length, posted)`` from postings with length: a document's ``(term, tf)`` in one row."""
    return posted.groupBy("doc_id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "tf")).alias("posted"))


def with_lengths(posted: DataFrame, doc_map: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, length)``; postings that have the length stay as they are."""
    return posted if "length" in posted.columns else posted.join(doc_map.select("doc_id", "length"), "doc_id").select("term", "doc_id", "tf", "length")


def document_map(bags: DataFrame, docs: DataFrame, name: str = "docno", observed: bool = True, entities: DataFrame | None = None) -> DataFrame:
    """``(doc_id, name, max_tf, length, dominant_entities)``; documents without any text count with length 0.

    The five entities with the highest tf that reach the postings, equal tf by name descending; kept
    in a bounded heap per document that is merged after the shuffle.
    """
    sizes = bags.groupBy("doc_id").agg(F.max("tf").alias("_max"), F.sum("tf").alias("_length"))
    pair = F.struct("tf", F.col("key").alias("entity"))
    top = entity_bags(bags, observed, entities).groupBy("doc_id").agg(InternalFunction.collect_top_k(pair, DOMINANT, False).alias("_top"))
    ordered = F.transform("_top", lambda x: F.struct(x["entity"].alias("entity"), x["tf"].alias("tf")))
    empty = F.array().cast("array<struct<entity:string,tf:bigint>>")
    return docs.select("doc_id", F.trim(F.col(name)).alias("name")).join(sizes, "doc_id", "left").join(
        top.select("doc_id", ordered.alias("_list")), "doc_id", "left"
    ).select(
        "doc_id", "name", F.greatest(F.lit(1), F.coalesce("_max", F.lit(1))).cast("long").alias("max_tf"),
        F.coalesce("_length", F.lit(0)).alias("length"), F.coalesce("_list", empty).alias("dominant_entities"),
    )


def corpus_stats(doc_map: DataFrame) -> DataFrame:
    """``(n, total_len, avgdl)``, one row."""
    return doc_map.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_len"), F.avg("length").alias("avgdl")
    )


def normal_dictionary(entries: DataFrame) -> DataFrame:
    """``(lkey, key, kind, df)``: one entry per key in small letters; entities go before terms before numbers."""
    rank = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "term", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), "key", "kind", "df"))
    return entries.groupBy(F.lower("key").alias("lkey")).agg(best.alias("b")).select("lkey", "b.key", "b.kind", "b.df")


def lookup(entries: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """``(asked, key, kind, tf, df)``: the entry of each asked key, whatever its case; keys without entry are left out.

    Entities go first, then the key to the letter, then in small letters, then others.
    """
    rank = F.when(F.col("kind") == "entity", 0).when(F.col("key") == F.col("asked"), 1).when(F.col("key") == F.lower("key"), 2).otherwise(3)
    asked = keys.select(F.col(column).alias("asked")).where("asked is not null").distinct().withColumn("lkey", F.lower("asked"))
    hits = asked.join(entries.withColumn("lkey", F.lower("key")), "lkey")
    best = hits.groupBy("asked").agg(F.min(F.struct(rank.alias("r"), "key", "kind", "tf", "df")).alias("b"))
    return best.select("asked", "b.key", "b.kind", "b.tf", "b.df")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class Index:
    """The tables of an index, and the seconds that each took where they were made here."""

    doc_terms: DataFrame
    dictionary: DataFrame
    postings: DataFrame
    document_map: DataFrame
    config: EngineConfig
    seconds: dict[str, float] = field(default_factory=dict)
    documents: DataFrame | None = None

    TABLES = ("doc_terms", "dictionary", "postings", "document_map")

    @classmethod
    def build(cls, sections: DataFrame, docs: DataFrame, config: EngineConfig = EngineConfig(), name: str = "docno") -> Index:
        """Index of ``sections``; the bags, from which all tables come, are made once and written."""
        with timed("bags") as took:
            bags = written(doc_terms(sections, config), "doc-terms")
        index = cls.of_bags(bags, docs, config, name)
        index.seconds["bags"] = took[0]
        return index

    @classmethod
    def of_bags(cls, bags: DataFrame, docs: DataFrame, config: EngineConfig = EngineConfig(), name: str = "docno") -> Index:
        """Index of bags that are made; each of its tables is written once. Postings carry their document's length and are written by document."""
        o, seconds = config.observed, {}

        def made(df: DataFrame, what: str) -> DataFrame:
            with timed(what) as took:
                table = written(df, what.replace(" ", "-"))
            seconds[what] = took[0]
            return table

        entities = made(entities_dictionary(bags, o), "entities")
        doc_map = made(document_map(bags, docs, name, o, entities), "document map")
        documents = made(by_document(with_lengths(postings(bags, o, entities), doc_map)), "postings")
        posted = documents.select("doc_id", "length", F.explode("posted").alias("p")).select("p.term", "doc_id", "p.tf", "length")
        return cls(bags, made(dictionary(bags, o, entities), "dictionary"), posted, doc_map, config, seconds, documents)

    def by_document(self) -> DataFrame:
        """The postings with a row per document: as written, or gathered from the rows of an index that was saved without."""
        return by_document(with_lengths(self.postings, self.document_map)) if self.documents is None else self.documents

    def save(self) -> None:
        """Writes the tables under ``config.place``.

        Postings carry their document's length, so that searches need no join for it, and are sorted by term within range
        partitions, so that readers skip row groups; searches of batches read them with a row per document.
        """
        place = self.config.place
        self.doc_terms.write.mode("overwrite").parquet(f"{place}/doc_terms")
        self.dictionary.write.mode("overwrite").parquet(f"{place}/dictionary")
        by_term = with_lengths(self.postings, self.document_map).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        by_term.write.mode("overwrite").parquet(f"{place}/postings")
        self.document_map.write.mode("overwrite").parquet(f"{place}/document_map")
        self.by_document().write.mode("overwrite").parquet(f"{place}/{DOCUMENTS}")
        words = self.doc_terms.sparkSession.createDataFrame([(w,) for w in self.config.stop_words], "word string")
        words.write.mode("overwrite").parquet(f"{place}/{STOP_WORDS}")

    @classmethod
    def load(cls, spark: SparkSession, config: EngineConfig) -> Index:
        """The saved index, with the stop words it was built with, so that queries are parsed alike; without one there is an error."""
        missing = [t for t in (*cls.TABLES, STOP_WORDS) if not _exists(spark, f"{config.place}/{t}")]
        if missing:
            raise ValueError(f"no index was found at {config.place}: {', '.join(missing)} missing")
        rows = spark.read.parquet(f"{config.place}/{STOP_WORDS}").limit(MAX_STOP_WORDS + 1).collect()
        if len(rows) > MAX_STOP_WORDS:
            raise ValueError(f"more than {MAX_STOP_WORDS} stop words")
        words = tuple(r[0] for r in rows)
        index = cls(*(spark.read.parquet(f"{config.place}/{t}") for t in cls.TABLES), replace(config, stop_words=words))
        index.documents = spark.read.parquet(f"{config.place}/{DOCUMENTS}") if _exists(spark, f"{config.place}/{DOCUMENTS}") else None
        return index

    @staticmethod
    def reset(spark: SparkSession, config: EngineConfig) -> None:
        """Deletes the tables of the index; stop words and other files of the folder stay."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for t in (*Index.TABLES, DOCUMENTS):
            p = jvm.org.apache.hadoop.fs.Path(f"{config.place}/{t}")
            p.getFileSystem(conf).delete(p, True)

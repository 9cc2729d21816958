"""Queries of the search engine over the supplied tables.

``documents`` is the corpus, one plain section per document, and, as tagged text, the ``trec`` rows of ``raw_records``.
Queries are the documents whose id is divisible by 100, with their whole texts. ``embeddings`` gives word vectors: the n-th most
frequent term has vector n - 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.config import EngineConfig
from quillspan.functions import lexicon as L
from quillspan.functions.text import accepted, hyphened, is_upper, listed, java_hash, skipped
from quillspan.functions.text import clean as clean_text_of
from quillspan.operators import bags as B
from quillspan.operators import index as I
from quillspan.operators import report as R
from quillspan.operators import search as S
from quillspan.operators import synonyms as Y
from quillspan.plans.topics import TOPICS
from quillspan.sources import corpus as C
from quillspan.runtime import kept_path, numbered, ship, spread, written
from quillspan.sources import sinks as K

PLAIN = EngineConfig()
STEMMED = EngineConfig(stem=True)
SEMANTIC = EngineConfig(semantic=True)
INTENDED = EngineConfig(observed=False)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _trec(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "raw_records").where("fmt = 'trec' and raw is not null").select(F.col("record_id").alias("doc_id"), "raw")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_t(spark, d, "documents").select("doc_id", "docno", "text"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return B.plain_sections(_docs(spark, d))


def _bags(spark: SparkSession, d: str, config: EngineConfig = PLAIN) -> DataFrame:
    return B.doc_terms(_sections(spark, d), config)


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """The bags, written once for queries that read them several times."""
    return written(_bags(spark, d), "doc-terms")


def _index(spark: SparkSession, d: str, config: EngineConfig = PLAIN) -> I.Index:
    return I.Index.build(_sections(spark, d), _docs(spark, d), config)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _flat(doc_map: DataFrame) -> DataFrame:
    """The entity list as text, ``entity:tf`` in order."""
    pairs = F.transform("dominant_entities", lambda x: F.concat_ws(":", x["entity"], x["tf"].cast("string")))
    return doc_map.withColumn("dominant_entities", F.array_join(pairs, "; "))


# --- Sources -----------------------------------------------------------------------------------

@_query
def doc_split(spark: SparkSession, d: str) -> DataFrame:
    raw = _trec(spark, d)
    return raw.select("doc_id", F.explode(F.regexp_extract_all("raw", F.lit(C.DOC), F.lit(0))).alias("doc"))


@_query
def docno_extract(spark: SparkSession, d: str) -> DataFrame:
    return _trec(spark, d).select("doc_id", C.docno(F.col("raw"), strict=False).alias("docno"))


@_query
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("raw", F.lit(r"(?s)<TEXT>(.+?)</TEXT>"), F.lit(0))
    return _trec(spark, d).select("doc_id", F.posexplode_outer(found).alias("sec", "body"))


# --- Tokenizer ---------------------------------------------------------------------------------

@_query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", clean_text_of(F.col("text")).alias("clean"))


@_query
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = F.explode(F.flatten(F.transform("tokens", lambda t: F.regexp_extract_all(t, F.lit(L.WORD), F.lit(0))))).alias("word")
    return _sections(spark, d).select("doc_id", words).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@_query
def hyphen_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.explode(hyphened(F.col("clean"))).alias("term")
    return _sections(spark, d).select("doc_id", terms).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@_query
def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return B.matches(_sections(spark, d), "doc_id").groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"))


@_query
def number_context(spark: SparkSession, d: str) -> DataFrame:
    return B.matches(_sections(spark, d), "doc_id")


@_query
def number_format(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions.numbers import number_string

    price = _t(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v")).distinct()
    return price.select(F.col("v").alias("value"), number_string(F.col("v")).alias("text"), number_string(F.col("v") / 1000).alias("thousands"))


def _rule(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return B.number_matches(_sections(spark, d)).where(F.col("rule") == name).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))

    QUERIES[f"rule_{name}"] = run


for _name in ("date", "percent", "dollars", "distance", "weight", "between", "plain", "fraction"):
    _rule(_name)


@_query
def number_terms(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).where("kind = 'number'").select("doc_id", "key", "tf")


@_query
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    tested = F.when(is_upper(w), F.lower(w)).otherwise(w)
    return word_tokens(spark, d).withColumn("_t", tested).where(~listed("_t", L.STOP_WORDS)).drop("_t")


@_query
def word_number_filter(spark: SparkSession, d: str) -> DataFrame:
    return word_tokens(spark, d).where(accepted(F.col("word")) & ~skipped(F.col("word")))


@_query
def capital_case_fold(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).where("kind = 'term'").select("doc_id", F.col("key").alias("term"), "tf")


@_query
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d).where("kind = 'entity'").select("doc_id", F.col("key").alias("entity"), "tf")


@_query
def porter_stem(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions.porter import stem_column

    words = _bags(spark, d).where("kind = 'term'").select(F.lower("key").alias("word")).distinct()
    return words.select("word", stem_column(F.col("word")).alias("stem"))


# --- Bags, dictionary, postings, document map ---------------------------------------------------

@_query
def doc_term_bags(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d)


@_query
def doc_term_bags_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return _bags(spark, d, STEMMED)


@_query
def tagged_doc_bags(spark: SparkSession, d: str) -> DataFrame:
    return B.doc_terms(B.tagged_sections(_trec(spark, d)), PLAIN)


@_query
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.document_map(_kept(spark, d), _docs(spark, d)).select("doc_id", "max_tf", "length")


@_query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    doc_map = I.document_map(_kept(spark, d), _docs(spark, d))
    return I.corpus_stats(doc_map).select("n", "total_len", F.round("avgdl", 6).alias("avgdl"))


@_query
def dictionary_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.terms_dictionary(_bags(spark, d))


@_query
def dictionary_numbers(spark: SparkSession, d: str) -> DataFrame:
    return I.numbers_dictionary(_bags(spark, d))


@_query
def dictionary_entities(spark: SparkSession, d: str) -> DataFrame:
    return I.entities_dictionary(_bags(spark, d)).drop("first_doc")


@_query
def dictionary_entities_intended(spark: SparkSession, d: str) -> DataFrame:
    return I.entities_dictionary(_bags(spark, d), observed=False).drop("first_doc")


@_query
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = _t(spark, d, "postings").select(F.col("term").alias("key")).where("term is not null").distinct()
    return I.lookup(I.dictionary(_kept(spark, d)), asked)


@_query
def dictionary_view(spark: SparkSession, d: str) -> DataFrame:
    return R.dictionary_view(I.dictionary(_kept(spark, d)))


@_query
def postings(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(_kept(spark, d))


@_query
def inverted_file_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.inverted_lines(I.postings(_kept(spark, d)), part=100)


@_query
def inverted_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_inverted_file(K.inverted_lines(I.postings(_kept(spark, d))), "line")


@_query
def dictionary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_dictionary(K.dictionary_lines(I.dictionary(_kept(spark, d))), "line")


@_query
def document_map(spark: SparkSession, d: str) -> DataFrame:
    return _flat(I.document_map(_kept(spark, d), _docs(spark, d)))


@_query
def document_map_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.document_map_lines(I.document_map(_kept(spark, d), _docs(spark, d)))


@_query
def document_map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _flat(C.parse_document_map(K.document_map_lines(I.document_map(_kept(spark, d), _docs(spark, d))), "line"))


@_query
def dominant_entities(spark: SparkSession, d: str) -> DataFrame:
    doc_map = I.document_map(_kept(spark, d), _docs(spark, d))
    return doc_map.select("doc_id", F.posexplode("dominant_entities").alias("at", "e")).select("doc_id", (F.col("at") + 1).alias("place"), "e.*")


# --- Synonyms ----------------------------------------------------------------------------------

def _vectors(spark: SparkSession, d: str, bags: DataFrame) -> DataFrame:
    """``(vec_id, word, vector)``: as many of the most frequent terms as there are vectors."""
    vectors = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    ranked = numbered(I.terms_dictionary(bags).select("key", "tf"), F.desc("tf"), "key").withColumnRenamed("_rank", "vec_id")
    return ranked.join(vectors, "vec_id").select("vec_id", F.lower("key").alias("word"), "vector")


def _similar(spark: SparkSession, d: str, bags: DataFrame, asked: str = "vec_id % 100 = 0") -> DataFrame:
    """The similar words of the ``asked`` ones among those that have a vector."""
    vectors = written(_vectors(spark, d, bags), "word-vectors")
    return Y.similar(vectors.select("word", "vector"), vectors.where(asked).select("word"))


@_query
def synonym_cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, _bags(spark, d))


@_query
def synonym_filter(spark: SparkSession, d: str) -> DataFrame:
    made = _t(spark, d, "dictionary").where("key is not null").select(F.lower("key").alias("word")).distinct().withColumn("sims", F.array("word"))
    return Y.known(made, I.dictionary(_kept(spark, d))).select("word")


# --- Search ------------------------------------------------------------------------------------

@_query
def query_parse(spark: SparkSession, d: str) -> DataFrame:
    return S.parse_queries(_queries(spark, d), PLAIN)


@_query
def query_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("docno", java_hash(F.col("docno")).cast("long").alias("query_id"))


@_query
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    terms = S.parse_queries(_queries(spark, d), SEMANTIC)
    bags = _kept(spark, d)
    return S.expand(terms, Y.as_lists(_similar(spark, d, bags)), I.dictionary(bags))


@_query
def candidates(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return S.candidates(S.query_terms(_queries(spark, d), index), index)


@_query
def bm25_unstemmed(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_queries(spark, d), _index(spark, d))


@_query
def bm25_intended(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_queries(spark, d), _index(spark, d, INTENDED))


@_query
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return S.search(_queries(spark, d), _index(spark, d, STEMMED))


@_query
def semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d, SEMANTIC)
    return S.search(_queries(spark, d), index, Y.as_lists(_similar(spark, d, index.doc_terms, asked="true")))


@_query
def topk_padded(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d).union(spark.createDataFrame([(-1, "of the")], "query_id long, text string"))
    return S.search(asked, _index(spark, d, EngineConfig(pad=True)))


@_query
def run_file(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return R.run_lines(S.search(_queries(spark, d), index), index.document_map)


@_query
def result_names_entities(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    named = R.named_results(S.search(_queries(spark, d), index), index.document_map)
    return named.withColumn("entities", F.array_join("entities", "; "))


@_query
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.index_stats(_index(spark, d))


def _tagged_corpus(spark: SparkSession, d: str) -> str:
    """A corpus folder with the documents as tagged text, files of about 5 000: ``X/X`` in a folder that is deleted with the other tables."""
    docs = _docs(spark, d)
    files = 1 + docs.count() // 5000
    raw = F.concat(F.lit("<DOC>\n<DOCNO> "), "docno", F.lit(" </DOCNO>\n<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n</DOC>\n"))
    rows = docs.select(raw.alias("value"), F.pmod("doc_id", F.lit(files)).alias("file"))
    place = kept_path(spark, "corpus")
    rows.repartition("file").write.partitionBy("file").text(place)
    K.name_corpus_files(spark, place)
    return place


#: The running number of the original, which orders documents: the last part of their docno.
_NUMBERED = r"cast(regexp_extract(docno, '-([0-9]+)$', 1) as long)"


@_query
def corpus_to_run(spark: SparkSession, d: str) -> DataFrame:
    """From files to a run file: tagged corpus, saved and loaded index, topics file, run lines."""
    docs = C.read_corpus(spark, _tagged_corpus(spark, d), doc_id=F.expr(_NUMBERED))
    config = EngineConfig(index_path=kept_path(spark, "index"))
    I.Index.build(B.tagged_sections(spread(docs)), docs, config).save()
    topic = F.concat(
        F.lit("<top>\n<num> Number: "), "query_id", F.lit("\n<title> "), "docno", F.lit("\n<desc> Description:\n"),
        F.regexp_replace("text", r"[\r\n<]", " "), F.lit("\n</top>\n"),
    )
    topics = kept_path(spark, "topics")
    asked = _docs(spark, d).where("doc_id % 100 = 0 and text is not null").withColumnRenamed("doc_id", "query_id")
    asked.select(topic.alias("value")).write.text(topics)
    index = I.Index.load(spark, config)
    ranked = S.search(C.parse_topics(spark.read.text(topics, wholetext=True)), index)
    run = kept_path(spark, "run")
    R.write_run_file(R.run_lines(ranked, index.document_map), run)
    return spark.read.text(run).select(F.col("value").alias("line"))


@_query
def topics_parse(spark: SparkSession, d: str) -> DataFrame:
    return C.parse_topics(spark.createDataFrame([(TOPICS,)], "value string"))

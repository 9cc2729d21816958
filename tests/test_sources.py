import pytest
from pyspark.sql import functions as F

from quillspan.config import EngineConfig
from quillspan.functions.text import java_hash
from quillspan.operators import index
from quillspan.plans.topics import TOPICS
from quillspan.sources import corpus as C
from quillspan.sources import sinks as K


def test_corpus(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / "corpus" / name).mkdir(parents=True)
        (tmp_path / "corpus" / name / name).write_text(f"<DOC><DOCNO> {name}1 </DOCNO><TEXT>x</TEXT></DOC>\n<DOC>\n<DOCNO>{name}2</DOCNO></DOC><DOC>cut")
    (tmp_path / "corpus" / "A" / "other").write_text("<DOC><DOCNO>no</DOCNO></DOC>")
    docs = C.read_corpus(spark, str(tmp_path / "corpus"))
    assert sorted(r.docno for r in docs.collect()) == ["A1", "A2", "B1", "B2"]
    assert docs.select("doc_id").distinct().count() == 4
    with pytest.raises(Exception):
        C.read_corpus(spark, str(tmp_path / "nowhere")).collect()


def test_docno(spark):
    df = spark.createDataFrame([("<DOC></DOC>",)], "raw string")
    assert df.select(C.docno(F.col("raw"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="DOCNO"):
        df.select(C.docno(F.col("raw"))).collect()


def test_topics(spark):
    got = {r.query_id: r.text for r in C.parse_topics(spark.createDataFrame([(TOPICS,)], "value string")).collect()}
    assert got[351].startswith("Falkland petroleum explorationWhat information") and "fishing" not in got[351] and "More" not in got[351]
    assert got[352] == "Tunnel impactWhich effects had the tunnel?\nEconomic effects count.\n"


def test_word_files(spark, tmp_path):
    (tmp_path / "s").write_text("the\nof\n")
    assert C.read_stop_words(spark, str(tmp_path / "s")) == ("the", "of")
    assert C.read_stop_words(spark, str(tmp_path / "none")) == ()
    syn = C.parse_synonyms(spark.createDataFrame([("cat,dog,cow",), ("x",)], "value string"))
    assert [(r.word, r.sims) for r in syn.collect()] == [("cat", ["dog", "cow"]), ("x", [])]
    assert [r[0] for r in K.synonym_lines(syn.limit(1)).collect()] == ["cat,dog,cow"]


def test_corrupt_files(spark):
    with pytest.raises(Exception, match="corrupted"):
        C.parse_dictionary(spark.createDataFrame([("a|1|2",)], "value string")).collect()
    with pytest.raises(Exception, match="corrupted"):
        C.parse_document_map(spark.createDataFrame([("1|a,1",)], "value string")).collect()


def test_inverted_lines_of_a_hot_term(spark):
    post = spark.range(1000).select(F.lit("hot").alias("term"), (F.col("id") * 3).alias("doc_id"), F.lit(1).cast("long").alias("tf"))
    lines = K.inverted_lines(post, part=100)
    assert lines.count() == 10
    assert C.parse_inverted_file(lines, "line").exceptAll(post).count() == 0


@pytest.mark.parametrize("doc_id", ["xxhash64(id)", "case when id < 999 then id else 9223372036854775807 end", "id * 3 - 1500"])
def test_inverted_lines_of_uneven_ids(spark, doc_id):
    post = spark.range(1000).selectExpr("'hot' as term", f"{doc_id} as doc_id", "cast(1 as long) as tf").union(spark.sql("select 'cold', 5L, 2L")).repartition(7)
    for part in (1, 100, 999):
        lines = K.inverted_lines(post, part=part).cache()
        got = C.parse_inverted_file(lines, "line")
        assert got.exceptAll(post).count() == 0 and got.count() == 1001
        sizes = {r.part: r.line.count("|") for r in lines.where("term = 'hot'").collect()}
        assert sizes == {i: min(part, 1000 - i * part) for i in range(-(-1000 // part))}
        ids = [[int(p.split(",")[0]) for p in r.line.split("|")[1:]] for r in lines.where("term = 'hot'").orderBy("part").collect()]
        assert sum(ids, []) == sorted(sum(ids, []))


def test_hashes_of_any_character(spark):
    def java(text):
        h = 0
        for i in range(0, len(b := text.encode("utf-16-be")), 2):
            h = (31 * h + b[i] * 256 + b[i + 1]) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "Falkland petroleum exploration", "é", "\U0001f600", "x\U0001f600y" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", java_hash(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: java(t) for t in texts} and java("\U0001f600") == 1772899


def test_heads_of_document_maps(spark):
    doc_map = spark.createDataFrame([(1, "a", 2, 5, []), (2, "b", 1, 7, [("X Y", 3)])], "doc_id long, name string, max_tf long, length long, dominant_entities array<struct<entity:string,tf:long>>")
    lines = K.document_map_lines(doc_map)
    assert C.parse_document_map_head(lines, "line").collect()[0][0] == 12
    assert sorted(C.parse_document_map(lines, "line").collect()) == sorted(doc_map.collect())
    assert C.parse_document_map_head(K.document_map_lines(doc_map.limit(0)), "line").collect()[0][0] == 0


def test_stop_words_that_cannot_be_read(spark, tmp_path, monkeypatch):
    assert C.read_stop_words(spark, str(tmp_path / "none")) == ()
    with pytest.raises(Exception):
        C.read_stop_words(spark, "nosuchscheme://x/y")
    (tmp_path / "s").write_text("a\nb\nc\n")
    with pytest.raises(ValueError):
        C.read_stop_words(spark, str(tmp_path / "s"), most=2)
    place = EngineConfig(index_path=str(tmp_path))
    with pytest.raises(ValueError, match="no index was found"):
        index.Index.load(spark, place)
    for table in (*index.Index.TABLES, index.STOP_WORDS):
        spark.range(5).selectExpr("string(id) as word").write.parquet(f"{place.place}/{table}")
    monkeypatch.setattr(index, "MAX_STOP_WORDS", 4)
    with pytest.raises(ValueError, match="stop words"):
        index.Index.load(spark, place)


def test_config(tmp_path):
    path = str(tmp_path / "c.properties")
    assert EngineConfig.load(path) == EngineConfig()
    EngineConfig(stem=True, index_path="/x").save(path)
    with open(path, "a") as f:
        f.write("ParserBatchSize=25\n")
    assert EngineConfig.load(path).batch_size == 25
    with open(path, "a") as f:
        f.write("ParserBatchSize=12345\n")
    with pytest.raises(ValueError, match="ParserBatchSize"):
        EngineConfig.load(path)
    EngineConfig(stem=True, index_path="/x").save(path)
    got = EngineConfig.load(path)
    assert got.stem and got.place == "/x/stemmed=true" and (got.k, got.b) == (0.4, 0.9)


def test_inverted_lines_read_their_postings_once_and_sort_in_compiled_code(spark, monkeypatch):
    from quillspan.sources import sinks

    tags, keep = [], sinks.written
    monkeypatch.setattr(sinks, "written", lambda df, tag: (tags.append(tag), keep(df, tag))[1])
    lines = sinks.inverted_lines(spark.createDataFrame([("a", 10, 1), ("a", 9, 2), ("a", 2, 3), ("b", 1, 1)], "term string, doc_id long, tf long"), part=2)
    assert tags[0] == "postings" and "lambdafunction((if" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.line for r in lines.collect()) == ["a|10,1", "a|2,3|9,2", "b|1,1"]


def test_a_line_of_the_inverted_file_is_not_split_for_each_document(spark):
    from quillspan.sources import corpus

    lines = spark.createDataFrame([("a|1,2|3,4",), ("b|5,6",)], "line string")
    got = corpus.parse_inverted_file(lines, "line")
    assert "split(line" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("a", 3, 4), ("b", 5, 6)]

import math

import pytest

from quillspan.config import EngineConfig
from quillspan.operators import index as I
from quillspan.operators import report as R
from quillspan.operators import search as S
from quillspan.operators import synonyms as Y
from quillspan.streaming.append import append_bags, live_document_frequency

BAGS = "doc_id long, kind string, key string, tf long"


def bags(spark, rows):
    return spark.createDataFrame(rows, BAGS)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_case_folding(spark):
    b = bags(spark, [(0, "term", "HOUSE", 2), (1, "term", "house", 1), (2, "term", "HOUSE", 1), (0, "term", "PARIS", 1), (1, "term", "PARIS", 2)])
    assert rows(I.terms_dictionary(b), "key", "tf", "df") == [("PARIS", 3, 2), ("house", 4, 3)]
    assert ("paris", 1, 2) in rows(I.postings(b), "term", "doc_id", "tf")


def test_entities(spark):
    b = bags(spark, [(0, "entity", "A B", 3), (1, "entity", "A B", 1), (2, "entity", "A B", 2), (0, "entity", "ONE DOC", 9)])
    assert rows(I.entities_dictionary(b), "key", "tf", "df") == [("A B", 3, 4)]
    assert rows(I.entities_dictionary(b, observed=False), "key", "tf", "df") == [("A B", 6, 3)]
    assert rows(I.postings(b), "term", "doc_id", "tf") == [("a b", 1, 1), ("a b", 2, 2)]


def test_document_map(spark):
    names = [f"{c} {c}" for c in "ABCDEFG"]
    b = bags(spark, [(d, "entity", n, 1) for d in (1, 2) for n in names] + [(2, "term", "x1", 4)])
    docs = spark.createDataFrame([(1, " a "), (2, "b"), (3, "c")], "doc_id long, docno string")
    got = {r.doc_id: r for r in I.document_map(b, docs).collect()}
    assert [e.entity for e in got[2].dominant_entities] == ["G G", "F F", "E E", "D D", "C C"]
    assert (got[2].name, got[2].max_tf, got[2].length) == ("b", 4, 11)
    assert (got[1].name, got[1].dominant_entities) == ("a", [])  # each entity's first document has no posting
    assert (got[3].max_tf, got[3].length, got[3].dominant_entities) == (1, 0, [])


def _index(spark, config):
    b = bags(spark, [(1, "term", "fish", 2), (1, "term", "pond", 2), (2, "term", "rock", 4), (3, "term", "sand", 4)])
    docs = spark.createDataFrame([(i, str(i)) for i in (1, 2, 3)], "doc_id long, docno string")
    return I.Index.of_bags(b, docs, config)


@pytest.mark.parametrize("config, score", [
    (EngineConfig(), 2 * 2 / 3 * math.log10(4)), (EngineConfig(stem=True), 1.4 * 2 / 2.4 * math.log10(4)),
    (EngineConfig(semantic=True), 0.4 * 2 * 2 / 3 * math.log10(3)),
])
def test_scores(spark, config, score):
    q = spark.createDataFrame([(7, "fish")], "query_id long, text string")
    got = S.search(q, _index(spark, config)).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in got] == [(7, 1, 1)]
    assert got[0].score == pytest.approx(score, abs=1e-6)


def test_scores_without_broadcast(spark, monkeypatch):
    index = _index(spark, EngineConfig(stop_words=()))
    asked = spark.createDataFrame([(1, "fish pond rock"), (2, "sand rock rock")], "query_id long, text string")
    small = sorted(S.scores(S.query_terms(asked, index), index).collect())
    assert [(r.query_id, r.doc_id) for r in small] == [(1, 1), (1, 2), (2, 2), (2, 3)]
    monkeypatch.setattr(S, "BROADCAST_WEIGHTS", 0)
    assert small == sorted(S.scores(S.query_terms(asked, index), index).collect())


def test_free_text(spark):
    q = S.hashed_queries(spark.createDataFrame([("fish",), ("fish",), ("the",)], "text string"))
    ranked = S.search(q, _index(spark, EngineConfig()))
    assert [r.doc_id for r in R.results_of_text(ranked, "fish").collect()] == [1]
    assert R.results_of_text(ranked, "the").count() == 0 and q.count() == 2


def test_capital_keys_only_bring_candidates(spark):
    q = spark.createDataFrame([(7, "Fish")], "query_id long, text string")
    assert [(r.doc_id, r.score) for r in S.search(q, _index(spark, EngineConfig())).collect()] == [(1, 0.0)]
    assert S.search(q, _index(spark, EngineConfig(observed=False))).collect()[0].score > 0.8


def test_top_and_padding(spark):
    scored = spark.createDataFrame([(1, d, 2.0) for d in range(60)], "query_id long, doc_id long, score double")
    assert rows(S.top(scored, 50), "doc_id", "rank") == [(d, d + 1) for d in range(50)]
    q = spark.createDataFrame([(7, "fish"), (8, "the")], "query_id long, text string")
    got = rows(S.search(q, _index(spark, EngineConfig(pad=True, top_k=3))), "query_id", "rank", "doc_id")
    assert got == [(7, 1, 1), (7, 2, 0), (7, 3, 0), (8, 1, 0), (8, 2, 0), (8, 3, 0)]


def test_expansion(spark):
    terms = spark.createDataFrame([(1, "term", "fish", 1), (1, "term", "Fish", 1), (1, "number", "fish", 1)], "query_id long, kind string, key string, qtf long")
    syn = spark.createDataFrame([("fish", ["none", "POND", "rock", "sand"])], "word string, sims array<string>")
    got = S.expand(terms, syn, _index(spark, EngineConfig()).dictionary)
    assert rows(got, "query_id", "kind", "key", "qtf") == [(1, "semantic", "POND", 1), (1, "semantic", "rock", 1)]


def test_save_load_reset(spark, tmp_path):
    config = EngineConfig(index_path=str(tmp_path / "ix"), stop_words=("zzz",))
    index = _index(spark, config)
    index.save()
    back = I.Index.load(spark, EngineConfig(index_path=config.index_path))
    assert back.config.stop_words == ("zzz",)
    assert rows(back.postings, "term", "doc_id", "tf") == rows(index.postings, "term", "doc_id", "tf")
    q = spark.createDataFrame([(7, "fish"), (8, "rock sand")], "query_id long, text string")
    assert S.search(q, back).exceptAll(S.search(q, index)).count() == 0 and S.search(q, back).count() == 3
    I.Index.reset(spark, config)
    with pytest.raises(Exception):
        I.Index.load(spark, config)


def test_reports(spark):
    index = _index(spark, EngineConfig())
    ranked = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.25)], "query_id long, rank int, doc_id long, score double")
    assert rows(R.run_lines(ranked, index.document_map), "line") == [("1 0 2 10 9 mt",), ("1 0 3 10 9 mt",)]
    assert rows(R.run_lines(ranked, index.document_map, True), "line") == [("1 0 2 1 0.5 mt",), ("1 0 3 2 0.25 mt",)]
    bad = spark.createDataFrame([(1, 1, 99, 0.5)], "query_id long, rank int, doc_id long, score double")
    with pytest.raises(Exception, match="unknown document"):
        R.run_lines(bad, index.document_map).collect()
    relevant = spark.createDataFrame([(1, 3), (1, 9)], "query_id long, doc_id long")
    assert rows(R.precision_at(ranked, relevant, 2), "precision", "average_precision") == [(0.5, 0.25)]


def test_synonyms(spark):
    v = spark.createDataFrame([("Cat", [1.0, 0.0]), ("cat", [0.0, 1.0]), ("dog", [1.0, 1.0]), ("ant", [1.0, -1.0]), ("nil", [0.0, 0.0])], "word string, vector array<double>")
    avg = Y.averaged(v)
    assert ("cat", [0.5, 0.5]) in rows(avg, "word", "vector")
    got = Y.similar(avg, avg.select("word"), k=2)
    assert rows(got.where("word = 'cat'"), "rank", "sim", "cosine") == [(1, "dog", 1.0), (2, "ant", 0.0)]
    assert rows(got.where("word = 'nil'"), "rank") == []
    a = spark.createDataFrame([("x", ["1"])], "word string, sims array<string>")
    b = spark.createDataFrame([("x", ["2"]), ("y", ["3"])], "word string, sims array<string>")
    assert rows(Y.preferred(a, b), "word", "sims") == [("x", ["1"]), ("y", ["3"])]


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fish pond"), (2, "rock")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    append_bags(stream, EngineConfig(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "doc_id", "key") == [(1, "fish"), (1, "pond"), (2, "rock")]
    d = "/root/testdata/sf0.001/postings.parquet"
    import os

    if os.path.exists(d):
        static = spark.read.parquet(d)
        static.write.parquet(str(tmp_path / "p"))
        live = live_document_frequency(spark.readStream.schema(static.schema).parquet(str(tmp_path / "p")))
        q = live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
        q.awaitTermination()
        n = static.where("term is not null and flushed_at is not null").count()
        assert spark.sql("select sum(n_rows) from live").first()[0] == n


def test_semantic_rank_knows_the_similar_words_of_every_vector(spark, monkeypatch):
    import os

    from quillspan.plans import search as P

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    monkeypatch.setattr(P.S, "search", lambda queries, index, synonyms: (index, synonyms))
    index, synonyms = P.semantic_rank(spark, d)
    assert synonyms.count() == min(spark.read.parquet(f"{d}/embeddings.parquet").count(), I.terms_dictionary(index.doc_terms).count())


def test_a_loaded_index_has_its_postings_by_document(spark, tmp_path):
    config = EngineConfig(index_path=str(tmp_path))
    index = _index(spark, config)
    index.save()
    back = I.Index.load(spark, config)
    assert sorted((r.doc_id, r.length, sorted(r.posted)) for r in back.by_document().collect()) == [
        (1, 4, [("fish", 2), ("pond", 2)]), (2, 4, [("rock", 4)]), (3, 4, [("sand", 4)])]
    assert "Exchange" not in back.by_document()._jdf.queryExecution().executedPlan().toString()
    I.Index.reset(spark, config)
    assert not (tmp_path / "stemmed=false" / "documents").exists()

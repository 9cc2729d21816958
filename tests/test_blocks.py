import random

import numpy as np
import pyarrow as pa
import pytest
from test_index_search import _index

from quillspan.config import EngineConfig
from quillspan.operators import blocks
from quillspan.operators import search as S


def _random(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    docs = {3 * i: {w: r.choice([0.5, 1.0, 1.25]) for w in words if r.random() < 3 / (2 + int(w[1:]))} for i in range(90)}
    asked = [(q, w, r.choice([0.0, 0.0, 1.0, 2.0, -1.0])) for q in range(25) for w in [*words, "unknown"] if r.random() < (0.3 if q % 5 else 0.03)]
    return docs, [*asked, *[(99, w, 0.0) for w in words[:9]]]


def _batches(docs):
    ids = list(docs)
    for a in range(0, len(ids), 40):
        own = ids[a : a + 40]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array([[*docs[i]] for i in own], pa.list_(pa.string())), pa.array([[*docs[i].values()] for i in own], pa.list_(pa.float64()))],
            names=["doc_id", "terms", "impacts"])


def _pairs(docs, asked):
    scores = {}
    for q, w, x in asked:
        for i, held in docs.items():
            if w in held:
                scores[q, i] = scores.get((q, i), 0.0) + x * held[w]
    return scores


@pytest.mark.parametrize("sparse, cells, size", [(250, 1 << 21, 2048), (1, 50, 7), (10**9, 50, 16), (30, 1, 1)])
def test_blocks_against_pairs(monkeypatch, sparse, cells, size):
    for name, value in (("SPARSE", sparse), ("CELLS", cells), ("DOCS", size), ("QUERIES", size), ("TERMS", 3)):
        monkeypatch.setattr(blocks, name, value)
    for seed in range(3):
        docs, asked = _random(seed)
        batch = blocks.Batch.of(pa.table({"query_id": [a[0] for a in asked], "lkey": [a[1] for a in asked], "_w": [a[2] for a in asked]}))
        want = _pairs(docs, asked)
        held = [(q, i) for b in blocks.candidates(_batches(docs), batch) for r in b.to_pylist() for q in [r["query_id"]] for i in r["docs"]]
        assert sorted(held) == sorted(want)
        got = sorted((r["query_id"], -r["score"], r["doc_id"]) for b in blocks.best(_batches(docs), batch, 5, 6) for r in b.to_pylist())
        ranked = sorted((q, -np.round(s, 6) + 0.0, i) for (q, i), s in want.items())
        assert got == [x for n, x in enumerate(ranked) if n < 5 or ranked[n - 5][0] != x[0]]


@pytest.mark.parametrize("config", [
    EngineConfig(), EngineConfig(observed=False), EngineConfig(stem=True), EngineConfig(semantic=True), EngineConfig(pad=True),
], ids=["bm25", "intended", "stemmed", "semantic", "padded"])
def test_no_pair_of_query_and_document_is_joined_or_shuffled(spark, monkeypatch, config):
    monkeypatch.setattr(S, "WEIGHTS_AT_ONCE", 2)
    index = _index(spark, config)
    asked = spark.createDataFrame([(1, "fish pond rock"), (2, "sand rock rock"), (3, "of the")], "query_id long, text string")
    terms = S.query_terms(asked, index)
    ranked, pairs = S.search(asked, index), S.scores(terms, index)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Inner" not in plan
    want = S.top(pairs, 50)
    assert sorted(ranked.collect()) == sorted((S.padded(want, asked, 50) if config.pad else want).collect())
    assert sorted(S.candidates(terms, index).collect()) == sorted(pairs.select("query_id", "doc_id").collect())
    assert "Join" not in S.candidates(terms, index)._jdf.queryExecution().optimizedPlan().toString()

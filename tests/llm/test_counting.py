import math
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspan.llm import distinctive, force, frequency, topn

TERMS = "doc_id long, kind string, key string, tf long, loaded_at timestamp, lkey string"


def at(h):
    return datetime(2024, 1, 1, h)


ROWS = [
    (1, "entity", "A", 3, at(1), "x"), (1, "entity", "A", 1, at(2), "x"), (1, "entity", "B", 1, at(1), "x"), (1, "entity", "C", 1, at(1), "x"),
    (1, "entity", "C", 1, at(1), "x"), (1, "entity", None, 9, at(1), "x"), (1, "entity", "D", None, at(9), "x"), (1, "entity", "E", 7, None, "x"),
    (1, "entity", "E", 2, at(1), "x"), (2, "entity", "A", 5, at(1), "x"), (2, "entity", "A", 6, at(1), "x"), (2, "term", "A", 50, at(1), "x"),
    (None, "entity", "N", 1, at(1), "x"), (3, None, "K", 1, at(1), "x"), (3, "entity", "", 1, at(1), "x"),
]


def test_in_force(spark):
    df = spark.createDataFrame(ROWS, TERMS)
    got = {(r.doc_id, r.kind, r.key): r.tf for r in force.in_force(df).collect()}
    assert got == {
        (1, "entity", "A"): 1, (1, "entity", "B"): 1, (1, "entity", "C"): 1, (1, "entity", "E"): 2, (2, "entity", "A"): 6,
        (2, "term", "A"): 50, (None, "entity", "N"): 1, (3, None, "K"): 1, (3, "entity", ""): 1,
    }
    assert {(r.doc_id, r.key) for r in force.in_force(df, "term").collect()} == {(2, "A")}
    assert force.in_force(df.limit(0)).count() == 0


def test_dominant_entities(spark):
    df = spark.createDataFrame(ROWS, TERMS)
    got = sorted(((r.doc_id, r["rank"], r.entity) for r in topn.dominant_entities(df, 2).collect()), key=str)
    assert got == sorted([(1, 1, "E"), (1, 2, "C"), (2, 1, "A"), (None, 1, "N"), (3, 1, "")], key=str)
    docs = spark.createDataFrame([(1, "a", 1, None), (9, "b", None, 2)], "doc_id long, name string, max_tf long, length long")
    lists = {r.doc_id: [(e.entity, e.tf) for e in r.dominant_entities] for r in topn.refreshed_map(docs, df, 2).collect()}
    assert lists == {1: [("E", 2), ("C", 1)], 9: []}


def test_top_n_equals_sorting(spark):
    draw = random.Random(2)
    rows = [(0 if draw.random() < 0.5 else draw.randint(1, 400), draw.choice([None, *range(6)]), draw.choice(["a", "b", "é", None]) and f"i{draw.randint(0, 99)}", "x") for _ in range(8000)]
    df = spark.createDataFrame(rows, "g long, score long, item string, rank string").repartition(7)
    want = defaultdict(list)
    for g, s, i, _ in rows:
        if s is not None and i is not None:
            want[g].append((s, i))
    got = defaultdict(list)
    for r in topn.top_n(df, "g", "score", "item", 5).orderBy("g", "rank").collect():
        got[r.g].append((r.score, r.item))
    assert got == {g: sorted(v, reverse=True)[:5] for g, v in want.items()}
    assert topn.top_n(df.limit(0), "g", "score", "item", 5).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "score", "item", 0)


def test_log_entropy(spark):
    rows = [(d, "all", 2, "c") for d in range(4)] + [(0, "one", 3, "c"), (1, "two", 1, "c"), (2, "two", 3, "c"), (3, None, 1, "c"), (3, "zero", 0, "c")]
    df = spark.createDataFrame(rows, "doc_id long, term string, tf long, weight string")
    got = {(r.doc_id, r.term): r for r in distinctive.log_entropy(df, 4).collect()}
    assert len(got) == 7
    assert got[0, "all"].weight == pytest.approx(0) and got[0, "one"].weight == pytest.approx(1)
    h = -(0.25 * math.log(0.25) + 0.75 * math.log(0.75))
    assert got[2, "two"].score == pytest.approx(math.log(4) * (1 - h / math.log(4)))
    assert (got[2, "two"].df, got[2, "two"].total_tf) == (2, 4)
    assert distinctive.log_entropy(df.limit(0), 0).count() == 0
    assert distinctive.log_entropy(df.where("doc_id = 0"), 1).first().weight == 1.0


def test_distinctive_with_odd_lengths(spark):
    df = spark.createDataFrame([(1, "term", "rare", 40, at(1), ""), (2, "term", "rare", 40, at(1), ""), (3, "term", "Rare", 20, at(1), ""), (3, "term", "rare", 20, at(1), "")], TERMS)
    docs = spark.createDataFrame([(1, 50), (2, None), (3, 0), (4, 9)], "doc_id long, length long")
    assert [(r.doc_id, r.term) for r in distinctive.found(df, docs, 0.09).collect()] == [(1, "rare")]


@pytest.mark.parametrize("max_n, parts", [(1, 4), (3, 1), (3, 13)])
def test_grams_equal_counting(spark, max_n, parts):
    draw = random.Random(max_n + parts)
    docs = [(d, [draw.choice("aabbbcdé") * draw.randint(1, 2) for _ in range(draw.choice([0, 1, 2, 5, 40]))]) for d in range(120)]
    docs += [(500, ["a"] * 300), (501, ["a", "b"] * 200), (None, ["a"])]
    tf, seen = Counter(), defaultdict(set)
    for d, toks in docs:
        for n in range(1, max_n + 1):
            for i in range(len(toks) - n + 1):
                g = (n, " ".join(toks[i : i + n]))
                tf[g] += 1
                seen[g].add(d)
    df = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, tokens array<string>, suffix string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.n, r.gram): (r.tf, r.df) for r in frequency.gram_counts(frequency.suffixes(df, "doc_id", max_n), max_n).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {g: (tf[g], len(seen[g])) for g in tf}


def test_grams_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "One one"), (5, "x" * 500_000)], "doc_id long, text string")
    got = {(r.n, r.gram): (r.tf, r.df) for r in frequency.text_grams(df, 2).where(F.length("gram") < 99).collect()}
    assert got == {(1, "one"): (2, 1), (2, "one one"): (1, 1)}
    assert frequency.text_grams(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        frequency.gram_counts(df, 0)


def test_marks(spark):
    rows = [(d, "term", k, 1, at(1), "") for d in range(9) for k in ["common"] + (["few"] if d < 3 else []) + (["rare"] if d < 2 else [])]
    got = {r.term: (r.df, r.mark) for r in frequency.term_dictionary(spark.createDataFrame(rows, TERMS), 9).collect()}
    assert got == {"common": (9, "common"), "few": (3, None), "rare": (2, "rare")}

import re

from quillspan.config import EngineConfig
from quillspan.functions import text
from quillspan.functions.porter import stem
from quillspan.functions.text import java_hash
from quillspan.operators import bags as B

STOP = EngineConfig(stop_words=("the", "and", "of"))


def bags(spark, texts, config=STOP):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: ({}, {}) for i in range(len(texts))}
    for r in B.doc_terms(B.plain_sections(docs), config).collect():
        if r.kind != "number":
            out[r.doc_id][r.kind == "entity"][r.key] = r.tf
    return [out[i] for i in range(len(texts))]


def test_words_and_entities(spark):
    cases = [
        ("John Smith said", {"JOHN": 1, "SMITH": 1, "said": 1}, {"JOHN SMITH": 1}),
        ("New York City Council", {"NEW": 1, "YORK": 1, "CITY": 1, "COUNCIL": 1}, {"NEW YORK": 1, "CITY COUNCIL": 1}),
        ("Alpha Beta Gamma", {"ALPHA": 1, "BETA": 1, "GAMMA": 1}, {"ALPHA BETA": 1}),
        ("The President", {"PRESIDENT": 1}, {"THE PRESIDENT": 1}),
        ("House or house", {"house": 2, "or": 1}, {}),
        ("John, Smith", {"JOHN": 1, "SMITH": 1}, {}),
        ("state-of-the-art", {"state-of-the-art": 1}, {}),
        ("King Anglo-Saxon rule", {"KING": 1, "Anglo-Saxon": 1, "rule": 1}, {"KING ANGLO-SAXON": 1}),
        ("réaile la éau", {"la": 1}, {}),
        ("a x ox", {"ox": 1}, {}),
        ("100kg 10m kg May", {"100kg": 1}, {}),
        ("", {}, {}),
        (None, {}, {}),
    ]
    assert bags(spark, [c[0] for c in cases]) == [(t, e) for _, t, e in cases]


def test_very_long_tokens(spark):
    n = 60_000
    got = bags(spark, ["a-" * n + "a", "1," * n, "Ab" * n, "a-b--c-d- -e-f-", "A " * n])
    assert got[0][0] == {"a-" * n + "a": 1}
    assert got[2][0] == {("AB" * n): 1} and got[3][0] == {"a-b": 1, "c-d": 1, "e-f": 1}


def test_stemmed(spark):
    got = bags(spark, ["Running runs relational"], EngineConfig(stem=True, stop_words=()))
    assert got == [({"run": 2, "relat": 1}, {})]


def test_porter():
    words = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "feed": "feed", "agreed": "agre", "matting": "mat", "mating": "mate",
        "milling": "mill", "relational": "relat", "conditional": "condit", "digitizer": "digit", "conformabli": "conform",
        "vietnamization": "vietnam", "operator": "oper", "sensibiliti": "sensibl", "formalize": "formal", "electrical": "electr",
        "replacement": "replac", "adoption": "adopt", "effective": "effect", "rate": "rate", "cease": "ceas", "controll": "control",
        "sky": "sky", "happy": "happi", "is": "is", "apologi": "apolog", "s": "s",
    }
    assert {w: stem(w) for w in words} == words


def test_greedy_pairing_equals_a_scan(spark):
    import random

    draw = random.Random(5)
    parts = ["John", "Smith", "said", "The", "X-Ray", "a", "May", "km", "Ab.", "$Cd", "Éau", "7", ",", "Zu"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(1500)]

    def scan(text):
        toks = ["<TEXT>", *text.split(" "), "</TEXT>"]
        words = [(i, m) for i, t in enumerate(toks) for m in re.finditer(r"(?<![-$<\w])[A-Za-z0-9_]+(?![->\w])", t)]
        out, k = [], 0
        while k < len(words):
            i, m = words[k]
            k += 1
            if m[0] in ("May", "km", "7") or not m[0][0].isupper() or m.end() != len(toks[i]):
                continue
            nxt = re.match(r"[^\W_]*(?:-[^\W_]*)*", toks[i + 1])[0].rstrip("-")
            if nxt and nxt[0].isupper():
                out.append(f"{m[0]} {nxt}".upper())
                k += "-" not in nxt
        return sorted(out)

    got = bags(spark, texts)
    for t, (_, entities) in zip(texts, got):
        assert sorted(k for k, n in entities.items() for _ in range(n)) == scan(t), t


def test_pairs_at_once_equal_pairs_one_by_one(spark, monkeypatch):
    import random

    draw = random.Random(6)
    parts = ["John", "Smith", "said", "The", "X-Ray", "Ab-", "Anglo-Saxon-", "a", "May", "Million", "K", "km", "Ab.", "Ab/Cd", "$Cd", "Éau", "Smithé", "Aé-B", "7", "7K", "3D", ",", "", "--", "Zu>", "O_N", "ÀB", "B٣", "a-b--C-d"]
    texts = [draw.choice([" ", "  "]).join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    fast = bags(spark, texts)
    monkeypatch.setattr(text, "IRREGULAR", "TEXT")  # stands in every section
    assert fast == bags(spark, texts)


def test_java_hash(spark):
    df = spark.createDataFrame([("hello world",), ("",), ("a",)], "t string")
    assert [r[0] for r in df.select(java_hash(df.t)).collect()] == [1794106052, 0, 97]


def test_tagged_sections_are_apart(spark):
    docs = spark.createDataFrame([(1, "<DOC><DOCNO> x </DOCNO><TEXT> May </TEXT><TEXT> 5 </TEXT></DOC>"), (2, "<DOC></DOC>")], "doc_id long, raw string")
    rows = B.doc_terms(B.tagged_sections(docs), STOP).collect()
    assert [(r.doc_id, r.kind, r.key, r.tf) for r in rows] == [(1, "number", "5", 1)]

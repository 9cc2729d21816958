import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions.numbers import number_string
from quillspan.operators import bags as B

CASES = [
    ("5 May", ["05-05"]), ("14 MAY 1991", ["05-14", "1991-05"]), ("May 5, 1994", ["05-05", "1.994K"]), ("June 1994", ["1994-06"]),
    ("3 April", ["3"]), ("12.5 May", ["12.5-05"]), ("6%", ["6%"]), ("10.6 percent", ["10.6%"]), ("6 million percent", ["6000000%"]),
    ("$450", ["450 Dollars"]), ("$5 thousand", ["5 Dollars"]), ("$2 million", ["2 M Dollars"]), ("1 million dollars", ["1 Dollars"]),
    ("20.6 bn dollars", ["20600 M Dollars"]), ("10 U.S. dollars", ["10"]), ("5 million, dollars", ["5M"]), ("Dollars 50", ["50 Dollars"]),
    ("$1,732", ["1,7 Dollars", "32"]), ("100 kg", ["100 kg"]), ("100kg", ["100 kg"]), ("12 KM", ["12 km"]), ("between 18 and 24", ["24"]),
    ("2 3/4", ["0 3/4"]), ("3/4 dollars", ["0 3/4 Dollars"]), ("10,123", ["101", "23"]), ("1,234,567", ["12", "345", "67"]),
    ("1010.56", ["1.01K"]), ("55 million", ["55M"]), ("7 trillion", ["7000B"]), ("10m", ["10M"]), ("B52", ["52"]),
    ("152.143.123.131", ["152.143", "123.131"]), ("0.0004", ["0"]), ("999.9999", ["999.999"]), ("12345678", ["12.345M"]),
    ("555-3824", ["555", "3.824K"]), ("3/0", ["B"]), ("0/0", ["0 0/0"]), ("", []), (None, []),
]


@pytest.mark.parametrize("glued, cases", [(False, CASES), (True, [("100 km", ["100"]), ("$450", ["450"]), ("6 percent", ["6"])])])
def test_rules(spark, glued, cases):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    rows = B.number_matches(B.plain_sections(docs, glued=glued)).where("kind = 'number'").select("doc_id", "key").collect()
    got = {i: sorted(r.key for r in rows if r.doc_id == i) for i in range(len(cases))}
    assert got == {i: sorted(keys) for i, (_, keys) in enumerate(cases)}


def test_between_is_a_term(spark):
    docs = spark.createDataFrame([(1, "between 18 and 24")], "doc_id long, text string")
    got = {(r.kind, r.key) for r in B.number_matches(B.plain_sections(docs)).collect()}
    assert got == {("term", "18-24"), ("number", "24")}


def test_number_string(spark):
    values = [12.345678, 0.001, 0.0009999, 1.0, 100.0, 1e7, 123456789.5, float("inf"), 1e30, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(number_string(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["12.345", "0.001", "0", "1", "100", "10000000", "123456789.5", "", "1" + "0" * 30, "0.1"]


def _contexts(text):
    """The neighbours of every number, by scanning the text character by character."""
    stop = set(".,!:\"-|]?;\\/><[")

    def follow(end):
        """(expression, where it ends) after position ``end``."""
        if end > len(text) - 2:
            return "", None
        stop_at = text.find(" ", end + 1)
        stop_at = len(text) if stop_at < 0 else stop_at
        piece = text[end + (text[end] == " ") : stop_at]
        cut = piece
        while cut and cut[-1] in stop:
            cut = cut[:-1]
        return cut, stop_at - (len(piece) - len(cut))

    out = []
    for m in re.finditer(r"\d+([,]\d)*([.]\d+)?", text, re.A):
        at = text.rfind(" ", 0, m.start() - 1) + 1
        prev = text[at : m.start() - (text[m.start() - 1] == " ")]
        n1, e1 = follow(m.end())
        n2, e2 = follow(e1) if e1 is not None else ("", None)
        out.append((m[0], prev, n1, n2))
    return out


def test_context_equals_scanning(spark):
    draw = random.Random(3)
    parts = ["5", "12", "1,2", "3/4", "$", "%", "km", "May", ",", ".", "-", " ", " ", "  ", "x", "/", "and", "\"", "7.5"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = B.matches(B.plain_sections(docs), "doc_id").orderBy("doc_id", "at", "nth").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.num, r.prev, r.next, r.next2))
    for i, t in enumerate(texts):
        assert got.get(i, []) == _contexts(re.sub(r"\s+", " ", f"<TEXT> {t} </TEXT>")), t

from collections import Counter, defaultdict

import pytest

from quillspan.operators import quarantine as Q
from quillspan.operators import skew
from quillspan.operators import units as U

RAW = "record_id long, file_name string, fmt string, raw string, doc_id string"
GOOD = "ABC123456-1234567,2020-02-29,sec,12,some text"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, "f", fmt, raw, "clash") for i, (fmt, raw) in enumerate(rows)], RAW)
    bad = {r.record_id: r.reason for r in Q.diagnose(df).collect()}
    assert {r.record_id for r in Q.load_valid(df).collect()} == set(range(len(rows))) - set(bad)
    return [bad.get(i) for i in range(len(rows))]


def test_csv(spark):
    cases = [
        (GOOD, None), (GOOD.replace("some text", '"a, ""b""\nc"'), None), (GOOD.replace("sec", '"p, q"'), None), (GOOD.replace("sec", ""), None),
        (None, "empty"), ("", "empty"), (" \n", "empty"), (GOOD.replace("some", 'so"me'), "quoting"), (GOOD + '"', "quoting"),
        ('"' + GOOD, "quoting"), (GOOD.replace("sec", '"x" '), "quoting"), (GOOD + ",more", "columns"), ("a,b", "columns"), ("a\x01,b", "columns"),
        (GOOD.replace("ABC", "abc"), "docno"), (GOOD.replace("2020-02-29", "2021-02-29"), "day"), (GOOD.replace("2020-02-29", "2020-2-29"), "day"),
        (GOOD.replace("12,", "1x,"), "length"), (GOOD.replace(",12,", ",1234567890,"), "length"), (GOOD.replace("some text", '" "'), "text"),
        (GOOD.replace("ABC", "abc").replace("12,", "zz,"), "docno"), (GOOD.replace("some text", "\x01, \x02".replace(",", ";")), None),
        (GOOD.replace("some text", '"' + '""' * 200_000 + '"'), None),
    ]
    assert reasons(spark, [("csv", r) for r, _ in cases]) == [x for _, x in cases]


def test_trec(spark):
    good = "<DOC>\n<DOCNO> ABC123456-1234567 </DOCNO><DAY>2020-01-31</DAY><SECTION></SECTION><LENGTH> 3 </LENGTH><TEXT>a < b</TEXT></DOC>\n"
    cases = [
        (good, None), (good.replace("</DOC>", "<TEXT>two</TEXT></DOC>"), None), (good.replace("</TEXT>", ""), "tags"),
        (good.replace("<DAY>2020-01-31</DAY>", ""), "tags"), (good.replace("<DOC>", ""), "tags"), (good.replace("</DOC>", ""), "tags"),
        (good.replace("<SECTION></SECTION>", "stray <SECTION></SECTION>"), "tags"), (good + good, "tags"), ("text", "tags"),
        (good.replace("ABC", "AB"), "docno"), (good.replace("01-31", "02-31"), "day"), (good.replace(" 3 ", " -3 "), "length"),
        (good.replace("a < b", " \n"), "text"), (good.replace("a < b", "x" * 1_000_000), None),
    ]
    assert reasons(spark, [("trec", r) for r, _ in cases]) == [x for _, x in cases]


def test_ids_and_formats(spark):
    df = spark.createDataFrame(
        [(None, "f", "csv", GOOD, ""), (1, "f", "csv", GOOD, ""), (1, "f", "csv", "bad", ""), (2, "f", "xml", GOOD, ""), (3, "f", None, GOOD, ""),
         (4, "f", "csv", "bad", ""), (4, "f", "csv", "bad", "")], RAW)
    assert Counter((r.record_id, r.reason) for r in Q.diagnose(df).collect()) == Counter(
        [(1, "columns"), (2, "format"), (3, "format"), (4, "columns"), (4, "columns")])
    assert Q.load_valid(df).count() == 2
    assert Q.diagnose(df.limit(0)).count() == Q.load_valid(df.limit(0)).count() == 0


def test_load_gives_values(spark):
    row = Q.load_valid(spark.createDataFrame([(1, "f", "csv", GOOD.replace("some text", '"a ""b"""'), "")], RAW)).first()
    assert (row.docno, str(row.day), row.section, row.length, row.text) == ("ABC123456-1234567", "2020-02-29", "sec", 12, 'a "b"')


UNITS = [
    ("kilometre", "length", "mm", 1e6), ("metre", "length", "mm", 1e3), ("centimetre", "length", "mm", 10.0), ("millimetre", "length", "mm", 1.0),
    ("mile", "length", "mm", 1609344.0), ("foot", "length", "mm", 304.8), ("inch", "length", "mm", 25.4), ("tonne", "mass", "mg", 1e9),
    ("kilogram", "mass", "mg", 1e6), ("gram", "mass", "mg", 1e3), ("milligram", "mass", "mg", 1.0), ("pound", "mass", "mg", 453592.37),
    ("dollar", "money", "cent", 100.0), ("cent", "money", "cent", 1.0), ("percent", "ratio", "bp", 100.0), ("per mille", "ratio", "bp", 10.0),
    ("basis point", "ratio", "bp", 1.0),
]
QUANTITIES = [
    ("54g", None, "x 54g in all y", ("mg", 54000)), ("57 million", None, "1 yd and 57 million kg z", ("mg", 57 * 10**12)),
    ("232,75", " KG. ", "232,75 KG", ("mg", 232750000)), ("11 362", None, "11 362 kilometers a", ("mm", 11362 * 10**6)),
    ("1.665,5", "mm", "", ("mm", 1666)), ("40,689", None, "a 40,689, all in lbs, b", ("mg", 40689 * 453592 + round(40689 * 0.37))),
    ("8 1/2", None, "8 1/2 (in km) a", ("mm", 8500000)), ("1/4", "ft", "", ("mm", 76)), ("360", None, "measured in USD: 360 a", ("cent", 36000)),
    ("426", None, "In millions of dollars: a 426 b", ("cent", 42600000000)), ("$25K", None, "a $25K b", ("cent", 2500000)), ("21", None, "a $21 b", ("cent", 2100)),
    ("9.4bn", "USD", "", ("cent", 940000000000)), ("4m", None, "measured in dollars: 4m a", ("cent", 400000000)), ("5m", None, "a 5m b", ("mm", 5000)),
    ("12", "‰", "", ("bp", 120)), ("3 per cent", None, "", ("bp", 300)), ("7 bps", None, "", ("bp", 7)), ("6 U.S. dollars", None, "", ("cent", 600)),
    ("13", "rooms", "13 rooms", None), ("15", None, "15 degree-led", None), ("54", None, "54 in all", None), ("tbc", "km", "", None), (None, "km", "5 km", None),
    ("", "km", "", None), ("1/0", "km", "", None), ("22", None, "2224 lb and 22 kilometers x", ("mm", 22 * 10**6)), ("5", None, None, None),
]


def test_units(spark):
    numbers = spark.createDataFrame([(i, 1, *q[:3], "x") for i, q in enumerate(QUANTITIES)], "number_id long, doc_id long, raw string, unit string, snippet string, factor string")
    units = spark.createDataFrame(UNITS, "unit_name string, dimension string, common_unit string, factor double")
    got = {r.number_id: (r.common_unit, r.amount) if r.amount is not None else None for r in U.to_common_units(numbers, units).collect()}
    assert got == {i: q[3] for i, q in enumerate(QUANTITIES)}
    assert U.to_common_units(numbers.limit(0), units).count() == 0
    assert U.to_common_units(numbers, units.limit(0)).where("amount is not null").count() == 0


CAPTIONS = [
    ("884", "Cable 884, in thousands of U.S. dollars, sesjaxed taxing.", ("cent", 88400000)),
    ("560", "Led 560, in thousands of Dollars, daklort.", ("cent", 56000000)), ("45", "Bimpus 45, in millions of USD, plap.", ("cent", 4500000000)),
    ("426", "In millions of U.S. dollars and otherwise unaudited: a 426 b", ("cent", 42600000000)), ("7", "7, in km, a", ("mm", 7000000)),
    ("12", "a 12, in London, b", None), ("12", "a 12 (in London) b", None), ("5", "a 5 in. b", ("mm", 127)),
    ("22", "22 rooms for 884, in thousands of dollars, b", None), ("426", "In millions of dollars: up 3 per cent to 426 b", ("cent", 42600000000)),
    ("3", "In millions of dollars: up 3 per cent to 426 b", ("bp", 300)),
    ("9", "In millions of dollars: 9, in thousands of USD, b", ("cent", 900000)),
]


def test_captions():
    one = U.Reader(U.UnitLexicon(UNITS))
    got = [one.best(raw, None, snippet) for raw, snippet, _ in CAPTIONS]
    assert [g and (g[2], g[4]) for g in got] == [want for *_, want in CAPTIONS]


def test_segments():
    units = U.UnitLexicon([*UNITS, ("square metre", "area", "square metre", 1.0)])
    best = lambda text: units.segment(text)[0][:4]
    assert best("kilometres") == ("kilometre", "length", "mm", 10**6) and best(" KM. ") == ("metre", "length", "mm", 10**6)
    assert best("kg") == ("gram", "mass", "mg", 10**6) and best("U.S.  Dollars") == ("dollar", "money", "cent", 100)
    assert best("m²") == ("square metre", "area", "square metre", 1) and best("km^2")[3] == 10**6 and best("hectometres")[3] == 10**5
    assert {s[:4] for s in units.segment("mm")} == {("metre", "length", "mm", 1)}
    assert units.segment("xyz") == () and units.segment("") == () and units.segment("m" * 500) == () and units.segment("kg²") == ()
    assert U.UnitLexicon(UNITS).segment("m²") == ()


def test_any_unit_list_is_read():
    long = "intergalactic standard unit of measurement"
    one = U.Reader(U.UnitLexicon([("litre", "volume", "ml", 1000.0), (long, "x", "x", 2.0), ("kilogram", "mass", "g", 1000.0)]))
    got = lambda *q: (r := one.best(*q)) and (r[2], r[4])
    assert got("5 litres", None, None) == got("5", "liters", None) == got("5", None, "a 5 litres b") == ("ml", 5000)
    assert got("5 ml", None, None) == ("ml", 5) and got("2 hectoliters", None, None) == ("ml", 200_000)
    assert got("3", long + "s", None) == got("3", None, f"a 3 {long.upper()} b") == got("3", None, f"a 3 (in {long}) b") == ("x", 6)
    assert got("3", None, f"a measured in {long}: 3 b") == got("3", None, f"a 3, all in {long}, b") == ("x", 6)
    assert got("5 metres", None, None) is None and got("2 kilos", None, None) == ("g", 2000)


def test_signs_and_multipliers():
    one = U.Reader(U.UnitLexicon(UNITS))
    got = lambda *q: (r := one.best(*q)) and (r[2], r[4])
    assert got("-5 kg", None, None) == got("- 5", "kg", None) == got("−5 kg", None, None) == ("mg", -5 * 10**6)
    assert got("-$5", None, None) == ("cent", -500) and got("A-5 kg", None, None) == ("mg", 5 * 10**6) and got("-0.5 mm", None, None) == ("mm", -1)
    assert got("12m", None, "a 12m kg b") == got("12m", "kg", None) == ("mg", 12 * 10**12)
    assert got("12m", None, "a 12m tall b") == ("mm", 12000) and got("3 m", None, None) == ("mm", 3000)


_WRITTEN = {
    ("mm", 10**6): ("km", "Km", "KM", "kms", "kilometre", "kilometers"), ("mm", 1000): ("metre", "metres", "meters", "mtr"), ("mm", 304.8): ("ft", "FT", "foot", "feet"),
    ("mg", 10**6): ("kg", "KG", "kgs", "kilograms", "kilos"), ("mg", 10**9): ("tonne", "tonnes", "metric tons"), ("mg", 453592.37): ("lb", "lbs", "pounds"),
    ("cent", 100): ("dollars", "Dollars", "U.S. dollars", "USD"), ("cent", 1): ("cents", "Cents"), ("bp", 100): ("%", "per cent", "percent", "pct"), ("bp", 10): ("per mille", "‰"),
    ("bp", 1): ("basis points", "bps", "bp"),
}
_NUMBERS = {"7": 7, "1,250": 1250, "12 500": 12500, "3.5": 3.5, "2,5": 2.5, "1.250,75": 1250.75, "2 1/2": 2.5, "3/4": 0.75, "14.5K": 14500, "2.4m": 2.4e6, "3 billion": 3e9}


def test_every_shape_with_every_spelling():
    """At least 200 hand-made cases per shape: every spelling with every way of writing a number."""
    one = U.Reader(U.UnitLexicon(UNITS))
    shapes = {
        "in raw": lambda n, u: (f"{n} {u}", None, f"a {n} {u} b."), "in unit": lambda n, u: (n, f" {u}.", f"a {n} {u} b"), "after": lambda n, u: (n, None, f"Big {n} {u} plap, b"),
        "paren": lambda n, u: (n, None, f"a {n} (in {u}) b"), "all in": lambda n, u: (n, None, f"a {n}, all in {u}, b"), "measured": lambda n, u: (n, None, f"a measured in {u}: {n} b"),
        "second": lambda n, u: (n, None, f"a 9911 yd and {n} {u} b"),
    }
    for name, shape in shapes.items():
        cases = [(n, v, u, key) for n, v in _NUMBERS.items() for key, us in _WRITTEN.items() for u in us]
        assert len(cases) >= 200
        for n, v, u, (common, factor) in cases:
            got = one.best(*shape(n, u))
            want = int(U.Fraction(repr(v)) * U.Fraction(repr(factor)) + U.Fraction(1, 2))
            assert got and (got[2], got[4]) == (common, want), (name, n, u, got)


@pytest.mark.parametrize("salts", [1, 8])
def test_salted_stats(spark, salts):
    import random

    draw = random.Random(1)
    rows = [("hot" if draw.random() < 0.4 else f"t{draw.randint(0, 300)}", draw.randint(1, 50), draw.choice([None, 1, 2])) for _ in range(5000)]
    rows += [(None, 1, 1), ("nodoc", None, 3), ("nodoc", None, None), ("", 1, 1)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, "x") for r in rows], "term string, doc_id long, tf long, _heavy string")
    want = defaultdict(lambda: [0, set(), 0])
    for t, d, f in rows:
        if t is not None:
            want[t][0] += 1
            want[t][1] |= {d} - {None}
            want[t][2] += f or 0
    got = {r.term: (r.n_rows, r.df, r.tf) for r in skew.salted_postings_stats(df, salts).collect()}
    assert got == {t: (n, len(ds), f) for t, (n, ds, f) in want.items()}
    assert skew.salted_postings_stats(df.limit(0)).count() == 0
    heavy = skew.heavy_keys(skew.key_counts(df, "term"), 3).collect()
    assert [r[0] for r in heavy] == [spark.sql("select xxhash64('hot')").first()[0]]


def test_a_hot_key_of_any_length_is_salted(spark):
    long = "k" * 5000
    df = spark.createDataFrame([(long, i % 70, 1) for i in range(2000)] + [("a", 1, 2)], "term string, doc_id long, tf long")
    assert skew.heavy_keys(skew.key_counts(df, "term"), 3).count() == 1
    got = {(r.term, r.n_rows, r.df, r.tf) for r in skew.salted_postings_stats(df, 8).collect()}
    assert got == {(long, 2000, 70, 2000), ("a", 1, 1, 2)}

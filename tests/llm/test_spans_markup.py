import random
import time
from collections import defaultdict

import pytest

from quillspan.llm import markup, spans

SPAN = 40


def brute(texts, least):
    own = defaultdict(set)
    for d, t in texts:
        for i in range(len(t or "") - least + 1):
            own[t[i : i + least]].add(d)
    return {(a, b) for s in own.values() for a in s for b in s if a < b}, own


def corpus():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdeéß漢") for _ in range(draw.randint(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randint(4, 40))) for _ in range(25)]
    texts = []
    for d in range(150):
        parts = []
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            a = draw.randint(0, max(0, len(p) - 30))
            parts += [p[a : a + draw.choice([30, SPAN - 1, SPAN, SPAN + 1, 90])], " ".join(word() for _ in range(5))]
        texts.append((d, "".join(parts)))
    texts += [(200, None), (201, ""), (202, "x" * 300), (203, "x" * 100), (204, "y" * 39), (205, "ab" * 90), (206, "ab" * 50), (207, texts[3][1]), (208, "z" * 50 + "q" + "z" * 50)]
    return texts


@pytest.mark.parametrize("compared", [200, 3, 0])
def test_shared_spans(spark, compared):
    texts = corpus()
    want, own = brute(texts, SPAN)
    df = spark.createDataFrame([(*x, "x") for x in texts], "doc_id long, text string, hash string").repartition(3)
    found = spans.SharedSpans(df, SPAN, 16, compared)
    assert {tuple(r) for r in found.pairs().collect()} == want
    shared, again = defaultdict(set), defaultdict(set)
    for d, t in texts:
        for i in range(len(t or "") - SPAN + 1):
            docs = own[t[i : i + SPAN]]
            if len(docs) > 1:
                shared[d] |= set(range(i, i + SPAN))
            if min(docs) < d:
                again[d] |= set(range(i, i + SPAN))
    got, repeated = defaultdict(set), defaultdict(set)
    for r in found.spans().collect():
        got[r.doc_id] |= set(range(r.start, r.start + r.length))
        if r.repeated:
            repeated[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert got == shared and {k: v for k, v in repeated.items()} == {k: v for k, v in again.items() if v}
    report = {r.doc_id: r for r in found.report().collect()}
    assert len(report) == len(texts) and report[200].shared_part == 0.0
    assert {d: r.shared_chars for d, r in report.items() if r.shared_chars} == {d: len(v) for d, v in shared.items()}
    assert {d: r.repeated_chars for d, r in report.items() if r.repeated_chars} == {d: len(v) for d, v in again.items() if v}


@pytest.mark.parametrize("compared", [200, 3, 0])
def test_earliest_occurrences(spark, compared):
    texts = corpus()
    copied = "".join(random.Random(9).choice("mnopr") for _ in range(SPAN + 20))
    texts += [(300 + i, chr(0x3400 + i) + copied + chr(0x3500 + i)) for i in range(150)]
    _, own = brute(texts, SPAN)
    want = set()
    for d, t in texts:
        state = [None] * (len(t or "") + 1)
        for i in range(len(t or "") - SPAN + 1):
            docs = own[t[i : i + SPAN]]
            for p in range(i, i + SPAN if len(docs) > 1 else i):
                state[p] = state[p] or min(docs) < d
        cuts = [i for i in range(len(state)) if i == 0 or state[i] is not state[i - 1]] + [len(state)]
        want |= {(d, a, b - a, state[a]) for a, b in zip(cuts, cuts[1:]) if state[a] is not None}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = [tuple(r) for r in spans.SharedSpans(df, SPAN, 16, compared).spans().collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert [r[0] for r in rows if r[0] >= 300 and not r[3]] == [300]


def test_classes(spark):
    texts = corpus()
    df = spark.createDataFrame(texts + [(300 + i, texts[3][1]) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.copies, r.n_links) for r in spans.linked_classes(df, SPAN, 16).collect()}
    first, size = {}, defaultdict(int)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for d, t in sorted(rows):
        first.setdefault(t, d)
        size[t] += 1
    links = defaultdict(set)
    for a, b in brute([(d, t) for t, d in first.items() if t is not None], SPAN)[0]:
        links[a].add(b)
        links[b].add(a)
    assert got == {d: (first[t], size[t], len(links[first[t]])) for d, t in rows}


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = spans.SharedSpans(df)
    assert found.pairs().count() == found.spans().count() == found.report().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(df, 10, 11)


def test_repeated_lines(spark):
    line = "A line that is  long enough to count here."
    df = spark.createDataFrame([(2, f"x\n{line.upper()}\ny"), (1, f"{line}\n{line}"), (3, None), (4, ""), (5, "another line that occurs only once")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.length, r.first_doc_id, r.first_start, r.repeated) for r in spans.repeated_lines(df, 20).collect())
    n = len(line)
    assert got == [(1, 0, n, 1, 0, False), (1, n + 1, n, 1, 0, True), (2, 2, n, 1, 0, True)]


CASES = [
    ("<p class=\"lead\">a &amp; b</p>", ["html"], "a & b"), ("<H2>T</H2><ul><li>x</li><li>y</li></ul>", ["heading", "html", "list"], "## T\n\n- x\n- y"),
    ("<pre><code>if k &lt; 5\n# no</code></pre>", ["code", "html"], "```\nif k < 5\n# no\n```"), ("a <!-- c --> b", ["html"], "a  b"), ("t &#8217;", ["html"], "t ’"),
    ("<p\n>x <script>var a = '**b**';</script>", ["html"], "x"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", ["html", "list"], "- a\n\n  - b"),
    ("# Head\n\ntext **bold** and [l](/u)", ["heading", "markdown"], "# Head\n\ntext bold and l"), ("T\n===\n\n- a\n- b", ["heading", "list", "markdown"], "# T\n\n- a\n- b"),
    ("```py\nx = a[1] * **k\n```", ["code", "markdown"], "```\nx = a[1] * **k\n```"), ("see `x`", ["markdown"], "see x"), ("![alt](i.png)", ["markdown"], "alt"),
    ("[a][3] b", ["markdown"], "a b"), ("| a | b |\n|---|--:|\n| 1 | 2 |", ["markdown"], "a | b\n1 | 2"), ("_em_ and *em*", ["markdown"], "em and em"),
    ("== H ==\n\n'''b''' [[x|y]] {{t|k=1}}", ["heading", "wiki"], "## H\n\nb y"), ("''i''\n* a\n** b", ["list", "wiki"], "i\n- a\n  - b"),
    ("{| class=\"g\"\n|-\n| a || 9\n|}", ["wiki"], "a | 9"), ("[http://x.y z] [[Category:q]]", ["wiki"], "z"),
    ("\\section*{S} \\textbf{b}", ["heading", "latex"], "### S\n\n b"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex", "list"], "- a"),
    ("Here $k_{3} = r^4$ holds.", ["formula", "latex"], "Here $k_{3} = r^4$ holds."), ("\\[ x \\times 3 \\]", ["formula", "latex"], "$$\nx \\times 3\n$$"),
    ("\\begin{verbatim}\n\\item <b>\n\\end{verbatim}", ["code", "latex"], "```\n\\item <b>\n```"), ("\\begin{equation}\na\n\\end{equation}", ["formula", "latex"], "$$\na\n$$"),
    ("void.~\\cite{k6}", ["latex"], "void."),
]
PLAIN = [
    "a <= 294 or b >= 173", "x < y and later y > 8", "R&D took 7 staff.", "File C:\\data\\in552 was lost.", "sold $9 or $12 a piece", "9 * 9 * 9", "rated 5* by 3",
    "#5 and #6", "the set {9}", "a -> b", "said [sic] on 9", "log_file_9 here", "- a\n- b", "1. a\n2. b", "* a\n* b", "5' 6'' tall and 7'' wide", "", " ", "a & b", "1 < 2 > 0", "==", "--- x",
    "if a<b then c>d",
]


def test_markup():
    for text, features, clean in CASES:
        assert markup.parse(text) == (features, clean), text
    for text in PLAIN:
        assert markup.parse(text) == ([], text), text


def test_long_and_deep_markup():
    formula = "x_1 + " * 60 + "x_2"
    found, text = markup.parse(f"a ${formula}$ b")
    assert {"latex", "formula"} <= set(found) and formula in text
    _, text = markup.parse("a " + "\\textbf{" * 30 + "word" + "}" * 30 + " b")
    assert "textbf" not in text and "word" in text
    _, text = markup.parse("a " + "{{t|" * 30 + "x" + "}}" * 30 + " b")
    assert "{{" not in text and "}}" not in text


def test_marked_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate([c[0] for c in CASES] + PLAIN)] + [(900, None, "x"), (901, "<b>" * 2 + "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean string")
    got = {r.doc_id: r for r in markup.cleaned(df).collect()}
    for i, (_, features, clean) in enumerate(CASES):
        assert (got[i].features, got[i].clean) == (features, clean)
    for i, t in enumerate(PLAIN):
        assert (got[len(CASES) + i].features, got[len(CASES) + i].clean) == ([], t)
    assert got[900].features == [] and got[900].clean is None
    assert {(r.doc_id, r.feature) for r in markup.features(df.where("doc_id >= 900")).collect()} == {(901, "html")}
    assert markup.features(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<!-- ", "<pre>", "\\[ ", "$x ", "```\n", "\\begin{verbatim}", "[[", "**a ", "{{", "<b", "'''", "[a](", "\\textbf{", "<script>", "{|\n", "{|\nx\n", "| a\n", "# a\n", "# a #", "a\n---\n", "''a ", "[http://a b "])
def test_long_texts_with_open_marks(piece):
    """The seconds of a text and of one four times as long: about four times as many, not sixteen."""
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        markup.parse(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0] + 0.5

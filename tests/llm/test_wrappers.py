from quillspan.llm import wrappers as W


def page(n, bold=False, more=""):
    return "<h1>T</h1>" + "<b>x</b>" * bold + "<ul>" + "".join(f"<li>i{k}</li>" for k in range(n)) + "</ul>" + more


def test_inference():
    wrapper, bodies = W.infer([page(3, True), page(2), page(1, True)])
    assert " ".join(f"({W.shown(a)})?" if o else W.shown(a) for a, o in wrapper) == "<h1> # </h1> (<b>)? (#)? (</b>)? <ul> (<li> # </li>)+ </ul>"
    fits = lambda t: W.accepts(wrapper, W.grouped(W.folded(W.stream(t)), bodies))
    assert fits(page(9)) and fits(page(1, True)) and not fits(page(2, more="<p>x</p>")) and not fits("")
    assert W.infer([]) == ([], []) and W.stream("plain text") == []
    assert W.folded(list("ababab")) == [("a", "b")] and W.folded(list("aab")) == [("a",), "b"]


def test_coverage(spark):
    rows = [(i, page(1 + i % 5, i % 2 == 0), "one", "x") for i in range(60)] + [(100, "<p>x</p>", "two", "x"), (101, None, "two", "x"), (102, "<p>x</p>", None, "x"), (103, "no markup", "three", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feed_id string, wrapper string")
    got = {r.host: (r.held_out, r.matched) for r in W.coverage(df, sample=20).collect()}
    assert got == {"one": (40, 40), "two": (0, 0)}
    assert W.coverage(df.limit(0)).count() == 0


def test_united():
    import random

    draw = random.Random(3)
    for _ in range(60):
        one, two = ([(draw.choice("abc"), draw.random() < 0.3) for _ in range(draw.randint(0, 12))] for _ in range(2))
        got = W.united(one, two)
        for w in (one, two):
            assert W.accepts(got, [a for a, _ in w]) and W.accepts(got, [a for a, optional in w if not optional])


def test_inferred_from_all_texts(spark):
    kinds = [f"<h1>T</h1><b>x</b>{'<i>y</i><u>z</u>' * (i % 2)}<p>{'<em>' * (i // 2 % 2)}" + "".join(f"&a{j};" for j in range(8) if i >> j & 1) for i in range(200)]
    rows = [(i, k, "one") for i, k in enumerate(kinds + kinds[:20])] + [(900, "<p>x</p>", "two"), (901, None, "two"), (902, "<p>x</p>", None), (903, "plain", "three")]
    rows += [(910, "<p><b>" + "".join(f"&a{i};" for i in range(60)), "long"), (911, "<p>x</p>", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feed_id string").repartition(3)
    for cell in (1000, 8, 1):
        got = {r.host: r for r in W.inferred(df, cell=cell, longest=50).collect()}
        assert set(got) == {"one", "two", "long"} and got["two"].wrapper == "<p> # </p>"
        assert (got["one"].texts, got["one"].streams, got["one"].too_long) == (220, len({str(W.folded(W.stream(k))) for k in kinds}), 0)
        assert (got["long"].texts, got["long"].too_long, got["long"].wrapper) == (2, 1, "<p> # </p>")
        assert 20 < got["one"].held_out < 70 and 0 < got["one"].matched <= got["one"].held_out
        assert all(f"&a{j};" in got["one"].wrapper for j in range(8))
    assert W.inferred(df.limit(0)).count() == 0


def test_groups_of_any_length():
    import random

    row = "<tr><td>a</td><td><b>b</b></td><td><i>c</i></td></tr>"
    assert [len(a) for a in W.folded(W.stream(row * 3))] == [15]
    wrapper, bodies = W.infer([f"<table>{row * n}</table>" for n in (2, 4)])
    assert len(wrapper) == 3 and all(W.accepts(wrapper, W.grouped(W.folded(W.stream(f"<table>{row * n}</table>")), bodies)) for n in (1, 3, 9))

    def plain(seq):
        before = None
        while before != seq:
            before, size = seq, 1
            while 2 * size <= len(seq):
                out, i = [], 0
                while i < len(seq):
                    n = 1
                    while i + (n + 1) * size <= len(seq) and seq[i + n * size : i + (n + 1) * size] == seq[i : i + size]:
                        n += 1
                    body = tuple(seq[i : i + size])
                    out += [seq[i]] if n == 1 else [body[0] if size == 1 and isinstance(body[0], tuple) else body]
                    i += 1 if n == 1 else n * size
                seq, size = out, size + 1
        return seq

    draw = random.Random(5)
    for _ in range(300):
        seq = [a for _ in range(draw.randint(0, 5)) for a in [draw.choice("abcd") for _ in range(draw.randint(1, 20))] * draw.randint(1, 3)]
        assert W.folded(seq) == plain(seq)


def test_united_by_a_longest_subsequence():
    import random

    draw = random.Random(6)
    for size in (0, 1, 5, 40, 90):
        for _ in range(10):
            one, two = ([draw.choice("abcdef") for _ in range(draw.randint(size // 2, size))] for _ in range(2))
            best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
            for i, x in enumerate(one):
                for j, y in enumerate(two):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            got = W.united(*([(a, False) for a in seq] for seq in (one, two)))
            assert len(one) + len(two) - len(got) == best[-1][-1] and W.accepts(got, one) and W.accepts(got, two)


def test_texts_of_any_length_shape_the_wrapper(spark):
    long = [f"&a{i};" for i in range(2500)]
    rows = [(1, "".join(long), "one"), (2, "<p>x</p>", "two"), (3, "<p>x</p>" + "".join(long), "two"), (4, "<p>x</p>" + "".join(long[::2]), "two")]
    got = {r.host: r for r in W.inferred(spark.createDataFrame(rows, "doc_id long, text string, feed_id string")).collect()}
    assert (got["one"].wrapper, got["one"].texts, got["one"].too_long) == (" ".join(long), 1, 0)
    assert (got["two"].wrapper, got["two"].texts, got["two"].too_long) == (" ".join(["<p> # </p>"] + [f"({a})?" for a in long]), 3, 0)

import random
from collections import defaultdict

import numpy as np
import pytest

from quillspan.llm import mixing, packing
from quillspan.llm.tokens import n_tokens


def test_tokens(spark):
    cases = [("don't stop", 4), ("a--b, c_d 12.5", 9 - 1), (None, 0), (" \n\t\u00a0\u2003", 0), ("", 0), ("é ß 漢字!", 4), ("a" * 100_000, 1)]
    import regex

    for t, n in cases:
        assert n == (len(regex.findall(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+", t)) if t else 0)
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r[0] for r in df.select(n_tokens("text")).collect()] == [n for _, n in cases]


def filled(slots, histogram):
    """Checks a plan: every item once, nothing overlaps, nothing beyond the capacity. Returns the containers' content."""
    ranks, inside = defaultdict(list), defaultdict(list)
    for length, a, b, first, offset in slots:
        ranks[length] += range(a, b)
        for r in range(a, b):
            inside[first + r - a].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items() if n}
    for items in inside.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64
    return inside


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    draw = random.Random(seed)
    histogram = {length: draw.randint(0, 400) for length in draw.sample(range(1, 65), draw.randint(1, 40))}
    slots = packing.plan(histogram, 64)
    inside = filled(slots, histogram)
    room = [0] * 65  # best fit item by item: containers by free room
    boxes = 0
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            r = next((r for r in range(k, 65) if room[r]), None)
            if r is None:
                boxes += 1
            else:
                room[r] -= 1
            room[(64 if r is None else r) - k] += 1
    assert len(inside) <= boxes * 1.01 + 1
    assert sorted(inside) == list(range(len(inside)))


def test_plan_size_depends_on_the_capacity():
    small = len(packing.plan({k: 1000 for k in range(1, 65)}, 64))
    assert len(packing.plan({k: 1_000_000 for k in range(1, 65)}, 64)) < 3 * small
    assert packing.plan({}, 64) == []
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


@pytest.mark.parametrize("at_once", [100_000, 3])
def test_pack(spark, monkeypatch, at_once):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", at_once)
    draw = random.Random(4)
    sizes = [0, 0, 8, 8, 9, 16, 17, 100] + [draw.choice([1, 2, 3, 5, 8]) for _ in range(200)] + [3] * 90
    rows = [(i, None if i == 0 else " ".join(["w"] * n), "x") for i, n in enumerate(sizes)] + [(5, "w w", "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = packing.pack(df, 8).collect()
    own = defaultdict(list)
    for r in out:
        own[r.doc_id].append(r)
    for i, n in enumerate(sizes):
        parts = sorted((r for r in own[i] if r.n_tokens == n), key=lambda r: r.part or 0)
        if n == 0:
            assert [(r.n_parts, r.container) for r in parts] == [(0, None)]
        else:
            assert sum(r.part_tokens for r in parts) == n and len(parts) == -(-n // 8)
            assert [r.token_from for r in parts] == [8 * k for k in range(len(parts))]
    boxes = defaultdict(list)
    for r in out:
        if r.container is not None:
            boxes[r.container].append((r.offset, r.part_tokens))
    for items in boxes.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 8
    assert sum(map(len, boxes.values())) == sum(-(-n // 8) for n in sizes) + 2
    assert packing.pack(df.limit(0), 8).count() == 0


def test_pivot_keeps_the_mass():
    for seed in range(50):
        draw = np.random.default_rng(seed)
        p, w = draw.random(99).tolist(), draw.integers(1, 500, 99).tolist()
        q, left = mixing.pivot(p, w, draw)
        assert sum(a * b for a, b in zip(p, w)) == pytest.approx(sum(a * b for a, b in zip(q, w)))
        assert all(x in (0.0, 1.0) for i, x in enumerate(q) if i != left) and 0 <= q[left] <= 1
    means = np.mean([mixing.pivot([0.3] * 9, [5, 1, 9, 2, 2, 7, 3, 3, 1], np.random.default_rng(s))[0] for s in range(4000)], axis=0)
    assert np.allclose(means, 0.3, atol=0.03)
    assert mixing.pivot([], [], np.random.default_rng(0)) == ([], -1)


@pytest.mark.parametrize("group, fan", [(20_000, 64), (5, 2)])
def test_mix(spark, monkeypatch, group, fan):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    draw = random.Random(8)
    names = ["a-b", " A_B", "c", "c ", "C", None, "other"]
    rows = [(i, draw.choice(names), " ".join(["w"] * draw.randint(0, 60)) if i % 50 else None, "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies string")
    targets = spark.createDataFrame([("A-b", 1.0, 3), ("c", 3.0, 2), ("none", 0.5, 2), ("nan", float("nan"), 2), ("null", None, None), (None, 4.0, 1)],
                                    "source string, weight double, max_repeats int")
    chosen, report = mixing.mix(docs, targets)
    chosen = {r.doc_id: r for r in chosen.collect()}
    report = {r.source: r for r in report.collect()}
    total = sum(len((t or "").split()) for _, _, t, _ in rows)
    assert set(report) == {"A-b", "c", "none", "nan", "null"}
    for name, key, share, most in (("A-b", "a-b", 1 / 4.5, 3), ("c", "c", 3 / 4.5, 2)):
        own = {i: len((t or "").split()) for i, s, t, _ in rows if s and s.strip().lower().replace("_", "-") == key}
        r = report[name]
        assert r.target_tokens == pytest.approx(share * total) and r.own_tokens == sum(own.values())
        got = sum(chosen[i].copies * n for i, n in own.items() if i in chosen)
        assert got == r.mixed_tokens
        want = min(share * total, most * sum(own.values()))
        assert abs(got - want) < 60 and r.short == (share * total > most * sum(own.values()))
        assert all(chosen[i].copies <= most for i in own if i in chosen)
    assert report["none"].short and not report["nan"].short and not report["null"].short
    assert report["c"].actual_share == pytest.approx(report["c"].mixed_tokens / sum(r.mixed_tokens for r in report.values()))
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(5), targets)[0].collect()}
    assert again == {i: r.copies for i, r in chosen.items()}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    chosen, report = mixing.mix(docs, targets)
    assert chosen.count() == 0 and [(r.source, r.short, r.actual_share) for r in report.collect()] == [("a", False, 0.0)]
    chosen, report = mixing.mix(docs, targets.limit(0))
    assert chosen.count() == report.count() == 0



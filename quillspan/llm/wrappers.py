"""Wrappers of a host's texts by union-free regular-expression inference.

The method named for markup residue. It is kept to measure how far it carries on a corpus (:func:`inferred`, from all texts of a host;
:func:`coverage`, from a sample): it presupposes that a host's
texts come from a template. Where they don't, :mod:`quillspan.llm.markup` reads the markup by grammar instead.

A text becomes a stream of markup tokens and text slots. Tandem repeats are folded into repeated groups. Then the stream of one text after
another is aligned with the wrapper so far, and wrappers with wrappers; what has no counterpart becomes optional. No alternatives (unions) arise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import BooleanType

from quillspan.llm.markup import _TAG, SIGNS
from quillspan.llm.topn import top_n
from quillspan.runtime import written

#: Texts per host that :func:`coverage` infers a wrapper from, those with the smallest hash of their id.
SAMPLE = 40
#: Distinct streams aligned in one task on average, and wrappers united in one.
CELL, FAN = 64, 8
#: One text in so many is held out to measure a wrapper that is inferred from the others.
HELD = 5
_MARK = re.compile(
    _TAG.pattern + r"|(?m:^#{1,6}(?= ))|(?m:^[*+-]{1,3}(?= ))|(?m:^\d{1,3}\.(?= ))|(?m:^(?:```|~~~))|(?m:^={2,6}|={2,6}$)|(?m:^\|)|\|"
    r"|\*\*|__|'{2,5}|\[\[|\]\]|\{\{|\}\}|\{\||!\[|\]\(|\\begin\{\w+\*?\}|\\end\{\w+\*?\}|\\[a-zA-Z]+\*?(?=[{ ])|\\[\[\]]|`|\$|<!--|-->|&#?\w+;",
    re.I,
)
TEXT = "#"
Atom = str | tuple
Wrapper = list[tuple[Atom, bool]]


def _dumped(x: object) -> bytes:
    return json.dumps(x).encode()


def _loaded(data: bytes) -> tuple:
    """What :func:`_dumped` wrote, with tuples for all sequences."""
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return tuples(json.loads(data))


def stream(text: str) -> list[Atom]:
    """Markup tokens in order, with one slot for any text between two of them; empty for texts without token."""
    out: list[Atom] = []
    at = 0
    for m in _MARK.finditer(text):
        if text[at : m.start()].strip():
            out.append(TEXT)
        out.append(f"<{m[1]}{m[2].lower()}>" if m[2] else m[0])
        at = m.end()
    if out and text[at:].strip():
        out.append(TEXT)
    return out


def _numbers(seq: list[Atom]) -> np.ndarray:
    number: dict[Atom, int] = {}
    return np.array([number.setdefault(x, len(number)) for x in seq], dtype=np.int64)


def _tandem(names: list[np.ndarray], size: int) -> list[tuple[int, int]]:
    """(start, times) of bodies of ``size`` atoms that stand at least twice in a row, from the left.

    ``names[t]`` numbers the stretches of 2**t atoms from each place on and is made when needed. A repeated body holds a whole
    stretch of 2**t <= (size + 1) / 2 atoms from a multiple of 2**t on; if none of these recurs ``size`` places later, nothing is repeated.
    """
    t = ((size + 1) // 2).bit_length() - 1
    while len(names) <= t:
        short, half = names[-1], 1 << (len(names) - 1)
        names.append(np.unique(short[:-half] * (short.max() + 1) + short[half:], return_inverse=True)[1])
    named, step = names[t], 1 << t
    if not (named[: len(named) - size : step] == named[size::step]).any():
        return []
    differ = np.flatnonzero(names[0][:-size] != names[0][size:])
    begins, ends = np.append(0, differ + 1), np.append(differ, len(names[0]) - size)
    enough = ends - begins >= size
    out: list[tuple[int, int]] = []
    free = 0
    for begin, end in zip(begins[enough].tolist(), ends[enough].tolist()):
        begin = max(begin, free)
        if end - begin >= size:
            out.append((begin, 1 + (end - begin) // size))
            free = begin + out[-1][1] * size
    return out


def folded(seq: list[Atom]) -> list[Atom]:
    """Tandem repeats of any length, shortest first, replaced by one group; again until there are none."""
    changed = True
    while changed:
        changed, size, names = False, 1, [_numbers(seq)]
        while 2 * size <= len(seq):
            if found := _tandem(names, size):
                out: list[Atom] = []
                at = 0
                for start, times in found:
                    body = tuple(seq[start : start + size])
                    out += seq[at:start]
                    out.append(body[0] if size == 1 and isinstance(body[0], tuple) else body)
                    at = start + times * size
                seq = out + seq[at:]
                changed, names = True, [_numbers(seq)]
            size += 1
    return seq


def grouped(seq: list[Atom], bodies: list[tuple]) -> list[Atom]:
    """Single occurrences of known groups as the group, the longest first."""
    tree: dict = {}
    for body in bodies:
        node = tree
        for a in body:
            node = node.setdefault(a, {})
        node[None] = body
    out: list[Atom] = []
    i = 0
    while i < len(seq):
        body, node, k = None, tree, i
        while node is not None:
            body = node.get(None, body)
            node = node.get(seq[k]) if k < len(seq) else None
            k += 1
        out.append(seq[i] if body is None else body)
        i += 1 if body is None else len(body)
    return [a for k, a in enumerate(out) if not (k and isinstance(a, tuple) and out[k - 1] == a)]


def _places(seq: list) -> Callable[[object], int]:
    """Gives, for an atom, a number with one bit set for each of its places in the stream."""
    own: dict[object, list[int]] = {}
    for p, x in enumerate(seq):
        own.setdefault(x, []).append(p)

    @lru_cache(1024)
    def bits(x: object) -> int:
        held = np.zeros(len(seq), dtype=np.uint8)
        held[own[x]] = 1
        return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    return lambda x: bits(x) if x in own else 0


def united(one: Wrapper, two: Wrapper) -> Wrapper:
    """The wrapper of all that either accepts, by their longest common subsequence.

    A row of the alignment is one number of ``len(two)`` bits, so that a row takes a few operations on long numbers. Every
    ``isqrt(len(one))``-th row is held, and those between two of them are made again on the way back: no length is too long for memory.
    """
    n, m = len(one), len(two)
    number: dict[Atom, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x, _ in w] for w in (one, two))
    where, full, step = _places(b[::-1]), (1 << m) - 1, max(1, isqrt(n))

    def above(row: int, i: int) -> int:
        # Bit m - 1 - j is 0 where the common subsequence of one[i:] and two[j:] is longer than that of one[i:] and two[j + 1:].
        u = row & where(a[i])
        return ((row + u) | (row - u)) & full

    def length(row: int, j: int) -> int:
        return m - j - (row & ((1 << (m - j)) - 1)).bit_count()

    kept = {n: full}
    row = full
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    out, i, j = [], 0, 0
    rows: dict[int, int] = {}
    here = below = -1  # lengths from (i, j) and from (i + 1, j) on; -1: not known for this i
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append((one[i][0], one[i][1] or two[j][1]))
            i, j, below = i + 1, j + 1, -1
            continue
        if i < n and j < m and below < 0:
            if i + 1 not in rows or i not in rows:
                end = min(i - i % step + step, n)
                rows = {end: kept[end]}
                for k in range(end - 1, i - 1, -1):
                    rows[k] = above(rows[k + 1], k)
            here, below = length(rows[i], j), length(rows[i + 1], j)
        if j == m or (i < n and here == below):
            out.append((one[i][0], True))
            i, below = i + 1, -1
        else:
            if i < n:
                below -= 1 - (rows[i + 1] >> (m - 1 - j) & 1)
            out.append((two[j][0], True))
            j += 1
    return out


def aligned(wrapper: Wrapper, seq: list[Atom]) -> Wrapper:
    """The wrapper, as (atom, optional), after alignment with one more stream."""
    return united(wrapper, [(a, False) for a in seq])


def accepts(wrapper: Wrapper, seq: list[Atom]) -> bool:
    """Whether the whole stream matches."""
    where = _places(seq)
    at = 1
    for atom, optional in wrapper:
        on = (at & where(atom)) << 1
        at = at | on if optional else on
    return bool(at >> len(seq) & 1)


def infer(texts: list[str]) -> tuple[list[tuple[Atom, bool]], list[tuple]]:
    """(wrapper, groups) of texts, in their order."""
    seqs = [folded(stream(t)) for t in texts]
    bodies = sorted({a for s in seqs for a in s if isinstance(a, tuple)}, key=lambda b: (-len(b), repr(b)))
    wrapper: list[tuple[Atom, bool]] | None = None
    for s in seqs:
        s = grouped(s, bodies)
        wrapper = [(a, False) for a in s] if wrapper is None else aligned(wrapper, s)
    return wrapper or [], bodies


def shown(atom: Atom) -> str:
    return atom if isinstance(atom, str) else "(" + " ".join(map(shown, atom)) + ")+"


_SCHEMA = "host string, wrapper string, atoms binary"


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    fitted = infer(pdf.sort_values("rank")["text"].tolist())
    text = " ".join(f"({shown(a)})?" if optional else shown(a) for a, optional in fitted[0])
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [text], "atoms": [_dumped(fitted)]})


@F.pandas_udf(BooleanType())
def _matches(text: pd.Series, atoms: pd.Series) -> pd.Series:
    known: dict[bytes, tuple] = {}
    out = []
    for t, a in zip(text, atoms):
        if a not in known:
            known.clear()
            known[a] = _loaded(a)
        wrapper, bodies = known[a]
        out.append(accepts(wrapper, grouped(folded(stream(t)), bodies)))
    return pd.Series(out)


def coverage(documents: DataFrame, host: str = "feed_id", sample: int = SAMPLE) -> DataFrame:
    """``(host, wrapper, held_out, matched)``: each host's wrapper from a sample, and how many of its other marked texts match it.

    Fitted on at most ``sample`` marked texts per host (bounded heap per host); all others are matched in full. Null hosts
    and texts without sign of markup are left out.
    """
    marked = documents.where(F.col(host).isNotNull() & F.col("text").rlike(SIGNS)).select(F.col(host).alias("host"), "doc_id", "text")
    by_hash = marked.select("host", F.xxhash64("doc_id").alias("h"), "doc_id")
    chosen = written(top_n(by_hash, "host", "h", "doc_id", sample), "wrapper-sample").select("host", "doc_id", "rank")
    fitted = written(marked.join(chosen, ["host", "doc_id"]).groupBy("host").applyInPandas(_fit, _SCHEMA), "wrappers")
    rest = marked.join(chosen.drop("rank"), ["host", "doc_id"], "left_anti").join(fitted.select("host", "atoms"), "host")
    got = rest.select("host", _matches("text", "atoms").alias("m")).groupBy("host").agg(
        F.count(F.lit(1)).alias("held_out"), F.count_if("m").alias("matched")
    )
    return fitted.select("host", "wrapper").join(got, "host", "left").fillna(0, ["held_out", "matched"])


# --- From all texts of a host ---------------------------------------------------------------------

def _inner(seq: list[Atom] | tuple) -> str:
    """Atoms as JSON without the outer brackets: a run of atoms is a part of the string."""
    return json.dumps(seq, ensure_ascii=False, separators=(",", ":"))[1:-1]


def _atoms(inner: str) -> list[Atom]:
    def atom(x):
        return tuple(map(atom, x)) if isinstance(x, list) else x

    return [atom(x) for x in json.loads(f"[{inner}]")]


_STREAM = T.StructType([
    T.StructField("stream", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("bodies", T.ArrayType(T.StringType())),
])


@F.pandas_udf(_STREAM)
def _streams(text: pd.Series) -> pd.DataFrame:
    seqs = [folded(stream(t)) for t in text]
    bodies = [sorted({_inner(a) for a in s if isinstance(a, tuple)}) for s in seqs]
    return pd.DataFrame({"stream": [_inner(s) for s in seqs], "size": pd.Series([len(s) for s in seqs], dtype="int32"), "bodies": bodies})


@F.pandas_udf(T.StringType())
def _regrouped(inner: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([_inner(grouped(_atoms(s), [tuple(_atoms(b)) for b in own])) for s, own in zip(inner, bodies)], dtype=object)


@F.pandas_udf(BooleanType())
def _accepted(inner: pd.Series, atoms: pd.Series) -> pd.Series:
    known: dict[bytes, Wrapper] = {}
    out = []
    for s, a in zip(inner, atoms):
        if a not in known:
            known.clear()
            known[a] = _loaded(a)
        out.append(accepts(known[a], _atoms(s)))
    return pd.Series(out, dtype=bool)


_CELLS = "host string, whole boolean, cell long, atoms binary"


def _joined(wrappers: Iterator[Wrapper], key: pd.DataFrame) -> pd.DataFrame:
    wrapper = next(wrappers)
    for w in wrappers:
        wrapper = united(wrapper, w)
    return key.assign(atoms=[_dumped(wrapper)])


def _fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    return _joined(([(a, False) for a in _atoms(s)] for s in sorted(pdf["stream"])), pdf[["host", "whole", "cell"]].iloc[:1])


def _fit_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cell")
    return _joined(map(_loaded, pdf["atoms"]), pdf[["host", "whole", "up"]].iloc[:1].rename(columns={"up": "cell"}))


@F.pandas_udf(T.StringType())
def _text(atoms: pd.Series) -> pd.Series:
    one = lambda w: " ".join(f"({shown(a)})?" if optional else shown(a) for a, optional in w)
    return atoms.map(lambda a: None if a is None else one(_loaded(a)))


def inferred(documents: DataFrame, host: str = "feed_id", cell: int = CELL, longest: int | None = None) -> DataFrame:
    """``(host, wrapper, texts, streams, too_long, held_out, matched)``: each host's wrapper from all its marked texts.

    ``texts`` counts the marked texts, ``streams`` their distinct folded streams. All of them shape the wrapper, unless ``longest`` is given:
    then ``too_long`` texts, whose stream has more atoms, don't (null if there is no other). A second wrapper is inferred without one
    text in ``HELD``, chosen by hash of doc_id; ``matched`` of these ``held_out`` texts match it (0 where no text is left to infer from).

    Equal streams are counted before the shuffle. Distinct ones are aligned in cells of about ``cell``, then wrappers are
    united in a tree, ``FAN`` at a time. Null hosts and texts without sign of markup are left out.
    """
    too_long = F.lit(False) if longest is None else F.col("size") > longest
    marked = documents.where(F.col(host).isNotNull() & F.col("text").rlike(SIGNS)).select(F.col(host).alias("host"), "doc_id", "text")
    held = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0, F.lit(False))
    rows = marked.select("host", held.alias("held"), _streams("text").alias("_s")).select("host", "held", "_s.*")
    counted = written(rows.groupBy("host", "stream", "size", "bodies").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("held").alias("held")
    ), "wrapper-streams")
    report = counted.groupBy("host").agg(
        F.sum("n").alias("texts"), F.count(F.lit(1)).alias("streams"),
        F.sum(F.when(too_long, F.col("n")).otherwise(0)).alias("too_long"),
    )
    both = F.explode(F.when(F.col("n") > F.col("held"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    shaping = counted.where(~too_long).withColumn("whole", both)
    groups = shaping.select("host", "whole", F.explode("bodies").alias("body")).groupBy("host", "whole").agg(F.sort_array(F.collect_set("body")).alias("_all"))
    groups = written(groups, "wrapper-groups")

    def regrouped(streams: DataFrame) -> DataFrame:
        own = F.filter(F.coalesce("_all", F.array().cast("array<string>")), lambda b: F.contains(F.col("stream"), b))
        return streams.join(groups, ["host", "whole"], "left").select("host", "whole", "n", "held", _regrouped("stream", own).alias("stream"))

    ready = written(regrouped(shaping.drop("bodies")).select("host", "whole", "stream").distinct(), "wrapper-ready")
    sizes = ready.groupBy("host", "whole").agg(F.ceil(F.count(F.lit(1)) / cell).alias("_cells"))
    most = sizes.agg(F.max("_cells")).first()[0] or 1
    cells = ready.join(sizes, ["host", "whole"]).select("host", "whole", "stream", F.pmod(F.xxhash64("stream"), "_cells").alias("cell"))
    fitted = written(cells.groupBy("host", "whole", "cell").applyInPandas(_fit_cell, _CELLS), "wrappers")
    while most > 1:
        up = fitted.withColumn("up", F.floor(F.col("cell") / FAN))
        fitted = written(up.groupBy("host", "whole", "up").applyInPandas(_fit_cells, _CELLS), "wrappers")
        most = -(-most // FAN)
    tested = regrouped(counted.where("held > 0").withColumn("whole", F.lit(False))).join(fitted.where("not whole").select("host", "atoms"), "host")
    matched = tested.select("host", "held", _accepted("stream", "atoms").alias("m")).groupBy("host").agg(
        F.sum("held").alias("held_out"), F.sum(F.when(F.col("m"), F.col("held")).otherwise(0)).alias("matched")
    )
    shown_ = fitted.where("whole").select("host", _text("atoms").alias("wrapper"))
    out = report.join(shown_, "host", "left").join(matched, "host", "left").fillna(0, ["held_out", "matched"])
    return out.select("host", "wrapper", "texts", "streams", "too_long", "held_out", "matched")

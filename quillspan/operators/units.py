"""Quantities in different units: reading the number, segmenting the unit string, and converting.

A unit string is segmented by dynamic programming over tries of prefixes, roots and exponents
(``kilo`` + ``metre`` + plural). The roots are the names of the unit list; a fixed table only adds
spellings of them. Where several decompositions remain, priors of the field that holds the string
together with the dimension that it would mean decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: prefixes, further spellings of unit names, exponents, multipliers ------------
LONG_PREFIXES = {"kilo": 3, "centi": -2, "milli": -3, "mega": 6, "micro": -6, "deci": -1, "hecto": 2}
SHORT_PREFIXES = {"k": 3, "c": -2, "m": -3}
#: name: further spellings; a name that the unit list lacks adds nothing.
SPELLINGS = {
    "metre": ("mtr",), "gram": ("gramme", "gm"), "kilogram": ("kilo",), "tonne": ("metric ton", "t"),
    "mile": ("mi",), "yard": ("yd",), "foot": ("feet", "ft"), "inch": ("in",), "pound": ("lb",), "ounce": ("oz",),
    "dollar": ("us dollar", "usd", "$", "us$"), "percent": ("per cent", "pct", "%"), "per mille": ("permille", "per mil", "‰"),
    "basis point": ("bp",), "second": ("sec",), "minute": ("min",), "hour": ("hr",),
}
#: name: letters that take the short prefixes; these names take the long ones.
SYMBOLS = {"metre": ("m",), "gram": ("g",), "litre": ("l",), "second": ("s",), "watt": ("w",)}
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3}
#: How a unit list names a power of another unit.
POWERS = {2: "square ", 3: "cubic "}
MULTIPLIERS = {
    "thousand": 1000, "thousands": 1000, "k": 1000, "million": 10**6, "millions": 10**6, "m": 10**6,
    "mn": 10**6, "billion": 10**9, "billions": 10**9, "bn": 10**9,
}
# ----------------------------------------------------------------------------------------------

#: How well a field speaks for a unit of a dimension, added to the segmentation's own score; ``""`` for all other dimensions.
#: ``raw+``, ``unit+``, ... : the same after a multiplier, which ``12m`` has only if it isn't 12 metres: a unit that follows it says so.
PRIORS: dict[str, dict[str, float]] = {
    "raw": {"": 3.0}, "unit": {"": 3.0}, "sign": {"money": 3.0, "": 2.0}, "after": {"": 2.0}, "paren": {"": 2.0}, "before": {"": 2.0},
    "caption": {"money": 1.5, "": 1.4},
    "raw+": {"": 4.0}, "unit+": {"": 4.0}, "sign+": {"money": 4.0, "": 3.0}, "after+": {"": 4.0}, "paren+": {"": 4.0}, "before+": {"": 4.0},
    "caption+": {"money": 2.5, "": 2.4},
}
_CACHED = 60_000


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def _walk(trie: dict, s: str, i: int) -> Iterator[tuple[int, str]]:
    """(end, word) of every word of the trie at ``s[i:]``, whatever its case; runs of blanks are one, full stops of abbreviations are left out."""
    node, n = trie, len(s)
    while i < n:
        ch = s[i]
        if ch.isspace():
            while i + 1 < n and s[i + 1].isspace():
                i += 1
            ch = " "
        child = node.get(ch.lower())
        i += 1
        if child is None:
            if ch != "." or node is trie:
                return
            continue
        node = child
        if "" in node:
            yield i, node[""]


Segment = tuple[str, str, str, Fraction, float]  # unit, dimension, common unit, factor, score


class UnitLexicon:
    """What a unit list can read: roots, their spellings, and prefixes and exponents on them."""

    def __init__(self, listed: Sequence[tuple[str, str, str, float]]):
        self.listed = {name.strip().lower(): (dim, common, Fraction(repr(factor))) for name, dim, common, factor in listed}
        metric = {n for n in self.listed if n in SYMBOLS or any(p + n in self.listed for p in LONG_PREFIXES)}
        #: spelling: (name, kinds of prefix it takes)
        self.roots: dict[str, list[tuple[str, str]]] = {}
        for name in self.listed:
            spellings = {name, *SPELLINGS.get(name, ())}
            spellings |= {x[:-3] + "ter" for x in spellings if x.endswith("tre")}  # metre, meter
            for x in spellings:
                self.roots.setdefault(x, []).append((name, "long" if name in metric and " " not in x and len(x) > 4 else ""))
            for x in SYMBOLS.get(name, ()):
                self.roots.setdefault(x, []).append((name, "short"))
        self._root, self._long, self._short = _trie(self.roots), _trie(LONG_PREFIXES), _trie(SHORT_PREFIXES)
        self._exponent = _trie(EXPONENTS)
        #: First words of spellings of several words; these take no prefix.
        self._opening = {x.split()[0] for x in self.roots if " " in x}
        self._seen: dict[tuple[str, bool], tuple] = {}

    def _unit(self, name: str, power: int, exponent: int, score: float) -> Segment | None:
        """The listed unit of a decomposition; None if the list has no such power of it."""
        if exponent != 1:
            name = POWERS.get(exponent, "?") + name
            if name not in self.listed:
                return None
        dim, common, factor = self.listed[name]
        return name, dim, common, factor * Fraction(10) ** (power * exponent), score

    def _ends(self, s: str) -> dict[int, list[Segment]]:
        """All decompositions that start at ``s[0]``, by where they end.

        The table's states are (position, stage), stages prefix, root, plural, exponent. Longer roots and fewer pieces score higher.
        """
        ends: dict[int, list[Segment]] = {}
        starts = [(0, "", 0, 0.0)]
        starts += [(i, "long", LONG_PREFIXES[p], -0.5) for i, p in _walk(self._long, s, 0)]
        starts += [(i, "short", SHORT_PREFIXES[p], -0.5) for i, p in _walk(self._short, s, 0)]
        for at, prefix, power, score in starts:
            for i, spelling in _walk(self._root, s, at):
                for name, takes in self.roots[spelling]:
                    if prefix and prefix != takes:
                        continue
                    for plural in ("", "s", "es"):
                        if plural and s[i : i + len(plural)].lower() != plural:
                            continue
                        j = i + len(plural)
                        worth = score + len(spelling) / 10 - (0.05 if plural else 0)
                        for k, exponent in ((j, 1), *((k, EXPONENTS[x]) for k, x in _walk(self._exponent, s, j))):
                            if got := self._unit(name, power, exponent, worth):
                                ends.setdefault(k, []).append(got)
        return ends

    def segment(self, text: str) -> tuple[Segment, ...]:
        """All decompositions of a whole unit string, best first; blanks and punctuation around it don't count."""
        key = (text, True)
        if key in self._seen:
            return self._seen[key]
        s = text.strip().strip(".,;:()").strip()
        ends = self._ends(s)
        got = tuple(sorted(ends.get(len(s), ()), key=lambda x: -x[4])) if s else ()
        return self._remember(key, got)

    def leading(self, text: str) -> tuple[Segment, ...]:
        """The decompositions of the longest unit string at the start of free text; the word "in" without full stop is the preposition."""
        word = text.split(None, 1)[0] if text and not text[0].isspace() else ""
        if word.lower().replace(".", "") in self._opening:  # may go on in the next word
            return self._leading(text)
        key = (word, False)
        return self._seen[key] if key in self._seen else self._remember(key, self._leading(word))

    def _leading(self, text: str) -> tuple[Segment, ...]:
        ends = self._ends(text)
        for end in sorted(ends, reverse=True):
            if end < len(text) and text[end - 1].isalpha() and (text[end].isalnum() or text[end] == "-"):
                continue  # inside a word
            if text[:end].lower() != "in" or text[end : end + 1] == ".":
                return tuple(sorted(ends[end], key=lambda x: -x[4]))
        return ()

    def _remember(self, key: tuple[str, bool], got: tuple) -> tuple:
        if len(key[0]) <= 64:
            if len(self._seen) >= _CACHED:
                self._seen.clear()
            self._seen[key] = got
        return got


_NUMBER = re.compile(r"(\d{1,3}(?:[  ]\d{3})+(?!\d)|\d[\d.,]*)(?:[  ](\d+)/(\d+)(?!\d))?(?:/(\d+))?")
_DECIMAL_COMMA = re.compile(r"(\d+(?:\.\d{3})*|\d+),(\d{1,2})")
_DECIMAL_POINT = re.compile(r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?")
_MINUS = re.compile(r"(?:^|[\s($])[-−]\s?\$?$")


def _plain(s: str) -> Fraction | None:
    """A number without fraction: blanks and commas before three digits group, a comma before one or two is decimal."""
    s = s.replace(" ", "").replace(" ", "").rstrip(".,")
    if s.isdigit():
        return Fraction(int(s))
    m = _DECIMAL_COMMA.fullmatch(s) or _DECIMAL_POINT.fullmatch(s)
    if not m:
        return None
    whole, part = m[1].replace(".", "").replace(",", ""), m[2] or ""
    return Fraction(int(whole + part), 10 ** len(part))


def read_number(raw: str) -> tuple[Fraction, str, str] | None:
    """(value, text before, text after) of the quantity in ``raw``; None where no number can be read.

    A minus sign directly before the number, or before its money sign, counts if nothing but a blank or bracket is before it.
    """
    m = _NUMBER.search(raw)
    if not m:
        return None
    whole = _plain(m[1])
    if whole is None or any(x is not None and int(x) == 0 for x in (m[3], m[4])):
        return None
    if m[2]:
        whole += Fraction(int(m[2]), int(m[3]))
    elif m[4]:
        whole /= int(m[4])
    before = raw[: m.start()]
    if before and _MINUS.search(before):
        whole = -whole
    return whole, before, raw[m.end() :]


_MULT = re.compile(r"\s*(thousand|million|billion|bn|mn|[kKm])(?![^\W\d_])\s*")
_CAPTION = re.compile(r"\b(?:in|figures in|amounts in) (thousands|millions|billions) of ([^:;(),]+)", re.I)
_CAPTIONED = re.compile("(?:thousand|million|billion)s of ", re.I)
_OWN_NUMBER = re.compile(r"\d[\d.,]*\s*,\s*$")
_MEASURED = re.compile(r"\b(?:measured|expressed|given) in ", re.I)
_PAREN = re.compile(r"\s*(?:\(\s*(?:all )?in ([^)]+)\)|,\s*(?:all )?in (?=([^,;]+)))", re.I)


def _place(raw: str, text: str) -> int:
    """Where ``raw`` stands in ``text`` by itself, not as part of a longer number; -1 if nowhere."""
    at = text.find(raw) if raw else -1
    while at >= 0:
        before, after = text[at - 1 : at] if at else "", text[at + len(raw) : at + len(raw) + 2]
        longer = before.isdigit() or before in (".", ",", "/") or after[:1].isdigit() or (after[:1] in (".", ",", "/") and after[1:].isdigit())
        if not longer:
            return at
        at = text.find(raw, at + 1)
    return -1


class Reader:
    """Scored readings of quantities by one unit list and its priors."""

    def __init__(self, lexicon: UnitLexicon, priors: Mapping[str, Mapping[str, float]] = PRIORS):
        self.units, self.priors = lexicon, priors

    def _caption(self, text: str, right: str) -> tuple[int, tuple[Segment, ...]] | None:
        """(multiplier, decompositions) of the caption that covers the number before ``right``.

        One that follows a number after a comma (``884, in thousands of dollars``) covers this number only and goes before the others,
        which cover the sentence.
        """
        end = len(text) - len(right)  # of the number
        covering: list[tuple[bool, int, tuple[Segment, ...]]] = []
        for m in _CAPTION.finditer(text):
            own = bool(right) and m.start() >= end and not text[end : m.start()].strip(" ,")
            if not own and _OWN_NUMBER.search(text[max(0, m.start() - 400) : m.start()]):
                continue
            if lead := self.units.leading(m[2]):
                covering.append((not own, MULTIPLIERS[m[1].lower()], lead))
        return min(covering, key=lambda c: c[0])[1:] if covering else None

    def _measured(self, left: str) -> tuple[Segment, ...]:
        """The unit of ``measured in X:`` directly before the number."""
        head = left.rstrip().rstrip("$").rstrip()
        if not head.endswith(":"):
            return ()
        last = None
        for last in _MEASURED.finditer(head):
            pass
        return self.units.segment(head[last.end() : -1]) if last else ()

    def readings(self, raw: str, unit: str | None, snippet: str | None) -> Iterator[tuple[str, Segment, Fraction]]:
        """(field, decomposition, value with multipliers) of every reading.

        The rest of ``raw`` after the number is read as it is, and once more with a multiplier taken off. A rest that is a unit ends
        the search; without one the unit stands in ``unit``, before or after the place of ``raw`` in the sentence, or in a caption.
        """
        number = read_number(raw)
        if number is None:
            return
        value, before, after = number
        text = snippet or ""
        at = _place(raw, text)
        left, right = (text[:at], text[at + len(raw) :]) if at >= 0 else ("", "")
        rests = [(after, value, "")]
        if m := _MULT.match(after):
            rests.append((after[m.end() :], value * MULTIPLIERS[m[1].lower()], "+"))
        for rest, v, more in rests:
            if tail := rest.strip():
                for s in self.units.segment(tail):
                    yield "raw" + more, s, v
                continue
            n = 0
            if unit:
                for n, s in enumerate(self.units.segment(unit), 1):
                    yield "unit" + more, s, v
            if before.rstrip().endswith("$") or left.endswith("$"):
                for n, s in enumerate(self.units.segment("$"), 1):
                    yield "sign" + more, s, v
            follows = [(right, v, more)]
            if not more and not after.strip() and (m := _MULT.match(right)):
                follows.append((right[m.end() :], v * MULTIPLIERS[m[1].lower()], "+"))
            measured = self._measured(left) if left else ()
            for r, w, plus in follows:
                if m := _PAREN.match(r):
                    for n, s in enumerate(self.units.segment(m[1]) if m[1] else self.units.leading(m[2]), 1):
                        yield "paren" + plus, s, w
                elif r and (lead := self.units.leading(r.lstrip())):
                    for n, s in enumerate(lead, 1):
                        yield "after" + plus, s, w
                for n, s in enumerate(measured, 1):
                    yield "before" + plus, s, w
            if not n and _CAPTIONED.search(text) and (caption := self._caption(text, right)):
                for s in caption[1]:
                    yield "caption" + more, s, v * caption[0]

    def best(self, raw: str | None, unit: str | None, snippet: str | None) -> tuple[str, str, str, float, int | None] | None:
        """(unit, dimension, common unit, value, amount) of the reading with the highest score."""
        if raw is None:
            return None
        top, score = None, float("-inf")
        for field, segment, value in self.readings(raw, unit, snippet):
            prior = self.priors.get(field, {})
            s = prior.get(segment[1], prior.get("", 0.0)) + segment[4]
            if s > score:
                top, score = (segment, value), s
        if top is None:
            return None
        (name, dimension, common, factor, _), value = top
        amount = value * factor
        whole = (2 * abs(amount.numerator) + amount.denominator) // (2 * amount.denominator)  # half away from zero
        whole = whole if amount >= 0 else -whole
        try:
            plain = float(amount)
        except OverflowError:
            plain = float("inf") if amount > 0 else float("-inf")
        return name, dimension, common, plain, whole if abs(whole) < 2**63 else None


_OUT = T.StructType([
    T.StructField("unit_name", T.StringType()), T.StructField("dimension", T.StringType()),
    T.StructField("common_unit", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("amount", T.LongType()),
])
#: The unit list is a fixed reference table; more rows than this are refused instead of collected.
MAX_UNITS = 10_000


def to_common_units(numbers: DataFrame, units: DataFrame, priors: Mapping[str, Mapping[str, float]] = PRIORS) -> DataFrame:
    """Every quantity in the common unit of its dimension.

    Returns ``(number_id, doc_id, unit_name, dimension, common_unit, value double, amount bigint)``, one row per
    row of ``numbers``; the last five are null where no number can be read or no listed unit is
    found in ``raw``, ``unit`` or ``snippet``. ``unit_name`` is the listed unit whose multiple was read (``metre`` for
    ``km`` if the list has no longer name for it). ``amount`` is rounded half away from zero from the exact
    rational value, null beyond 64 bits. Null or blank columns count as absent; repeated rows
    stay repeated; other columns are ignored. One Arrow pass, no shuffle.
    """
    listed = units.select("unit_name", "dimension", "common_unit", "factor").dropna().limit(MAX_UNITS + 1).collect()
    if len(listed) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units")
    rows = [tuple(r) for r in listed]
    readers: list[Reader] = []  # one per worker, made at its first batch

    @F.pandas_udf(_OUT)
    def convert(raw: pd.Series, unit: pd.Series, snippet: pd.Series) -> pd.DataFrame:
        if not readers:
            readers.append(Reader(UnitLexicon(rows), priors))
        none = (None,) * 5
        got = [readers[0].best(*(None if x is None or x != x else x for x in row)) or none for row in zip(raw, unit, snippet)]
        out = pd.DataFrame(got, columns=_OUT.names)
        out["amount"] = pd.array([g[4] for g in got], dtype="Int64")
        return out

    return numbers.select("number_id", "doc_id", convert("raw", "unit", "snippet").alias("_c")).select(
        "number_id", "doc_id", "_c.*"
    )

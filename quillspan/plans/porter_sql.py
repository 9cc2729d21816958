"""Porter's algorithm in SQL, written apart from the Python code: one step after the other over the distinct words.

In the words a ``y`` that is a consonant (at the start, or after a vowel) is written ``Y``, so vowels are ``[aeiouy]`` and the rest consonants.
"""

from __future__ import annotations

from collections.abc import Callable

from quillspan.functions.porter import STEP2, STEP3, STEP4

_V, _C = "[aeiouy]", "[^aeiouy]"


def _cut(n: int, w: str = "w") -> str:
    return f"left({w}, length({w}) - {n})"


def _some(w: str) -> str:
    """At least one vowel-consonant sequence."""
    return f"regexp_matches({w}, '{_V}{_C}')"


def _more(w: str) -> str:
    """At least two."""
    return f"regexp_matches({w}, '{_V}{_C}+{_V}+{_C}')"


def _cvc(w: str) -> str:
    return f"regexp_matches({w}, '{_C}{_V}[^aeiouywxY]$')"


def _suffixes(table: dict[str, str] | list[str], new: Callable[[str], str], holds: Callable[[str], str]) -> str:
    """The longest suffix is replaced where its condition holds."""
    cases = (f"WHEN ends_with(w, '{s}') THEN CASE WHEN {holds(new(s))} THEN {new(s)} ELSE w END" for s in sorted(table, key=len, reverse=True))
    return f"CASE {' '.join(cases)} ELSE w END"


def _replaced(table: dict[str, str]) -> str:
    cases = (
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_some(_cut(len(s)))} THEN {_cut(len(s))} || '{table[s]}' ELSE w END" for s in sorted(table, key=len, reverse=True)
    )
    return f"CASE {' '.join(cases)} ELSE w END"


_STEPS = (
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1)} ELSE w END",
    # What follows a cut -ed or -ing is settled in the next step; the sign marks such words.
    f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_some(_cut(3))} THEN {_cut(1)} ELSE w END "
    + " ".join(f"WHEN ends_with(w, '{s}') AND regexp_matches({_cut(len(s))}, '{_V}') THEN {_cut(len(s))} || '~'" for s in ("ed", "ing")) + " ELSE w END",
    f"""CASE WHEN NOT ends_with(w, '~') THEN w WHEN regexp_matches(w, '(at|bl|iz)~$') THEN {_cut(1)} || 'e'
      WHEN length(w) > 2 AND lower(w[-2]) = lower(w[-3]) AND regexp_matches(w, '{_C}~$') THEN CASE WHEN w[-2] IN ('l', 's', 'z') THEN {_cut(1)} ELSE {_cut(2)} END
      WHEN {_some(_cut(1))} AND NOT {_more(_cut(1))} AND {_cvc(_cut(1))} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
    f"CASE WHEN lower(right(w, 1)) = 'y' AND regexp_matches({_cut(1)}, '{_V}') THEN {_cut(1)} || 'i' ELSE w END",
    _replaced(STEP2),
    _replaced(STEP3),
    _suffixes(STEP4, lambda s: _cut(3 if s in ("sion", "tion") else len(s)), _more),
    f"CASE WHEN ends_with(w, 'e') AND ({_more(_cut(1))} OR ({_some(_cut(1))} AND NOT {_cvc(_cut(1))})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN ends_with(w, 'll') AND {_more('w')} THEN {_cut(1)} ELSE w END",
)


def stems(name: str, words: str) -> str:
    """CTEs that end in ``name`` (word, stem) of the distinct ``base`` of the table ``words``; words of one or two letters stay."""
    marked = "regexp_replace(regexp_replace(base, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    out = [f"{name}0 AS (SELECT DISTINCT base AS word, {marked} AS w FROM {words})"]
    out += [f"{name}{i} AS (SELECT word, {step} AS w FROM {name}{i - 1})" for i, step in enumerate(_STEPS, 1)]
    out.append(f"{name} AS (SELECT word, CASE WHEN length(word) < 3 THEN word ELSE lower(w) END AS stem FROM {name}{len(_STEPS)})")
    return ",\n  ".join(out)

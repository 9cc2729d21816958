"""Porter's stemming algorithm, with its author's later variants -bli and -logi."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values: the suffixes of steps 2 to 4 -------------------------------------------------
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()
)
# --------------------------------------------------------------------------------------------------


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _ends_cvc(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return len(stem) >= 3 and bool(re.search(r"[^aeiouwxy]$", stem)) and _shape(stem)[-3:] == "cvc"


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a word in small letters; words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("s"):
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith("ies"):
            w = w[:-3] + "i"
        elif not w.endswith("ss"):
            w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if cut is not None and "v" in _shape(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if s := _longest(w, STEP4):
        base = w[: -len(s)] + (s[0] if s in ("sion", "tion") else "")
        if _measure(base) > 1:
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    """:func:`stem` in Arrow batches; repeated words come from a cache of bounded size."""
    return words.map(lambda w: None if w is None else stem(w))

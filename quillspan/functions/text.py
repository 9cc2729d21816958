"""Text to tokens, and tokens to word emissions, as column expressions over one section."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import lexicon as L


def clean(body: Column) -> Column:
    """White space collapsed to single blanks, then symbols deleted (which may leave empty tokens)."""
    return F.regexp_replace(F.regexp_replace(body, r"\s+", " "), L.SYMBOLS, "")


def tokens(text: Column) -> Column:
    """The pieces between blanks; empty ones stay."""
    return F.split(text, " ", -1)


def is_number(c: Column) -> Column:
    return c.rlike(L.IS_NUMBER)


def is_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def java_hash(text: Column) -> Column:
    """The 32-bit signed hash of a string's UTF-16 units, 31 * h + unit from left to right."""
    pieces = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    units = F.transform(pieces, lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: (acc * 31 + u) % (1 << 32))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def among(w: Column, words: Iterable[str]) -> Column:
    """Whether ``w`` is one of the words; one pattern, where a literal per word would make plans that take seconds to build."""
    return w.rlike(f"^(?:{'|'.join(map(re.escape, words))})$") if words else F.lit(False)


def listed(column: str, words: Iterable[str]) -> Column:
    """The same for a named column, as a hashed set of compiled code."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"`{column}` in ({quoted})") if quoted else F.lit(False)


def skipped(w: Column) -> Column:
    """Words that the number rules own: postfixes, money, months, percent, distance, weight, numbers."""
    return among(w, _skipped_names()) | is_number(w)


def accepted(w: Column) -> Column:
    """At least two characters, and not a number with a one-letter postfix."""
    return (F.length(w) >= 2) & ~w.rlike(L.WORD_NUMBER)


def words(toks: Column) -> Column:
    """The words of a section in order, with what the pairing of capitals looks at."""

    def of_token(t: Column, i: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(L.WORD), F.lit(0))
        after = F.coalesce(F.get(toks, i + 1), F.lit(""))
        follows = F.regexp_replace(F.regexp_extract(after, L.NEXT_WORD, 1), "-+$", "")

        def one(w: Column, j: Column) -> Column:
            pair = (
                is_upper(w) & (j == F.size(found) - 1) & t.rlike(L.WORD_AT_END) & is_upper(follows) & ~skipped(w)
            )
            return F.struct(
                w.alias("w"), follows.alias("follows"), pair.alias("pair"), (pair & ~follows.contains("-")).alias("eats")
            )

        return F.transform(found, one)

    return F.flatten(F.transform(toks, of_token))


def word_emissions(ws: Column, stop_words: Sequence[str]) -> Column:
    """What the words give: array of (kind, base, cap).

    A capital word followed by a capitalised word makes an entity of two and takes the next
    word along, from left to right. That greedy pairing is a replacement over a string of
    flags: at every ``L`` that is not taken yet the following flag, whatever it is, becomes taken.
    """
    flags = F.array_join(F.transform(ws, lambda x: F.when(x["eats"], "L").otherwise("x")), "")
    taken = F.split(F.regexp_replace(flags, "L.", "Lc"), "")
    stop = list(stop_words)

    def emit(kind: str, key: Column, cap: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("base"), F.lit(cap).alias("cap"))

    def usable(w: Column, capital: bool) -> Column:
        test = F.lower(w) if capital else w
        return ~among(test, stop) & accepted(w)

    nothing = F.array().cast("array<struct<kind:string,base:string,cap:boolean>>")

    def one(x: Column, flag: Column) -> Column:
        w, nxt = x["w"], x["follows"]
        capital = F.concat(
            F.when(usable(w, True), F.array(emit("term", F.lower(w), True))).otherwise(nothing),
            F.when(x["pair"], F.array(emit("entity", F.upper(F.concat(w, F.lit(" "), nxt)), True))).otherwise(nothing),
            F.when(x["eats"] & usable(nxt, True), F.array(emit("term", F.lower(nxt), True))).otherwise(nothing),
        )
        lower = F.when(usable(w, False), F.array(emit("term", F.lower(w), False))).otherwise(nothing)
        return F.when((flag == "c") | skipped(w), nothing).when(is_upper(w), capital).otherwise(lower)

    # zip_with evaluates the flags once per section; inside a lambda they'd be made anew for every word.
    return F.flatten(F.zip_with(F.filter(ws, lambda x: x.isNotNull()), F.slice(taken, F.lit(1), F.size(ws)), one))


def hyphened(text: Column) -> Column:
    """Words joined by single hyphens, as they are: array of strings.

    Runs of word characters and hyphens are cut at double hyphens, since a regular expression with a repeated group
    of varying length would recurse for every part of a long run.
    """
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(L.HYPHEN_RUN), F.lit(0)), lambda r: F.split(r, "-{2,}", -1)))
    joined = F.transform(parts, lambda p: F.trim(p, F.lit("-")))
    return F.filter(joined, lambda p: p.contains("-") & accepted(p))


#: First characters of the strings of :func:`items` that need no further test: a term of a capital word, and one of another word.
CAPITAL, SMALL = "\x01", "\x02"


def _skipped_names() -> list[str]:
    return [*L.POSTFIXES, *L.DOLLARS, *L.MONTHS, *L.PERCENTS, *L.DISTANCES, *L.WEIGHTS]


def pairs(text: Column) -> Column:
    """What the greedy pairing of capital words takes, ``First Second`` from left to right, where :data:`IRREGULAR` does not occur.

    A match takes its second word along, so the next one starts behind it, which is the pairing.
    """
    names = "|".join(n for n in _skipped_names() if n[0].isascii() and n[0].isupper())
    return F.regexp_extract_all(text, F.lit(rf"{L.NO_WORD_BEFORE}(?!(?:{names}) )[A-Z]\w* \p{{Lu}}[\p{{L}}\p{{Nd}}-]*"), F.lit(0))


#: A capital word before a capitalised one that isn't itself a word of the section (letters outside ASCII, a hyphen at its end): such a
#: pair takes whatever word comes next, so the section's words are paired one by one.
IRREGULAR = (
    rf"{L.NO_WORD_BEFORE}[A-Z]\w* (?=\p{{Lu}})(?![A-Z][A-Za-z0-9]*(?![-A-Za-z0-9>\p{{L}}\p{{N}}\p{{M}}_]))(?![\p{{L}}\p{{Nd}}-]*-[\p{{L}}\p{{Nd}}])"
)


def items(text: Column, paired: Column, stop_words: Sequence[str]) -> Column:
    """Everything that words give in a section: array of words, of pairs (with a blank), of hyphen terms, and of terms marked as tested.

    Words stand for themselves and are tested one by one after they are exploded; a word that a pair takes gives the same term as alone,
    unless it belongs to the number rules, which is why those are added here.
    """
    stop = list(stop_words)
    second = lambda p: F.substring_index(p, " ", -1)
    taken = F.filter(paired, lambda p: among(second(p), _skipped_names()) & ~among(F.lower(second(p)), stop) & accepted(second(p)))
    regular = F.concat(F.regexp_extract_all(text, F.lit(L.WORD), F.lit(0)), paired, F.transform(taken, lambda p: F.concat(F.lit(CAPITAL), F.lower(second(p)))))
    one_by_one = F.transform(
        word_emissions(words(tokens(text)), stop_words),
        lambda e: F.when(e["kind"] == "entity", e["base"]).when(e["cap"], F.concat(F.lit(CAPITAL), e["base"])).otherwise(F.concat(F.lit(SMALL), e["base"])),
    )
    return F.concat(F.when(text.rlike(IRREGULAR), one_by_one).otherwise(regular), F.when(text.contains("-"), hyphened(text)).otherwise(F.array().cast("array<string>")))


def emitted(items_: DataFrame, item: str, stop_words: Sequence[str]) -> DataFrame:
    """``(doc_id, kind, base, cap)`` of exploded :func:`items`; ``cap`` is null where the case is kept as it is.

    Plain comparisons of one string, so that they are compiled; patterns are only tried on words that start with a digit.
    """
    s = F.col(item)
    first = F.ascii(s)
    rows = items_.select("doc_id", s, F.when(first < 3, "tested").when(s.contains(" "), "pair").when(s.contains("-"), "hyphen").alias("_what"),
                         first.between(48, 57).alias("_digit"), first.between(65, 90).alias("_capital"))
    rows = rows.withColumn("_test", F.when(F.col("_capital"), F.lower(s)).otherwise(s))
    number = F.col("_digit") & (is_number(s) | s.rlike(L.WORD_NUMBER))
    word = (F.length(s) >= 2) & ~listed("_test", stop_words) & ~listed(item, _skipped_names()) & ~number
    rows = rows.where(F.col("_what").isNotNull() | word)
    what = F.col("_what")
    base = (
        F.when(what.isNull(), F.lower(s)).when(what == "pair", F.upper(F.rtrim(s, F.lit("-")))).when(what == "tested", F.substr(s, F.lit(2)))
        .otherwise(s)
    )
    cap = F.when(what.isNull(), F.col("_capital")).when(what == "pair", True).when(what == "tested", first == 1)
    return rows.select("doc_id", F.when(what == "pair", "entity").otherwise("term").alias("kind"), base.alias("base"), cap.alias("cap"))


def numeric_contexts(toks: Column) -> Column:
    """For every token with a digit: the token and its neighbours, as far as the number rules look."""
    at = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i).rlike(r"\d"))
    near = lambda i, d: F.coalesce(F.get(toks, i + d), F.lit(""))
    return F.transform(
        at,
        lambda i: F.struct(
            i.alias("at"), near(i, 0).alias("tok"), near(i, -1).alias("before"), near(i, 1).alias("t1"),
            near(i, 2).alias("t2"), near(i, 3).alias("t3"),
        ),
    )

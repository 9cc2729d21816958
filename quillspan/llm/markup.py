"""Markup residue: recognising HTML, Markdown, wiki and LaTeX, and turning it into clean structured text.

A grammar of the four dialects reads each text in two steps. First the regions whose inside is
not read further are taken out (comments, scripts, code blocks, formulas), then tags, lines and inline marks of
the rest. Signs count only in the shape that their dialect requires, so prices, comparisons, file
paths, footnote stars, brackets and bullets in plain texts are left alone.

In the clean text headings start with ``#`` signs of their level, list items with ``- `` (two blanks more
per level), code blocks stand between lines of three backquotes, display formulas between ``$$`` and inline
formulas between ``$``; table rows keep ``|`` between cells. Everything else is plain text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: names of HTML elements, and of LaTeX environments and commands -----------------
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn "
    "div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label "
    "li link main mark meta nav nobr ol option p pre q s samp script section select small span strike strong style sub summary "
    "sup table tbody td textarea tfoot th thead title tr tt u ul var wbr"
).split()
BLOCKS = (
    "address article aside blockquote body br caption center dd details div dl dt figcaption figure footer form head header hr html "
    "li main nav ol option p section summary table tbody tfoot thead title tr ul"
).split()
VERBATIM = ("verbatim", "lstlisting", "Verbatim", "minted")
FORMULAS = ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "flalign")
LISTS = ("itemize", "enumerate", "description")
SECTIONS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
SILENT = ("cite", "citep", "citet", "label", "ref", "eqref", "pageref", "bibliography", "bibliographystyle", "usepackage",
          "documentclass", "includegraphics", "input", "include", "vspace", "hspace", "index", "footnotemark")
BARE = ("ldots", "dots", "noindent", "maketitle", "newpage", "clearpage", "tableofcontents", "hline", "centering", "LaTeX", "TeX")
# --------------------------------------------------------------------------------------------------

_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_ATTR = r"""\s+[a-zA-Z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)|\s+(?:checked|disabled|nowrap|noshade|hidden|async|defer|selected|readonly|required|compact)(?=[\s/>])"""
_TAG = re.compile(rf"<(/?)({_NAMES})((?:{_ATTR})*)\s*/?>", re.I)
_REF = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")
#: Texts without any of these have no markup; tested before a text leaves the JVM.
SIGNS = r"[<&*_#`\[{|~\\$]|''|(?m:^(?:={2}|={3,}\s*$|-{3,}\s*$))"

_OPEN = re.compile(
    r"(?P<comment><!--)|(?P<script><(?P<sname>script|style)\b[^<>]*>)|(?P<pre><pre\b[^<>]*>)"
    r"|(?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*\n)"
    rf"|(?P<verb>\\begin\{{(?P<vname>{'|'.join(VERBATIM)})\}})|(?P<env>\\begin\{{(?P<ename>(?:{'|'.join(FORMULAS)})\*?)\}})"
    r"|(?P<disp>\\\[)|(?P<par>\\\()|(?P<two>\$\$)|(?P<one>(?<![\\$\w])\$(?=[^\s$]))|(?P<tick>(?<!`)`(?!`))",
    re.M | re.I,
)
_INLINE_MATH = re.compile(r"\$([^$\n]*(?<=[^\s$\\]))\$(?![\d$])")
_MATHS = re.compile(r"[\\^_={}]")
_TICK = re.compile(r"`([^`\n]+)`(?!`)")


class _Seen(set):
    """Features found so far, and the pieces taken out of the text."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[str] = []

    def keep(self, piece: str) -> str:
        self.kept.append(piece)
        return f"\x00{len(self.kept) - 1}\x00"


def _block(kind: str, inside: str) -> str:
    return f"\n\n```\n{inside.strip(chr(10))}\n```\n\n" if kind == "code" else f"\n\n$$\n{inside.strip()}\n$$\n\n"


def _taken_out(text: str, seen: _Seen) -> str:
    """Replaces opaque regions by placeholders; an opener without closer stays as it is."""
    out: list[str] = []
    at = 0
    none: set[str] = set()  # closers that don't occur any more

    def close(closer: str, start: int, low: bool = False) -> int:
        if closer in none:
            return -1
        end = (lowered() if low else text).find(closer, start)
        if end < 0:
            none.add(closer)
        return end

    lower: list[str] = []

    def lowered() -> str:
        if not lower:
            lower.append(re.sub("[A-Z]", lambda m: m[0].lower(), text))  # keeps the length
        return lower[0]

    pos = 0
    while m := _OPEN.search(text, pos):
        kind, start, end, piece = m.lastgroup, m.end(), -1, ""
        kind = next(k for k in ("comment", "script", "pre", "fence", "verb", "env", "disp", "par", "two", "one", "tick") if m[k])
        if kind == "comment" and (e := close("-->", start)) >= 0:
            end, piece = e + 3, ""
            seen.add("html")
        elif kind == "script" and (e := close(f"</{m['sname'].lower()}>", start, True)) >= 0:
            end, piece = e + len(m["sname"]) + 3, "\n"
            seen.add("html")
        elif kind == "pre" and (e := close("</pre>", start, True)) >= 0:
            end, piece = e + 6, _block("code", html.unescape(_TAG.sub("", text[start:e])))
            seen |= {"html", "code"}
        elif kind == "fence":
            c = re.compile(rf"^[ ]{{0,3}}{re.escape(m['mark'][0])}{{{len(m['mark'])},}}[ \t]*$", re.M).search(text, start) if m["mark"] not in none else None
            if c:
                end, piece = c.end(), _block("code", text[start : c.start()])
                seen |= {"markdown", "code"}
            else:
                none.add(m["mark"])
        elif kind == "verb" and (e := close(f"\\end{{{m['vname']}}}", start)) >= 0:
            end, piece = e + len(m["vname"]) + 6, _block("code", text[start:e])
            seen |= {"latex", "code"}
        elif kind == "env" and (e := close(f"\\end{{{m['ename']}}}", start)) >= 0:
            end, piece = e + len(m["ename"]) + 6, _block("formula", text[start:e])
            seen |= {"latex", "formula"}
        elif kind in ("disp", "par", "two"):
            closer = {"disp": "\\]", "par": "\\)", "two": "$$"}[kind]
            e = close(closer, start)
            inside = text[start:e] if e >= 0 else ""
            if inside.strip() and "\n\n" not in inside and (kind != "two" or _MATHS.search(inside)):
                end = e + 2
                piece = f"${inside.strip()}$" if kind == "par" else _block("formula", inside)
                seen |= {"latex", "formula"}
        elif kind == "one" and (f := _INLINE_MATH.match(text, m.start())) and (_MATHS.search(f[1]) or re.fullmatch("[A-Za-z]", f[1])):
            end, piece = f.end(), f"${f[1]}$"
            seen |= {"latex", "formula"}
        elif kind == "tick" and (f := _TICK.match(text, m.start())):
            end, piece = f.end(), f[1]
            seen.add("markdown")
        if end < 0:
            pos = m.end()
            continue
        out += [text[at : m.start()], seen.keep(piece)]
        at = pos = end
    out.append(text[at:])
    return "".join(out)


_BLOCK_NAMES = frozenset(BLOCKS)


def _html(text: str, seen: _Seen) -> str:
    depth = [0]

    def tag(m: re.Match) -> str:
        seen.add("html")
        shut, name = m[1], m[2].lower()
        if re.fullmatch("h[1-6]", name):
            seen.add("heading")
            return "\n\n" if shut else seen.keep("\n\n" + "#" * int(name[1]) + " ")
        if name in ("ul", "ol"):
            seen.add("list")
            depth[0] = max(0, depth[0] + (-1 if shut else 1))
            return "\n"
        if name == "li":
            seen.add("list")
            return "" if shut else seen.keep("\n" + "  " * max(0, depth[0] - 1) + "- ")
        if name in ("td", "th"):
            return seen.keep(" | ") if shut else ""
        if name in ("p", "div", "table"):
            return "\n\n"
        return "\n" if name in _BLOCK_NAMES else ""

    if "<" in text:
        text = _TAG.sub(tag, text)
    if "&" in text:

        def ref(m: re.Match) -> str:
            plain = html.unescape(m[0])
            if plain == m[0]:
                return plain
            seen.add("html")
            return " " if plain == "\xa0" else seen.keep(plain)

        text = _REF.sub(ref, text)
    return text


_CMD = re.compile(r"\\([a-zA-Z]+)\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}")
_ITEM = re.compile(r"^([ \t]*)\\item\b(?:\[([^\]\n]*)\])?[ \t]*", re.M)
_BEGIN = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_BARE = re.compile(rf"(?<![\\\w:])\\(?:{'|'.join(BARE)})(?![a-zA-Z\\])(?:\{{\}})?")


def _latex(text: str, seen: _Seen) -> str:
    if "\\" not in text:
        return text

    def begin(m: re.Match) -> str:
        seen.add("latex")
        if m[2].rstrip("*") in LISTS:
            seen.add("list")
        return "\n"

    def item(m: re.Match) -> str:
        seen.update(("latex", "list"))
        return seen.keep("- ") + (f"{m[2]}: " if m[2] else "")

    def command(m: re.Match) -> str:
        seen.add("latex")
        name = m[1]
        if name in SECTIONS:
            seen.add("heading")
            return seen.keep("\n\n" + "#" * min(6, 1 + SECTIONS.index(name)) + " ") + m[2] + "\n\n"
        return "" if name in SILENT else m[2]

    text = _BEGIN.sub(begin, text)
    text = _ITEM.sub(item, text)
    n = 1
    while n:  # innermost first; each pass leaves fewer commands
        text, n = _CMD.subn(command, text)
    if _BARE.search(text):
        seen.add("latex")
        text = _BARE.sub("", text)
    return text.replace("~", " ") if "latex" in seen and re.search(r"~(?=\s|$)|(?<=\w[.,])~", text) else text


_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:([^\[\]|\n]*)\|)?([^\[\]\n]+?)\]\]")
_WIKI_URL = re.compile(r"(?<!\])\[(?:https?|ftp)://[^\s\]]+")
_TEMPLATE = re.compile(r"\{\{[^{}\n|]+(?:\|[^{}]*)?\}\}")
_QUOTES = re.compile("'{2,}")
_WIKI_ITEM = re.compile(r"^([*#]+)[ \t]*(?=[^\s*#])", re.M)


def _wiki_tables(text: str, table: Callable[[list[str]], str]) -> str:
    """Tables, from a line ``{|...`` to the next line that starts with ``|}``, if that holds nothing else. One pass over the lines."""
    lines = text.split("\n")
    ends = [-1] * len(lines)
    end = -1
    for i in range(len(lines) - 1, -1, -1):
        ends[i] = end  # the next line below that starts with the closing sign
        if lines[i].startswith("|}"):
            end = i
    out: list[str] = []
    i = 0
    while i < len(lines):
        if lines[i].startswith("{|") and ends[i] >= 0 and not lines[ends[i]][2:].strip(" \t"):
            out.append(table(lines[i + 1 : ends[i]]))
            i = ends[i]
        else:
            out.append(lines[i])
        i += 1
    return "\n".join(out)


def _wiki_quotes(line: str, seen: _Seen) -> str:
    """Emphasis by two, three or five quote marks: from a run before a word to the next run of as many behind one. One pass over the runs."""
    runs = [m.span() for m in _QUOTES.finditer(line)]

    def word_at(i: int) -> bool:
        return 0 <= i < len(line) and (line[i].isalnum() or line[i] == "_")

    closes: list[int] = [-1] * len(runs)  # the next closing run of the same length
    last: dict[int, int] = {}
    for r in range(len(runs) - 1, -1, -1):
        a, b = runs[r]
        closes[r] = last.get(b - a, -1)
        if a and not line[a - 1].isspace() and not word_at(b):
            last[b - a] = r
    out: list[str] = []
    at = r = 0
    while r < len(runs):
        a, b = runs[r]
        opens = b - a in (2, 3, 5) and not word_at(a - 1) and b < len(line) and not line[b].isspace()
        if opens and (c := closes[r]) >= 0:
            seen.add("wiki")
            out += [line[at:a], line[b : runs[c][0]]]
            at, r = runs[c][1], c
        r += 1
    return "".join(out) + line[at:]


def _wiki_urls(text: str, seen: _Seen) -> str:
    """``[http://place label]`` becomes the label; the next bracket and line end are looked for once, however many open brackets are before them."""
    out: list[str] = []
    at = pos = 0
    ahead = {"]": -1, "\n": -1}

    def following(sign: str) -> int:
        if ahead[sign] < pos:
            found = text.find(sign, pos)
            ahead[sign] = found if found >= 0 else len(text)
        return ahead[sign]

    while m := _WIKI_URL.search(text, pos):
        pos = m.end()
        end = following("]")
        if end == len(text):
            break
        if end > following("\n") or text[end + 1 : end + 2] == "(" or text[pos] not in " \t]":
            continue
        label = text[pos:end]
        if len(label) == 1:
            continue
        seen.add("wiki")
        out += [text[at : m.start()], label.lstrip(" \t") or label[-1:]]
        at = pos = end + 1
    return "".join(out) + text[at:]


def _wiki(text: str, seen: _Seen) -> str:
    def head(m: re.Match) -> str:
        seen.update(("wiki", "heading"))
        return seen.keep("#" * len(m[1]) + " ") + m[2]

    def link(m: re.Match) -> str:
        seen.add("wiki")
        return "" if re.match(r"(?i)(?:category|file|image):", m[1] if m[1] is not None else m[2]) else m[2]

    def template(m: re.Match) -> str:
        seen.add("wiki")
        return ""

    def table(lines: list[str]) -> str:
        seen.add("wiki")
        rows = [re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", seen.keep(" | "), x.lstrip("|!+ ").rstrip()) for x in lines]
        return "\n".join(x for x in rows if x.strip("- "))

    if "==" in text:
        text = _WIKI_HEAD.sub(head, text)
    if "{|" in text:
        text = _wiki_tables(text, table)
    if "{{" in text:
        n = 1
        while n:  # innermost first; each pass leaves fewer braces
            text, n = _TEMPLATE.subn(template, text)
    if "[" in text:
        text = _wiki_urls(_WIKI_LINK.sub(link, text), seen)
    if "''" in text:
        text = "\n".join(_wiki_quotes(line, seen) if "''" in line else line for line in text.split("\n"))
    return text


_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
_SETEXT = re.compile(r"(?:(?<=\n\n)|\A\n?)((?=[^\n]*\w)[^\n]+)\n(={3,}|-{3,})[ \t]*(?=\n|\Z)")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[\w -]*\])")
_REF_DEF = re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]*\S+[^\n]*$", re.M)
_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]*?[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])([^_\n]*?[^\s_])__(?![\w_])")
_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])")
_MD_TABLE = re.compile(r"^\|?[^\n|]+\|[^\n]*\n[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$(?:\n[^\n]*\|[^\n]*)*", re.M)
_BULLET = re.compile(r"^([ \t]*)(?:[-+*]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)


def _markdown(text: str, seen: _Seen) -> str:
    def mark(keep: Callable[[re.Match], str], *also: str) -> Callable[[re.Match], str]:
        def sub(m: re.Match) -> str:
            seen.update(("markdown", *also))
            return keep(m)

        return sub

    if "#" in text:
        # In a wiki text, lines of "# " one after the other are a numbered list.
        listed = "wiki" in seen and "markdown" not in seen and re.search(r"^[*#]+ [^\n]*\n[#*]+ ", text, re.M)
        if not listed:
            title = lambda t: t.rstrip(" \t").rstrip("#").rstrip(" \t") or t[0]
            text = _ATX.sub(mark(lambda m: seen.keep(m[1] + " ") + title(m[2]), "heading"), text)
    if "\n==" in text or "\n--" in text:
        text = _SETEXT.sub(mark(lambda m: seen.keep("# " if m[2][0] == "=" else "## ") + m[1], "heading"), text)
    if "|" in text:

        def table(m: re.Match) -> str:
            rows = m[0].split("\n")
            del rows[1]
            return "\n".join(re.sub(r"[ \t]*\|[ \t]*", seen.keep(" | "), r.strip().strip("|").strip()) for r in rows)

        text = _MD_TABLE.sub(mark(table), text)
    if "[" in text:
        text = _LINK.sub(mark(lambda m: m[1]), _IMAGE.sub(mark(lambda m: m[1]), text))
        if "markdown" in seen:
            text = _REF_DEF.sub("", text)
    if "*" in text or "_" in text:
        either = mark(lambda m: m[1] or m[2])
        text = _EM.sub(either, _STRONG.sub(either, text))
    return text


def _lists(text: str, seen: _Seen) -> str:
    """Bullets and numbers: marks of a list in Markdown, stars in wiki; in other texts they are plain signs."""
    if "wiki" in seen and "markdown" not in seen:

        def star(m: re.Match) -> str:
            seen.add("list")
            return "  " * (len(m[1]) - 1) + seen.keep("- ")

        return _WIKI_ITEM.sub(star, text)
    if "markdown" in seen:

        def bullet(m: re.Match) -> str:
            seen.add("list")
            return m[1] + seen.keep("- ")

        if "wiki" in seen:
            text = re.sub(r"^(\*+)[ \t]+(?=\S)", lambda m: "  " * (len(m[1]) - 1) + "* ", text, flags=re.M)
        return _BULLET.sub(bullet, text)
    return text


def parse(text: str) -> tuple[list[str], str]:
    """(sorted features, clean text) of one text."""
    seen = _Seen()
    rest = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", " ")
    rest = _taken_out(rest, seen)
    rest = _html(rest, seen)
    rest = _latex(rest, seen)
    rest = _wiki(rest, seen)
    rest = _markdown(rest, seen)
    rest = _lists(rest, seen)
    if not seen:
        return [], text
    for _ in range(len(seen.kept)):
        if "\x00" not in rest:
            break
        rest = re.sub("\x00(\\d+)\x00", lambda m: seen.kept[int(m[1])], rest)
    rest = re.sub(r"[ \t]+\n", "\n", rest)
    return sorted(seen), re.sub(r"\n{3,}", "\n\n", rest).strip()


_OUT = T.StructType([T.StructField("features", T.ArrayType(T.StringType())), T.StructField("clean", T.StringType())])


@F.pandas_udf(_OUT)
def _parse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else parse(t) for t in texts], columns=_OUT.names)


def cleaned(documents: DataFrame) -> DataFrame:
    """``(doc_id, features array<string>, clean string)``, one row per document.

    ``features`` holds the markups ``html``, ``markdown``, ``wiki``, ``latex`` that the whole text contains, and
    ``heading``, ``list``, ``code``, ``formula`` for the elements found in them, sorted; empty for plain
    texts. ``clean`` is the text without markup (see the module); a plain text comes back unchanged, null
    stays null. Texts without any sign that markup needs never leave the JVM. No shuffle.
    """
    marked = F.when(F.col("text").rlike(SIGNS), F.col("text"))
    parsed = documents.select("doc_id", "text", _parse(marked).alias("_p"))
    none = F.array().cast("array<string>")
    return parsed.select(
        "doc_id", F.coalesce("_p.features", none).alias("features"), F.coalesce("_p.clean", "text").alias("clean")
    )


def features(documents: DataFrame) -> DataFrame:
    """``(doc_id, feature)``: the features of :func:`cleaned`, one row each."""
    return cleaned(documents).select("doc_id", F.explode("features").alias("feature")).distinct()

"""Text column functions.  All of them stay in the JVM.

Regexes carry ``(?U)`` so that ``\\s``, ``\\w`` and ``\\d`` cover full-width forms and
``(?d)`` so that ``.`` stops at a newline only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


#: What ``(?U)\\s`` matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def given(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once per row, whatever ``build`` does with it.

    Tests built on it run as far as they must: the first that settles the answer ends them.
    """
    return F.get(F.transform(F.array(value), lambda v: build(v)), F.lit(0))


def strip(col: Column | str) -> Column:
    """Trim every Unicode space, U+3000 included."""
    return F.btrim(_c(col), F.lit(SPACES))


def is_blank(col: Column | str) -> Column:
    col = _c(col)
    return col.isNull() | ~col.rlike(r"(?U)\S")


def normalize_text(col: Column | str) -> Column:
    """Comparison form: no spaces, punctuation or symbols, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?U)[\s\p{P}\p{S}]+", ""))


def strip_page_prefix(col: Column | str) -> Column:
    """Drop any number of leading ``[P12]`` / ``[P12-03]`` tags."""
    return given(strip(F.coalesce(_c(col), F.lit(""))), without_tags)


def without_tags(t: Column) -> Column:
    """``strip_page_prefix`` of a trimmed text."""
    rest = strip(F.regexp_replace(t, r"(?i)(?U)^(?:\[P\d+(?:-\d+)?\]\s*)+", ""))
    return F.when(t.startswith("["), rest).otherwise(t)


PAGE_DIVIDER = r"(?U)^---\s*ページ\s*\d+\s*---$"


def strip_page_divider(col: Column | str) -> Column:
    lines = F.split(F.coalesce(_c(col), F.lit("")), r"\r?\n")
    return strip(F.array_join(F.filter(lines, lambda l: ~strip(l).rlike(PAGE_DIVIDER)), "\n"))


def latin_letters(col: Column) -> Column:
    return F.length(F.regexp_replace(col, "[^A-Za-z]+", ""))


def cjk_letters(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\x{3000}-\x{9FFF}]+", ""))


def is_western(col: Column | str) -> Column:
    """More Latin letters than CJK characters.  Only a text with both kinds is counted."""
    col = F.coalesce(_c(col), F.lit(""))
    latin = col.rlike("[A-Za-z]")
    return F.when(~col.rlike(r"[\x{3000}-\x{9FFF}]"), latin).otherwise(latin & (latin_letters(col) > cjk_letters(col)))


def is_mostly_latin(col: Column | str, share: float = 0.70) -> Column:
    """At least ``share`` of the letters and digits lie below U+0100."""
    word = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?U)[^\p{L}\p{N}]", "")
    latin = F.length(F.regexp_replace(word, r"[^\x{00}-\x{FF}]", ""))
    return (F.length(word) > 0) & (latin >= F.length(word) * F.lit(share))


def ends_sentence(col: Column | str) -> Column:
    """Ends in a full stop, question or exclamation mark, closing quotes and citations allowed."""
    return F.coalesce(
        strip(_c(col)).rlike(r"""[。.！？!?](?:\[[^\]]*\]|\([^)]*\)|[」』）)"'\]])*$"""), F.lit(False)
    )


# --- runaway repetition ------------------------------------------------------------

def clean_runaway(col: Column | str, mode: str = "app") -> Column:
    """Cut or fold recogniser loops.  The three modes differ in their limits."""
    text = _c(col)

    def cut(c: Column, pattern: str) -> Column:
        return strip(F.regexp_replace(c, "(?d)(?U)" + pattern + ".*$", ""))

    def fold(c: Column, pattern: str) -> Column:
        return F.regexp_replace(c, "(?U)" + pattern, "$1")

    if mode == "app":
        loop = r"((?:\([^\)]*\)|\S+)\s*)\1{3,}"
        shorter = cut(text, r"(\S)\1{4,}")
        shorter = cut(shorter, r"(\b\w+\b\s+)\1{3,}")
        shorter = cut(shorter, loop)
        # What the first two cut is a loop of the third, too, so a text without one only loses its outer spaces.
        text = F.when(text.rlike("(?U)" + loop), shorter).otherwise(strip(text))
    elif mode == "recognizer":
        text = fold(text, r"([^\s\d])\1{2,}")
        text = cut(text, r"([\d.\-_=])\1{4,}")
        text = cut(text, r"(\b\w+\b\s+)\1{2,}")
        text = fold(text, r"(\S{2,8})\1{2,}")
    elif mode == "region":
        text = cut(text, r"([^\s])\1{4,}")
        text = cut(text, r"(\b\w+\b\s+)\1{3,}")
    else:
        raise ValueError(f"unknown mode {mode!r}")

    def bracketed(c: Column, misread: str) -> Column:
        fixed = F.regexp_replace(c, rf"(?U)(\b\d{{4}}[a-z]?){misread}\.", "$1].")
        return F.when(c.contains(misread + "."), fixed).otherwise(c)

    return given(text, lambda c: given(bracketed(c, "l"), lambda d: bracketed(d, "1")))


# --- joining lines -----------------------------------------------------------------

_ALNUM_START = "^[A-Za-z0-9]"
_ALNUM_END = "[A-Za-z0-9]$"


def _pieces(lines: Column, build) -> Column:
    kept = F.filter(F.transform(lines, strip), lambda l: l != "")
    # The kept array is computed once, so that every element can look at its neighbours without trimming all lines again.
    return given(kept, lambda all_: F.array_join(F.transform(all_, lambda l, i: build(all_, l, i)), ""))


def join_western(lines: Column) -> Column:
    """Join with spaces; a hyphen at a line end is dropped and the word closed up."""

    def build(all_, line, i):
        glued = (i > 0) & F.get(all_, i - 1).endswith("-")
        gap = F.when((i == 0) | glued, "").otherwise(" ")
        body = F.when(
            (i < F.size(all_) - 1) & line.endswith("-"), F.left(line, F.length(line) - 1)
        ).otherwise(line)
        return F.concat(gap, body)

    return _pieces(lines, build)


def join_spaced_alnum(lines: Column) -> Column:
    """Join directly, with a space only between two ASCII letters or digits."""

    def build(all_, line, i):
        both = (i > 0) & F.get(all_, i - 1).rlike(_ALNUM_END) & line.rlike(_ALNUM_START)
        return F.concat(F.when(both, " ").otherwise(""), line)

    return _pieces(lines, build)


def join_lines(lines: Column | str, western: Column | bool) -> Column:
    """Body lines of one paragraph: Western with spaces, Japanese end to end."""
    lines = _c(lines)
    plain = F.array_join(lines, "")
    if isinstance(western, bool):
        return join_western(lines) if western else plain
    return F.when(western, join_western(lines)).otherwise(plain)


# --- wrapping ------------------------------------------------------------------------

# Characters that may not start a line.
NO_LINE_START = "、。，．）」』】！？!?：；ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮ"


def wrap_paragraph(col: Column | str, n: int) -> Column:
    """Break a paragraph every ``n`` characters; a character that may not start a line is
    pulled up to the line before.  Text already free of newlines is expected."""
    # A line is n characters, plus one more when that one may not start the next line; the
    # greedy optional tail does the pulling up, and the regex engine walks the text once.
    piece = rf"(?s)(?:.{{{n}}}[{NO_LINE_START}]?|.{{1,{n - 1}}})" if n > 1 else (
        rf"(?s).[{NO_LINE_START}]?"
    )
    return F.array_join(F.regexp_extract_all(_c(col), F.lit(piece), F.lit(0)), "\n")

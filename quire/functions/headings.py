"""Heading tests and chapter keys as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import (
    PAGE_DIVIDER,
    _c,
    given,
    is_western,
    normalize_text,
    strip,
    strip_page_prefix,
    without_tags,
)

# Character classes shared by the heading patterns.
KANJI_DIGITS = "一二三四五六七八九十"
CHAPTER_DIGITS = "0-9０-９一二三四五六七八九十百千万"
ROMAN = "IVXLCDMivxlcdm"
ENUMERATOR = r"^[（(\[［][0-9０-９一二三四五六七八九十a-zA-Z]+[）)\]］]$"
NOTE_TAG = r"(?U)^【(?:注釈文|注)\d+】"
SENTENCE_TAIL = "[。、,;；！!？?]$"

# A Japanese phrase that marks running text, for numbered chapter titles.
CHAPTER_STOP_PHRASES = ["である", "でした", "ました", "ません", "における", "について"]

# Chapter title patterns (flag i = ignore case).
MAJOR_PATTERNS = [
    rf"(?i)^第[{CHAPTER_DIGITS}]+[章編部](?:[\s　・:：].*)?$",
    r"(?i)^(?:序章|終章|補章|間章|プロローグ|エピローグ)(?:[\s　・:：].*)?$",
    rf"(?i)^(?:Chapter|Part|Book|Volume)\s+[0-9{ROMAN}]+(?:\s*[:–—-].*)?$",
    r"(?i)^(?:Introduction|Conclusion|Conclusions|References|Bibliography|Abstract)(?:\s*[:–—-].*)?$",
]
NUMBERED_TITLE = rf"^(?:\d+|[０-９]+|[{KANJI_DIGITS}]+)(?:[.．、\s　]+)[^\r\n]{{2,80}}$"
NUMBERED_TITLE_STOPS = [
    r"^\d+(?:\.\d+)+",
    r"^[（(\[【]",
    rf"^第[{CHAPTER_DIGITS}]+[節項条回]",
]

# Marks and openings of noise lines.
NOISE_MARK = "[〇○●―─—■▲▼・]"
NOISE_OPENING = (
    "^(?:これに対して|それに対して|したがって|そのため|しかしながら|また[、,]|その一方で|このように|前述したように)"
)

# Phrases that mark running text.
JAPANESE_STOP_PHRASES = [
    "における", "について", "により", "によって", "として", "に対する", "に対して", "に関する",
    "としての", "についての", "からの", "なので", "ですが", "であり", "である",
    "でした", "ました", "ません", "などの", "といった", "ような", "ながら",
    "ている", "ていた", "となった", "となる", "を行った", "を行う", "にあった", "にある",
    "に伴い", "に基づき", "に関して", "をはじめ", "を中心に", "を踏まえ", "とともに",
]
ENGLISH_STOP_PHRASES = [
    " was ", " were ", " has been ", " have been ", " had been ",
    " is being ", " are being ", " was being ", " were being ",
    " can be ", " could be ", " will be ", " would be ", " should be ", " may be ", " must be ",
    " underwent ", " argued that ", " stated that ", " demonstrated that ", " showed that ",
    " observed that ", " according to ",
]

# Words that may stay in lower case inside a title.
MINOR_WORDS = [
    "a", "an", "the", "and", "but", "or", "nor", "for", "on", "at", "to", "from",
    "by", "with", "in", "of", "since", "as", "into", "onto", "via", "&", "over",
    "under", "between", "through", "during", "without", "against", "around",
    "towards", "toward", "until", "about", "within", "after", "before", "among",
    "their", "his", "her", "its", "our", "your", "per",
]
# A small letter opens the first word, or a word longer than any minor one: no title, whatever else there is.
NO_TITLE = r"^[ \t–—-]*(?:[bd-z][a-z]|a[a-mo-z]|c[a-np-z])|[ \t–—-][bd-z][a-z]{7}"

# Subheading patterns.
TAIL_40 = r"(?:[\s　]*[^\r\n]{0,40})?$"
SUB_PATTERNS = [
    rf"^第[{CHAPTER_DIGITS}]+[章節項条部編回話巻段階](?:[\s　・:：].*)?$",
    rf"^(?:\d+|[０-９]+|[{KANJI_DIGITS}百]+)$",
    rf"^[（(][0-9０-９{KANJI_DIGITS}a-zA-Z]+[）)]{TAIL_40}",
    rf"^[①-⑳❶-❿⓫-⓴㊀-㊉]{TAIL_40}",
    r"^\d+(?:\.\d+)+(?:[\s　]+[^\r\n]{0,40})?$",
    rf"^[{KANJI_DIGITS}]+の[{KANJI_DIGITS}]+(?:[\s　]+[^\r\n]{{0,40}})?$",
    r"^[■●▲◆▼★☆・▶▷◇○□][\s　]*(?:[^\r\n]{1,40})$",
    "^(?:はじめに|おわりに|目次|要約|概要|研究背景|関連研究|提案手法|実験結果|考察|結論|まとめ|謝辞|参考文献|付録)$",
    r"(?i)^(?:(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Final|Initial)\s+"
    r"(?:Stage|Phase|Part|Step|Section|Chapter|Level)|(?:Stage|Phase|Part|Step|Section|Chapter|Level)\s+"
    rf"(?:[0-9{ROMAN}]+|[A-Za-z]+))(?:\s*[:–—-]\s*.*)?$",
    rf"(?i)^(?:Chapter|Section|Part|Appendix|Book|Volume)\s+[0-9{ROMAN}]+(?:\.[0-9]+)*"
    r"(?::\s*[A-Za-z0-9\s,-]{0,50})?$",
    r"(?i)^(?:Introduction|Background|Methods|Methodology|Results|Discussion|Conclusion|Conclusions|Abstract|"
    r"Summary|References|Bibliography|Acknowledgments|Overview|Objectives|Analysis)"
    r"(?::\s*[A-Za-z0-9\s,-]{0,50})?$",
    r"^[A-Z]\.\s+(?:Introduction|Background|Methods|Methodology|Results|Discussion|Conclusion|Overview|Summary|"
    r"[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){0,4})$",
]
SUB_SIGNS, SUB_WORDS = SUB_PATTERNS[:8], SUB_PATTERNS[8:]  # the latter open with a letter A-Z
SUB_BRACKETS = ["【】", "［］", "[]", "〔〕", "〈〉", "《》", "『』", "「」"]
SUB_NUMBERED = rf"^(?:\d+|[０-９]+|[{KANJI_DIGITS}百]+)(?:[、．.\s　]+[^\r\n]{{1,50}})$"
SUB_NUMBERED_STOPS = [
    rf"^[{KANJI_DIGITS}百]+[\s　]+[^\s　]{{6,}}",
    r"^\d+[\s　]*(?:年|月|日|ページ|頁|人|割|％|%|個|件|回|番|つ|段階で|において|年代)",
]
NUMBER_WITH_DOT = (
    rf"(?i)^(?:(?:\d+|[A-Za-z]|[{ROMAN}]+)|(?:Chapter|Section|Part|Appendix)\s+(?:\d+|[{ROMAN}]+))\.$"
)


def bracket_patterns() -> list[str]:
    """A short bracketed title, optionally followed by a little text."""
    out = []
    for left, right in SUB_BRACKETS:
        inner = f"[^{'\\' if right == ']' else ''}{right}\\r\\n]"
        esc = (lambda ch: "\\" + ch if ch in "[]" else ch)
        out.append(rf"^{esc(left)}{inner}{{1,35}}{esc(right)}(?:[\s　]*[^\r\n]{{0,35}})?$")
    return out


def _has(col: Column, pattern: str) -> Column:
    return col.rlike("(?d)(?U)" + pattern)


def _any(col: Column, patterns: list[str]) -> Column:
    """Does the start of the text fit one of the patterns?  All open with ``^`` and share one pass."""
    return _has(col, "^(?:" + "|".join(f"(?:{p.replace('^', '', 1)})" for p in patterns) + ")")


def _tail(t: Column, pattern: str, n: int = 1) -> Column:
    """Does a trimmed text end in ``pattern``, which looks at the last ``n`` characters only?"""
    return F.right(t, F.lit(n)).rlike(pattern)


def _holds_any(col: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(p) for p in phrases])


def is_noise_heading(col: Column | str) -> Column:
    """Three or more filler marks, four equal characters in a row, or a connective opening."""
    return given(strip_page_prefix(col), noise_of)


def noise_of(clean: Column) -> Column:
    """``is_noise_heading`` of a text free of page tags."""
    return (
        (clean == "")
        | _has(clean, NOISE_OPENING)
        | clean.rlike(f"(?:{NOISE_MARK}{NOISE_MARK.replace('[', '[^', 1)}*){{3}}")
        | _has(clean, r"(.)\1{3}")
    )


def _numbered_title(t: Column) -> Column:
    return (
        _has(t, NUMBERED_TITLE)
        & ~_any(t, NUMBERED_TITLE_STOPS)
        & ~_holds_any(t, CHAPTER_STOP_PHRASES)
    )


def is_major_heading(col: Column | str) -> Column:
    """Chapter, part or standard section title."""
    return given(strip_page_prefix(col), major_of)


def major_of(t: Column) -> Column:
    """``is_major_heading`` of a text free of page tags."""
    return (t != "") & ~_tail(t, SENTENCE_TAIL) & (_any(t, MAJOR_PATTERNS) | _numbered_title(t))


def normalize_number(col: Column | str) -> Column:
    """Full-width and kanji digits to ASCII; only a lone 十 becomes 10."""
    col = _c(col)
    return F.when(col == "十", "10").otherwise(
        F.translate(col, "０１２３４５６７８９一二三四五六七八九", "0123456789123456789")
    )


def chapter_key(col: Column | str) -> Column:
    """Key that equal chapters share; null when the text opens no chapter."""
    return given(strip_page_prefix(col), _key)


def _key(t: Column) -> Column:
    numbered = rf"(?i)^第([{CHAPTER_DIGITS}]+)([章編部])"
    named = r"(?i)^(序章|終章|補章|間章|プロローグ|エピローグ)"
    english = rf"(?i)(?U)^(?:Chapter|Part|Book|Volume)\s+([0-9{ROMAN}]+)"
    minor = (
        _has(t, rf"^第[{CHAPTER_DIGITS}]+[節項条回]")
        | _has(t, rf"(?i)^(?:Section|Sec\.)\s+[0-9{ROMAN}]+")
        | _has(t, r"^[（(\[【①-⑳❶-❿]")
        | _has(t, r"^\d+(?:\.\d+)+")
        | _subheading(t, t)
    )
    return (
        F.when((t == "") | _tail(t, SENTENCE_TAIL), F.lit(None).cast("string"))
        .when(
            _has(t, numbered),
            F.concat(F.lit("第"), normalize_number(F.regexp_extract(t, numbered, 1)),
                     F.regexp_extract(t, numbered, 2)),
        )
        .when(_has(t, named), F.regexp_extract(t, named, 1))
        .when(_has(t, english), F.concat(F.lit("chapter_"), F.lower(F.regexp_extract(t, english, 1))))
        .when(
            _numbered_title(t),
            F.concat(
                F.lit("heading_num_"),
                normalize_number(F.regexp_extract(t, rf"(?U)^(?:\d+|[０-９]+|[{KANJI_DIGITS}]+)", 0)),
            ),
        )
        .when(~major_of(t) & minor, F.lit(None).cast("string"))
        .when(F.length(t) <= 80, normalize_text(t))
    )


def _title_case(t: Column) -> Column:
    """Two to ten words, every one that counts starting with a capital."""
    words = F.filter(
        F.split(F.regexp_replace(t, r"(?U)['’]s\b", ""), r"[ \t–—-]"), lambda w: w != ""
    )

    def plain(w: Column) -> Column:
        return F.regexp_replace(w, "[^A-Za-z0-9]+", "")

    def counts(p: Column) -> Column:
        return (F.length(p) > 1) & ~p.rlike("^[0-9]+$")

    def later(p: Column) -> Column:
        return counts(p) & ~F.lower(p).isin(MINOR_WORDS)

    def capital(p: Column) -> Column:
        return p.rlike("^[A-Z]|^(?i:anti|connected)")

    def all_capital(w: Column) -> Column:
        return (
            F.size(w).between(2, 10)
            # The first word counts even if it is a minor one; most lines end the test there.
            & given(plain(F.get(w, F.lit(0))), lambda p: ~counts(p) | capital(p))
            & F.forall(w, lambda x: given(plain(x), lambda p: ~later(p) | capital(p)))
            & (counts(plain(F.get(w, F.lit(0)))) | F.exists(w, lambda x: given(plain(x), later)))
        )

    return (
        (F.length(t) <= 80) & ~t.rlike(r"^[\[(]") & ~t.rlike(NO_TITLE) & ~t.rlike("[,:;]") & given(words, all_capital)
    )


def is_subheading(col: Column | str) -> Column:
    """Section titles, numbered or bracketed items, keyword lines and Title Case lines."""
    return given(F.coalesce(_c(col), F.lit("")), lambda raw: given(strip(raw), lambda t: _subheading(raw, t)))


def subheading_of(t: Column) -> Column:
    """``is_subheading`` of a trimmed text."""
    return _subheading(t, t)


def _subheading(raw: Column, t: Column) -> Column:
    """``t`` is the trimmed ``raw``.  Quick tests come first, what few lines reach last."""
    opened = t.rlike(r"^[【［\[〔〈《『「]")
    wrapped = t.rlike(r"(?s)^\(.*\)$|^（.*）$|^\[.*\]$|^［.*］$")
    out_of_form = (
        (t == "")
        | (F.length(t) > 120)
        | raw.rlike("^[　 \t]")
        | t.contains("。")
        | _tail(t, r"""(?:[、,;；！!？?]|\."|!'|\?')$""", 2)
        | (t.endswith(".") & ~_has(t, NUMBER_WITH_DOT))
        | _has(t, r"^【(?:注釈文|注)\d+】")
        | _has(t, r"^\[(?:注釈文|注)?\d+\]")
        | t.rlike(PAGE_DIVIDER)
        | (_tail(t, r"[」』）)\]］]$") & (~opened | wrapped) & ~_has(t, ENUMERATOR))
    )
    formed = F.when(_has(t, "(?i)^[a-z]"), _any(t, SUB_WORDS)).otherwise(
        _any(t, SUB_SIGNS + bracket_patterns()) | (_has(t, SUB_NUMBERED) & ~_any(t, SUB_NUMBERED_STOPS))
    )

    def settled(western: Column) -> Column:
        running = F.when(
            western,
            given(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), lambda s: _holds_any(s, ENGLISH_STOP_PHRASES)),
        ).otherwise(_holds_any(t, JAPANESE_STOP_PHRASES))
        return (
            ((F.length(t) <= 60) | western)
            & (formed | (western & _title_case(t)))
            & ~running
            & ~given(without_tags(t), noise_of)
        )

    return ~out_of_form & given(is_western(t), settled)


def is_subheading_line(
    text: Column, left_gap: Column, avg_char: Column, is_vertical: Column
) -> Column:
    """Subheading test for a placed line: an indented horizontal line only counts when bracketed."""
    indented = (
        ~is_vertical
        & (avg_char > 0)
        & (left_gap >= avg_char * 0.75)
        & ~strip(text).rlike(r"^[【［\[]")
    )
    whole = given(strip(F.coalesce(text, F.lit(""))), lambda t: _subheading(t, t))
    return ~indented & ~F.coalesce(text, F.lit("")).rlike("^[　 \t]") & whole

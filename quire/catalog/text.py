"""Text and heading function queries."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import SPACE, d_has, d_norm, d_prefix, d_strip, query
from quire.catalog.lines import LINES
from quire.catalog.reading import d_ends
from quire.functions import headings as H
from quire.functions import text as T
from quire.operators import paragraphs as P
from quire.plans import fixtures as X

# Lines dressed up as headings, notes and tagged items, one dress per line number, mostly in front of
# the whole line; the text is valid in both engines.
_DRESS = """CASE CAST(ord % 40 AS INT)
  WHEN 0 THEN concat('第', ord % 12, '章 ', text) WHEN 1 THEN concat('第', ord % 9, '節 ', text)
  WHEN 2 THEN concat('（', ord % 9, '） ', text) WHEN 3 THEN '【小見出し】概要'
  WHEN 4 THEN concat('Chapter ', ord % 20, ': ', text) WHEN 5 THEN concat(ord % 30, '. ', text)
  WHEN 6 THEN '序章 民族自決' WHEN 7 THEN concat(ord % 30, ' はじめに') WHEN 8 THEN '一　研究背景'
  WHEN 9 THEN '1.2.3 実装' WHEN 10 THEN '■ 結論' WHEN 11 THEN 'まとめ' WHEN 12 THEN 'Second Stage – Gradual Loss'
  WHEN 13 THEN 'Political and Economic Landscape' WHEN 14 THEN 'Results: part 2' WHEN 15 THEN 'A. Overview'
  WHEN 16 THEN '[P12-03] [P3] 十' WHEN 17 THEN concat('[P', ord % 50, '] ', text) WHEN 18 THEN '第十一章　終わり'
  WHEN 19 THEN '研究における方法' WHEN 20 THEN 'it was according to plan' WHEN 21 THEN '・・・・' WHEN 22 THEN 'aaaa bbbb'
  WHEN 23 THEN 'したがって次' WHEN 24 THEN concat('【注', ord, '】 ', text) WHEN 25 THEN '(Medvedev 2020, 218)'
  WHEN 26 THEN '『作品について』' WHEN 27 THEN '　字下げ本文' WHEN 28 THEN concat('結論。', text)
  WHEN 29 THEN '彼は言った。」' WHEN 30 THEN '終わり。［1］' WHEN 31 THEN 'He left.[12](a)' WHEN 32 THEN '---  ページ 3 ---'
  WHEN 33 THEN 'Introduction' WHEN 34 THEN '② 結果' WHEN 35 THEN '一の二' WHEN 36 THEN 'Section 3.'
  WHEN 37 THEN '２０２３年の記録' WHEN 38 THEN concat(text, '?') ELSE text END"""


PLAIN = 4_000_000  # plain lines follow the dressed ones of a document


def dressed(spark, sf):
    """Every line in its dress, and every line as it is."""
    both = f"inline(array(struct(ord AS ord, {_DRESS} AS text), struct(ord + {PLAIN} AS ord, text AS text)))"
    return X.segments(spark, sf).selectExpr("doc_id", both)


DRESSED = f"""{X.SEGMENTS_SQL}, dressed AS (SELECT doc_id, ord, {_DRESS} AS text FROM segments
  UNION ALL SELECT doc_id, ord + {PLAIN}, text FROM segments)"""


def _run_of(e: str, n: int) -> str:
    """Some character stands ``n`` times in a row (newlines aside)."""
    same = " AND ".join(f"substr({e}, i, 1) = substr({e}, i + {k}, 1)" for k in range(1, n))
    return f"len([i FOR i IN range(1, length({e}) - {n - 2}) IF {same} AND substr({e}, i, 1) <> chr(10)]) > 0"


def d_any(e: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(d_has(e, p) for p in patterns) + ")"


def d_holds(e: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, '{p}')" for p in phrases) + ")"


def d_noise(t: str) -> str:
    """``t`` is free of page tags already."""
    return (
        f"({t} = '' OR length(regexp_replace({t}, '[^〇○●―─—■▲▼・]', '', 'g')) >= 3 OR {_run_of(t, 4)}"
        f" OR {d_has(t, H.NOISE_OPENING)})"
    )


def d_western(e: str) -> str:
    return (
        f"(length(regexp_replace({e}, '[^A-Za-z]', '', 'g')) > "
        rf"length(regexp_replace({e}, '[^\x{{3000}}-\x{{9FFF}}]', '', 'g')))"
    )


def d_numbered(t: str) -> str:
    return (
        f"({d_has(t, H.NUMBERED_TITLE)} AND NOT {d_any(t, H.NUMBERED_TITLE_STOPS)}"
        f" AND NOT {d_holds(t, H.CHAPTER_STOP_PHRASES)})"
    )


def d_major(t: str) -> str:
    return f"({t} <> '' AND NOT {d_has(t, H.SENTENCE_TAIL)} AND ({d_any(t, H.MAJOR_PATTERNS)} OR {d_numbered(t)}))"


def d_title(t: str) -> str:
    minor = ", ".join(f"'{w}'" for w in H.MINOR_WORDS)
    words = (
        rf"list_filter(regexp_split_to_array(regexp_replace({t}, '[''’]s\b', '', 'g'), '[ \t–—-]'), lambda w: w <> '')"
    )
    pairs = f"list_transform({words}, lambda w, i: {{'i': i, 'w': regexp_replace(w, '[^A-Za-z0-9]', '', 'g')}})"
    kept = (
        f"list_filter({pairs}, lambda wd: length(wd.w) > 1 AND NOT regexp_matches(wd.w, '^[0-9]+$') AND"
        f" (wd.i = 1 OR lower(wd.w) NOT IN ({minor})))"
    )
    capped = f"list_filter({kept}, lambda wd: regexp_matches(wd.w, '^[A-Z]|^(?i:anti|connected)'))"
    return (
        f"(length({t}) <= 80 AND NOT regexp_matches({t}, '^[\\[(]') AND NOT regexp_matches({t}, '[,:;]')"
        f" AND len({words}) BETWEEN 2 AND 10 AND len({kept}) >= 1 AND len({capped}) = len({kept}))"
    )


def d_sub(raw: str, t: str, p: str) -> str:
    """``raw`` text, ``t`` trimmed, ``p`` also free of page tags."""
    west = d_western(t)
    enum = d_has(t, H.ENUMERATOR)
    rejected = " OR ".join(
        [
            f"{t} = ''",
            f"regexp_matches({raw}, '^[　 \t]')",
            d_has(t, r"^【(?:注釈文|注)\d+】"),
            d_has(t, r"^\[(?:注釈文|注)?\d+\]"),
            rf"regexp_matches({t}, '^---[{SPACE}]*ページ[{SPACE}]*\p{{Nd}}+[{SPACE}]*---$')",
            f"contains({t}, '。')",
            f"length({t}) > CASE WHEN {west} THEN 120 ELSE 60 END",
            rf"""regexp_matches({t}, '(?:[、,;；！!？?]|\."|!''|\?'')$')""",
            f"(ends_with({t}, '.') AND NOT {d_has(t, H.NUMBER_WITH_DOT)})",
            rf"(regexp_matches({t}, '(?s)^\(.*\)$|^（.*）$|^\[.*\]$|^［.*］$') AND NOT {enum})",
            rf"(regexp_matches({t}, '[」』）)\]］]$') AND NOT regexp_matches({t}, '^[【［\[〔〈《『「]') AND NOT {enum})",
            d_noise(p),
            f"CASE WHEN {west} THEN {d_holds(f'concat(chr(32), lower({t}), chr(32))', H.ENGLISH_STOP_PHRASES)}"
            f" ELSE {d_holds(t, H.JAPANESE_STOP_PHRASES)} END",
        ]
    )
    accepted = (
        f"{d_any(t, H.SUB_PATTERNS)} OR ({d_has(t, H.SUB_NUMBERED)} AND NOT {d_any(t, H.SUB_NUMBERED_STOPS)})"
        f" OR {d_any(t, H.bracket_patterns())} OR ({west} AND {d_title(t)})"
    )
    return f"(NOT ({rejected}) AND ({accepted}))"


def d_number(e: str) -> str:
    return f"CASE WHEN {e} = '十' THEN '10' ELSE translate({e}, '０１２３４５６７８９一二三四五六七八九', '0123456789123456789') END"


def d_key(p: str) -> str:
    """Chapter key of ``p``, free of page tags."""
    cd, kd, ro = H.CHAPTER_DIGITS, H.KANJI_DIGITS, H.ROMAN
    minor = " OR ".join(
        [
            d_sub(p, p, p),
            d_has(p, rf"^第[{cd}]+[節項条回]"),
            d_has(p, rf"(?i)^(?:Section|Sec\.)\s+[0-9{ro}]+"),
            d_has(p, r"^[（(\[【①-⑳❶-❿]"),
            d_has(p, r"^\d+(?:\.\d+)+"),
        ]
    )
    return f"""CASE WHEN {p} = '' OR {d_has(p, H.SENTENCE_TAIL)} THEN NULL
      WHEN regexp_matches({p}, '^第[{cd}]+[章編部]') THEN '第' || {d_number(f"regexp_extract({p}, '^第([{cd}]+)', 1)")}
        || regexp_extract({p}, '^第[{cd}]+([章編部])', 1)
      WHEN regexp_matches({p}, '^(序章|終章|補章|間章|プロローグ|エピローグ)') THEN regexp_extract({p}, '^(序章|終章|補章|間章|プロローグ|エピローグ)', 1)
      WHEN regexp_matches({p}, '(?i)^(?:Chapter|Part|Book|Volume)[{SPACE}]+[0-9{ro}]+') THEN
        'chapter_' || lower(regexp_extract({p}, '(?i)^(?:Chapter|Part|Book|Volume)[{SPACE}]+([0-9{ro}]+)', 1))
      WHEN {d_numbered(p)} THEN 'heading_num_' || {d_number(rf"regexp_extract({p}, '^(?:\p{{Nd}}+|[０-９]+|[{kd}]+)')")}
      WHEN NOT {d_major(p)} AND ({minor}) THEN NULL
      WHEN length({p}) <= 80 THEN {d_norm(p)} END"""


PREPARED = f"{DRESSED}, prepared AS (SELECT *, {d_strip('text')} AS t, {d_prefix('text')} AS p FROM dressed)"


def _simple(name, sql_expr, fn, source=None):
    @query(name, f"WITH {PREPARED} SELECT doc_id, ord, {sql_expr} AS out FROM prepared")
    def _(spark, sf):
        return dressed(spark, sf).select("doc_id", "ord", fn("text").alias("out"))


_simple("normalize_text", d_norm("text"), T.normalize_text)
_simple("strip_page_prefix", "p", T.strip_page_prefix)
_simple("is_noise_heading", d_noise("p"), H.is_noise_heading)
_simple("ends_sentence", d_ends("text"), T.ends_sentence)
_simple("is_major_heading", d_major("p"), H.is_major_heading)
_simple("chapter_key", d_key("p"), H.chapter_key)
_simple("normalize_number", d_number("text"), H.normalize_number)
_simple("is_subheading", d_sub("text", "t", "p"), H.is_subheading)


@query(
    "is_subheading_line",
    f"""WITH {PREPARED} SELECT doc_id, ord, NOT (ord % 2 = 0 AND (ord % 5) * 10.0 >= 24 * 0.75 AND NOT regexp_matches(t, '^[【［\\[]'))
      AND NOT regexp_matches(text, '^[　 \t]') AND {d_sub('t', 't', 'p')} AS out FROM prepared""",
)
def _(spark, sf):
    return dressed(spark, sf).select(
        "doc_id", "ord",
        H.is_subheading_line(
            F.col("text"), F.expr("(ord % 5) * 10.0D"), F.lit(24.0), F.expr("ord % 2 = 1")
        ).alias("out"),
    )


@query(
    "strip_page_divider",
    rf"""SELECT doc_id, {d_strip("array_to_string(list_filter(string_split(concat('--- ページ 1 ---', chr(10), text, chr(10), ' ---ページ2--- '), chr(10)), "
        f"lambda l: NOT regexp_matches({d_strip('l')}, '^---[{SPACE}]*ページ[{SPACE}]*" + chr(92) + "p{Nd}+[" + SPACE + "]*---$')), chr(10))")} AS out FROM documents""",
)
def _(spark, sf):
    wrapped = F.concat(F.lit("--- ページ 1 ---\n"), F.col("text"), F.lit("\n ---ページ2--- "))
    return X.table(spark, sf, "documents").select("doc_id", T.strip_page_divider(wrapped).alias("out"))


def d_join_western(order: str = "ord") -> str:
    return (
        "string_agg(CASE WHEN prev IS NULL OR ends_with(prev, '-') THEN '' ELSE ' ' END || "
        f"CASE WHEN nxt IS NOT NULL AND ends_with(t, '-') THEN left(t, length(t) - 1) ELSE t END, '' ORDER BY {order})"
    )


@query(
    "join_lines",
    f"""WITH {LINES}, h AS (SELECT doc_id, page_no, line_id, {d_strip("CASE WHEN line_id % 3 = 0 THEN text || '-' ELSE text END")} AS t FROM ocr_lines),
    w AS (SELECT *, lag(t) OVER p AS prev, lead(t) OVER p AS nxt FROM h WHERE t <> '' WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_id))
    SELECT doc_id, page_no, {d_join_western('line_id')} AS western FROM w GROUP BY ALL""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf).withColumn(
        "text", F.when(F.col("line_id") % 3 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    )
    arr = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"])
    return lines.groupBy(*PAGE).agg(arr.alias("a")).select(*PAGE, T.join_lines("a", True).alias("western"))


@query(
    "wrap_paragraph",
    """WITH RECURSIVE p AS (SELECT doc_id, replace(replace(text, chr(10), ''), chr(13), '') AS s FROM documents),
    w AS (SELECT doc_id, s, 1 AS i, CASE WHEN substr(s, 32, 1) IN ('?', '!', '。', '、', '）') AND substr(s, 32, 1) <> '' THEN 32 ELSE 31 END AS n FROM p WHERE s <> ''
      UNION ALL SELECT doc_id, s, i + n,
        CASE WHEN substr(s, CAST(i + n + 31 AS BIGINT), 1) IN ('?', '!', '。', '、', '）') THEN 32 ELSE 31 END FROM w WHERE i + n <= length(s))
    SELECT doc_id, string_agg(substr(s, CAST(i AS BIGINT), CAST(n AS BIGINT)), chr(10) ORDER BY i) AS out FROM w GROUP BY doc_id""",
)
def _(spark, sf):
    flat = F.regexp_replace("text", r"[\r\n]", "")
    docs = X.table(spark, sf, "documents").select("doc_id", flat.alias("s")).filter("s <> ''")
    return docs.select("doc_id", T.wrap_paragraph("s", 31).alias("out"))


UNWRAP = f"""lines AS (SELECT doc_id, i, line, {d_strip('line')} AS t, {d_prefix('line')} AS p FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
      WHERE regexp_matches(line, '[^{SPACE}]')),
    titled AS (SELECT *, {d_sub('t', 't', 'p')} AS title FROM lines),
    opened AS (SELECT *, CASE WHEN title OR coalesce(lag(title) OVER w, true) THEN 1 ELSE 0 END AS o FROM titled
               WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    blocks AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS block_no FROM opened),
    near AS (SELECT *, lag(t) OVER w AS prev, lead(t) OVER w AS nxt FROM blocks WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY i)),
    joined AS (SELECT doc_id, block_no, {d_western("string_agg(line, ' ' ORDER BY i)")} AS west, {d_join_western('i')} AS w_text,
      string_agg(CASE WHEN regexp_matches(coalesce(prev, ''), '[A-Za-z0-9]$') AND regexp_matches(t, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || t, '' ORDER BY i) AS j_text,
      bool_or(title) AS title, min(t) AS alone FROM near GROUP BY ALL)"""


@query(
    "unwrap_paragraphs",
    f"""WITH {UNWRAP} SELECT doc_id, CAST(block_no AS INT) AS block_no,
      CASE WHEN title THEN alone WHEN west THEN w_text ELSE j_text END AS text FROM joined""",
)
def _(spark, sf):
    return P.unwrap_paragraphs(X.table(spark, sf, "documents").select("doc_id", "text"), "text")


def flowing(spark, sf):
    return X.ocr_lines(spark, sf).select(*PAGE, "line_id", "text")


@query(
    "merge_flowing",
    f"""WITH {LINES}, q AS (SELECT *, {d_strip('text')} AS t, {d_prefix('text')} AS p, lag(text) OVER w AS last FROM ocr_lines
      WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_id)),
    b AS (SELECT *, CASE WHEN last IS NOT NULL AND NOT {d_ends('last')} AND NOT {d_sub('t', 't', 'p')} THEN 0 ELSE 1 END AS o FROM q)
    SELECT doc_id, page_no, line_id, CAST(sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY line_id) AS BIGINT) AS para_no FROM b""",
)
def _(spark, sf):
    from quire.operators.ordered import span

    out = P.merge_flowing(flowing(spark, sf), PAGE, [F.col("line_id")], span("line_id", 4096))
    return out.select(*PAGE, "line_id", "para_no")

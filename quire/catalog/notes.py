"""Note, heading and blob queries over lines dressed as page items."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import SPACE, d_has, d_norm, d_prefix, d_strip, query
from quire.catalog.text import DRESSED, d_key, d_major, d_noise, d_sub, dressed
from quire.functions import headings as H
from quire.operators import headings as HD
from quire.operators import notes as N
from quire.plans import fixtures as X
from quire.sources import blobs as B

ITEMS = X.ITEMS_SQL

# Footnote lines in all their spellings, one spelling per line number.
_NOTE_DRESS = """CASE CAST(ord % 9 AS INT) WHEN 0 THEN concat(ord % 90 + 1, ') ', text) WHEN 1 THEN concat('【注釈文', ord % 50, '】 ', text)
  WHEN 2 THEN concat(text, '-') WHEN 3 THEN text WHEN 4 THEN concat('[P1-02] [', ord % 30, '] ', text)
  WHEN 5 THEN concat('③', text) WHEN 6 THEN concat('【注7】', text) WHEN 7 THEN concat('本文の続き', text) ELSE concat('【注釈文__NEW__】', text) END"""


def note_lines(spark, sf):
    return X.segments(spark, sf).selectExpr(
        "doc_id", "CAST(ord DIV 30 + 1 AS INT) AS page_no", "CAST(ord AS INT) AS seq", f"{_NOTE_DRESS} AS text"
    )


def d_printed(e: str) -> str:
    pat = r"^(?:([0-9]{1,3})[)）.:]|\[(?:注)?([0-9]{1,3})\]|[(（]([0-9]{1,3})[)）]|([①-⑳㉑-㉟]))"
    digits = " || ".join(f"regexp_extract({e}, '{pat}', {i})" for i in (1, 2, 3))
    ring = f"regexp_extract({e}, '{pat}', 4)"
    return f"""CASE WHEN {digits} <> '' THEN CAST({digits} AS INT)
      WHEN {ring} <> '' THEN CAST(strpos('{N.CIRCLED}', {ring}) AS INT) END"""


_TAG = r"^【(?:注釈文|注)(\p{Nd}+|__NEW__)】"
_PTAG = rf"^\[P\p{{Nd}}+(?:-\p{{Nd}}+)?\][{SPACE}]*"


def d_notes(source: str) -> str:
    """CTEs from ``source(doc_id, page_no, seq, text)`` to ``notes``."""
    return f"""
    n0 AS (SELECT doc_id, page_no, seq, {d_strip(f"regexp_replace({d_strip('text')}, '{_PTAG}', '')")} AS t FROM {source}),
    n1 AS (SELECT *, regexp_extract(t, '{_TAG}', 1) AS tag,
             CASE WHEN regexp_matches(t, '{_TAG}') THEN {d_strip(f"regexp_replace(t, '{_TAG}[{SPACE}]*', '')")} ELSE t END AS b FROM n0 WHERE t <> ''),
    n2 AS (SELECT *, {d_printed('b')} AS pno FROM n1),
    n3 AS (SELECT *, coalesce(pno, CASE WHEN tag NOT IN ('', '__NEW__') THEN CAST(tag AS INT) END) AS no,
             pno IS NULL AND tag = '__NEW__' AS is_new,
             CASE WHEN pno IS NOT NULL OR tag <> '' OR coalesce(lag(b) OVER w, '') = '' THEN 1 ELSE 0 END AS o FROM n2
           WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq)),
    n4 AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS g FROM n3),
    n5 AS (SELECT *, sum(length(regexp_replace(b, '[^A-Za-z]', '', 'g'))) OVER w > sum(length(regexp_replace(b, '[^\\x{{3000}}-\\x{{9FFF}}]', '', 'g'))) OVER w AS west
           FROM n4 WINDOW w AS (PARTITION BY doc_id, page_no, g ORDER BY seq)),
    n6 AS (SELECT *, lag(b) OVER w AS prev, lead(west) OVER w AS nwest FROM n5 WINDOW w AS (PARTITION BY doc_id, page_no, g ORDER BY seq)),
    n7 AS (SELECT doc_id, page_no, g, arg_min(coalesce(no, -1), seq) AS no, arg_min(is_new, seq) AS is_new,
             string_agg(CASE WHEN prev IS NULL THEN '' WHEN west THEN CASE WHEN ends_with(prev, '-') THEN '' ELSE ' ' END
               WHEN regexp_matches(prev, '[A-Za-z0-9]$') AND regexp_matches(b, '^[A-Za-z0-9]') THEN ' ' ELSE '' END ||
               CASE WHEN coalesce(nwest, false) AND ends_with(b, '-') THEN left(b, length(b) - 1) ELSE b END, '' ORDER BY seq) AS m
           FROM n6 GROUP BY ALL),
    notes AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY g) AS note_seq, no, is_new,
             {d_strip(f"regexp_replace({d_strip('m')}, '{_TAG}[{SPACE}]*', '')")} AS body FROM n7 WHERE {d_strip('m')} <> '')"""


NOTE_LINES = f"""{X.SEGMENTS_SQL}, note_lines AS (SELECT doc_id, CAST(ord // 30 + 1 AS INT) AS page_no, CAST(ord AS INT) AS seq,
  {_NOTE_DRESS} AS text FROM segments)"""
_LABEL = "CASE WHEN is_new THEN '__NEW__' WHEN no = -1 THEN CAST({f} AS VARCHAR) ELSE CAST(no AS VARCHAR) END"


@query(
    "merge_footnotes",
    f"""WITH {NOTE_LINES}, {d_notes('note_lines')} SELECT doc_id, page_no, CAST(note_seq AS INT) AS note_seq,
      '【注釈文' || {_LABEL.format(f=5)} || '】 ' || body AS text FROM notes""",
)
def _(spark, sf):
    return N.merge_footnotes(note_lines(spark, sf), start=5)


def d_sorted(src: str) -> str:
    """CTEs that sort the footnotes of ``src``."""
    cb = d_strip(f"regexp_replace({d_strip(f'''regexp_replace(text, '{_PTAG}', '')''')}, '{_TAG}[{SPACE}]*', '')")
    return (
        f"k0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) - 1 AS i, {cb} AS cb FROM {src}),\n"
        f"k1 AS (SELECT *, coalesce({d_printed('cb')}, CAST(nullif(regexp_extract(text, "
        r"'^【(?:注釈文|注)(\p{Nd}+)】', 1), '') AS INT), i) AS k FROM k0)," "\n"
        "sorted AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k, seq) AS seq, text FROM k1)"
    )


@query(
    "sort_footnotes",
    f"WITH {NOTE_LINES}, {d_sorted('note_lines')} SELECT doc_id, page_no, CAST(seq AS INT) AS sort_no, text FROM sorted",
)
def _(spark, sf):
    return N.sort_footnotes(note_lines(spark, sf)).drop("seq")


_FOOT = "foot AS (SELECT doc_id, page_no, seq, text FROM page_items WHERE kind = 'footnote')"
CARRY = r"""lastno AS (SELECT doc_id, page_no, CAST(arg_max(coalesce(nullif(regexp_extract(text, '^【(?:注釈文|注)(\p{Nd}+)】', 1), ''), '-1'), seq) AS INT) AS n
  FROM foot GROUP BY ALL),
carry AS (SELECT doc_id, page_no, coalesce(last_value(CASE WHEN n >= 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS fallback_no FROM lastno)"""


@query("carry_note_number", f"WITH {ITEMS}, {_FOOT}, {CARRY} SELECT * FROM carry")
def _(spark, sf):
    return N.carry_note_number(X.page_items(spark, sf).filter("kind = 'footnote'"))


_ANY = r"【(?:注釈文|注)(?:\p{Nd}+|__NEW__)】"
_COUNT = f"len(regexp_extract_all(text, '{_ANY}'))"


def d_renumber(runs: str) -> str:
    def tagged(src: str, label: str) -> str:
        split = f"regexp_split_to_array(text, '{_ANY}')"
        return f"""(SELECT doc_id, page_no, kind, seq, list_reduce(list_transform({split}, lambda p, i: CASE WHEN i = 1 THEN p ELSE
            '【{label}' || (off + i - 1) || '】' || p END), lambda a, b: a || b) AS text FROM {src})"""

    off = "coalesce(sum({c}) OVER (PARTITION BY doc_id, run ORDER BY page_no, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off"
    return f"""WITH {ITEMS}, {_FOOT}, {d_sorted('foot')}, {d_notes('sorted')}, {runs},
    fn AS (SELECT doc_id, page_no, 'footnote' AS kind, note_seq AS seq, '【注釈文' || {_LABEL.format(f=1)} || '】 ' || body AS text FROM notes),
    fo AS (SELECT fn.*, {off.format(c=_COUNT)} FROM fn JOIN runs USING (doc_id, page_no)),
    bo AS (SELECT p.*, {off.format(c=_COUNT)} FROM page_items p JOIN runs USING (doc_id, page_no) WHERE kind = 'body')
    SELECT doc_id, page_no, kind, CAST(seq AS INT) AS seq, text FROM (
      SELECT * FROM {tagged('bo', '注')} UNION ALL SELECT * FROM {tagged('fo', '注釈文')}
      UNION ALL SELECT doc_id, page_no, kind, seq, text FROM page_items WHERE kind = 'heading')"""


@query(
    "renumber_notes",
    d_renumber("runs AS (SELECT DISTINCT doc_id, page_no, 0 AS run FROM page_items)"),
)
def _(spark, sf):
    return N.renumber_notes(X.page_items(spark, sf))


@query(
    "renumber_notes_by_chapter",
    d_renumber(
        f"""hk AS (SELECT doc_id, page_no, seq, {d_key('p')} AS key FROM (SELECT *, {d_prefix('text')} AS p FROM page_items WHERE kind = 'heading')),
        pk AS (SELECT DISTINCT i.doc_id, i.page_no, k.key FROM page_items i LEFT JOIN (SELECT doc_id, page_no, arg_min(key, seq) AS key FROM hk
               WHERE key IS NOT NULL GROUP BY ALL) k USING (doc_id, page_no)),
        pw AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM pk),
        runs AS (SELECT doc_id, page_no, sum(CASE WHEN key IS NOT NULL AND key IS DISTINCT FROM was THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM pw)"""
    ),
)
def _(spark, sf):
    return N.renumber_notes(X.page_items(spark, sf), scope="majorHeading")


def _nums(where: str, pattern: str) -> str:
    return f"SELECT doc_id, page_no, seq, CAST(unnest(regexp_extract_all(text, '{pattern}', 1)) AS INT) AS no FROM page_items WHERE {where}"


_MARK, _NOTE, _BOTH = (r"【注(\p{Nd}+)】", r"【注釈文(\p{Nd}+)】", r"【(?:注釈文|注)(\p{Nd}+)】")


@query(
    "next_note_number",
    f"""WITH {ITEMS}, m AS ({_nums("kind = 'body'", _MARK)}), f AS ({_nums("kind = 'footnote'", _BOTH)} UNION ALL {_nums("kind = 'body'", _NOTE)}),
    pg AS (SELECT DISTINCT doc_id, page_no FROM page_items WHERE kind IN ('body', 'footnote'))
    SELECT 'marker' AS kind, doc_id, page_no, coalesce(max(no), 0) + 1 AS next_no FROM pg LEFT JOIN m USING (doc_id, page_no) GROUP BY ALL
    UNION ALL SELECT 'footnote', doc_id, page_no, coalesce(max(no), 0) + 1 FROM pg LEFT JOIN f USING (doc_id, page_no) GROUP BY ALL""",
)
def _(spark, sf):
    items = X.page_items(spark, sf)
    body, foot = items.filter("kind = 'body'"), items.filter("kind = 'footnote'")
    parts = [N.next_note_number(body, foot, k).select(F.lit(k).alias("kind"), *PAGE, "next_no") for k in ("marker", "footnote")]
    return parts[0].unionByName(parts[1])


@query(
    "unlinked_notes",
    f"""WITH {ITEMS}, m AS (SELECT doc_id, page_no, seq, CAST(x AS INT) AS no, i FROM (SELECT doc_id, page_no, seq,
          unnest(regexp_extract_all(text, '{_MARK}', 1)) AS x, unnest(range(len(regexp_extract_all(text, '{_MARK}', 1)))) AS i
          FROM page_items WHERE kind = 'body')),
    f AS ({_nums("kind = 'footnote'", _BOTH)} UNION ALL {_nums("kind = 'body'", _NOTE)})
    SELECT doc_id, page_no, arg_min(no, seq * 1000 + i) AS note_no FROM m ANTI JOIN f USING (doc_id, page_no, no) GROUP BY ALL""",
)
def _(spark, sf):
    items = X.page_items(spark, sf)
    return N.unlinked_notes(items.filter("kind = 'body'"), items.filter("kind = 'footnote'"))


# --- blobs -----------------------------------------------------------------------------

_BLOB = "concat('[P', 3, '-01] ', replace(text, chr(10), concat(chr(10), '[P', doc_id % 5 + 1, '] ', chr(10))))"


def tagged_blobs(spark, sf):
    """Documents as tagged blobs: every other line carries a page tag only."""
    return X.table(spark, sf, "documents").select("doc_id", F.expr(_BLOB).alias("blob"))


BLOBS = rf"""bl AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(b, chr(10))) AS line,
      unnest(range(len(string_split(b, chr(10))))) AS i FROM (SELECT doc_id, {_BLOB} AS b FROM documents)) WHERE line <> ''),
  bt AS (SELECT *, regexp_extract(line, '^\[P(\p{{Nd}}+)(?:-\p{{Nd}}+)?\]', 1) AS pg,
      regexp_replace(line, '^\[P\p{{Nd}}+(?:-\p{{Nd}}+)?\][{SPACE}]*', '') AS raw FROM {{src}}),
  bp AS (SELECT doc_id, i AS seq, CAST(coalesce(last_value(nullif(pg, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '1') AS INT) AS page_no,
      raw, {d_strip('raw')} AS text, pg <> '' AS tagged FROM bt)"""


def d_blobs(src: str = "bl") -> str:
    return BLOBS.replace("{src}", src)


@query(
    "parse_items",
    f"WITH {d_blobs()} SELECT doc_id, page_no, CAST(seq AS INT) AS seq, text FROM bp WHERE NOT tagged OR text <> ''",
)
def _(spark, sf):
    return B.parse_items(tagged_blobs(spark, sf), "blob")


@query(
    "parse_footnotes",
    f"""WITH {d_blobs(f"(SELECT doc_id, i, {d_strip('line')} AS line FROM bl WHERE {d_strip('line')} <> '')")},
    bq AS (SELECT doc_id, page_no, seq, text FROM bp WHERE text <> ''), {d_notes('bq')},
    la AS (SELECT doc_id, page_no, arg_max(no, note_seq) AS n FROM notes GROUP BY ALL),
    ca AS (SELECT doc_id, page_no, coalesce(last_value(CASE WHEN n >= 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS fb FROM la)
    SELECT doc_id, page_no, CAST(note_seq AS INT) AS note_seq, '【注釈文' || {_LABEL.format(f='fb')} || '】 ' || body AS text
    FROM notes JOIN ca USING (doc_id, page_no)""",
)
def _(spark, sf):
    return N.parse_footnotes(tagged_blobs(spark, sf), "blob")


_HBLOB = """concat('[P2-01] ', replace(replace(text, '. ', concat(chr(10), '    ')), '。', chr(10)))"""


@query(
    "parse_headings_with_levels",
    f"""WITH {d_blobs().replace(_BLOB, _HBLOB)}, q AS (SELECT *, {d_prefix('text')} AS p FROM bp),
    k AS (SELECT * FROM q WHERE p <> '' AND length(p) <= 80 AND NOT contains(p, '。') AND NOT {d_has('p', r'^【(?:注釈文|注)\d+】')} AND NOT {d_noise('p')})
    SELECT doc_id, page_no, CAST(seq AS INT) AS seq, CASE WHEN (regexp_matches(raw, '^(?:　|\t|  )')
        OR {d_has('p', rf'^第[{H.CHAPTER_DIGITS}]+[節項条回]')} OR {d_has('p', rf'(?i)^(?:Section|Sec\.)\s+[0-9{H.ROMAN}]+')} OR {d_sub('p', 'p', 'p')})
        AND NOT {d_major('p')} THEN 'subheading' ELSE 'heading' END AS kind, p AS text FROM k""",
)
def _(spark, sf):
    blobs = X.table(spark, sf, "documents").select("doc_id", F.expr(_HBLOB).alias("blob"))
    return B.parse_headings_with_levels(blobs, "blob")


_PBLOB = "replace(text, chr(10), concat(chr(10), '--- ページ ', doc_id % 4 + 2, ' ---', chr(10), 'x', chr(10), chr(10)))"


@query(
    "parse_body_text",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, unnest(range(len(string_split(b, chr(10))))) AS i
        FROM (SELECT doc_id, replace({_PBLOB}, chr(13), '') AS b FROM documents)),
    t AS (SELECT *, regexp_extract({d_strip('line')}, '^---[{SPACE}]*ページ[{SPACE}]*(\p{{Nd}}+)[{SPACE}]*---$', 1) AS pg FROM l),
    c AS (SELECT *, last_value(nullif(pg, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS above,
            min(CAST(nullif(pg, '') AS INT)) OVER (PARTITION BY doc_id) AS low FROM t),
    p AS (SELECT doc_id, i, line, coalesce(CAST(above AS INT), low, 1) AS page_no FROM c WHERE pg = ''),
    g AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY i) AS para FROM p)
    SELECT * FROM (SELECT doc_id, page_no, CAST(min(i) AS INT) AS seq, {d_strip("string_agg(line, chr(10) ORDER BY i)")} AS text FROM g
      WHERE line <> '' GROUP BY doc_id, page_no, para) WHERE text <> ''""",
)
def _(spark, sf):
    blobs = X.table(spark, sf, "documents").select("doc_id", F.expr(f"replace({_PBLOB}, chr(13), '')").alias("blob"))
    return B.parse_body_text(blobs, "blob")


# --- headings ----------------------------------------------------------------------------

def heading_items(spark, sf):
    """Dressed lines as headings and subheadings; every eleventh a removed heading; repeats in
    other case."""
    base = dressed(spark, sf).selectExpr(
        "doc_id", "CAST(ord DIV 30 + 1 AS INT) AS page_no", "CAST(ord AS INT) AS seq",
        "CASE WHEN ord % 11 = 5 THEN 'removed' WHEN ord % 3 = 1 THEN 'subheading' ELSE 'heading' END AS kind", "text",
    )
    # One pass over the lines: an item, and what repeats of it there are.
    again = "struct(seq + 1000000 AS seq, upper(replace(text, 'ß', 'ss')) AS text)"
    short = "struct(seq + 2000000 AS seq, substring(text, 1, 6) AS text)"
    return base.selectExpr(
        "doc_id", "page_no", "kind",
        f"""inline(filter(array(struct(seq, text), CASE WHEN seq % 4 = 0 THEN {again} END,
              CASE WHEN seq % 5 = 0 THEN {short} END), i -> i IS NOT NULL))""",
    ).select("doc_id", "page_no", "seq", "kind", "text")


HITEMS = f"""{DRESSED}, hb AS (SELECT doc_id, CAST(ord // 30 + 1 AS INT) AS page_no, CAST(ord AS INT) AS seq,
    CASE WHEN ord % 11 = 5 THEN 'removed' WHEN ord % 3 = 1 THEN 'subheading' ELSE 'heading' END AS kind, text FROM dressed),
  items AS (SELECT * FROM hb UNION ALL SELECT doc_id, page_no, seq + 1000000, kind, upper(replace(text, 'ß', 'ss')) FROM hb WHERE seq % 4 = 0
    UNION ALL SELECT doc_id, page_no, seq + 2000000, kind, substring(text, 1, 6) FROM hb WHERE seq % 5 = 0)"""


@query(
    "distinct_ci",
    f"""WITH {HITEMS} SELECT doc_id, page_no, kind, seq, text FROM (SELECT *, row_number() OVER (
      PARTITION BY doc_id, page_no, kind, lower(text) ORDER BY seq) AS rn FROM items) WHERE rn = 1""",
)
def _(spark, sf):
    return HD.distinct_ci(heading_items(spark, sf)).select(*PAGE, "kind", "seq", "text")


@query(
    "drop_prefix_fragments",
    f"""WITH {HITEMS} SELECT doc_id, page_no, kind, seq, text FROM items a WHERE NOT EXISTS (SELECT 1 FROM items b WHERE b.doc_id = a.doc_id
      AND b.page_no = a.page_no AND b.kind = a.kind AND length(b.text) > length(a.text) AND starts_with(lower(b.text), lower(a.text)))""",
)
def _(spark, sf):
    return HD.drop_prefix_fragments(heading_items(spark, sf)).select(*PAGE, "kind", "seq", "text")


D_CLEAN = f"""ch0 AS (SELECT *, {d_prefix('text')} AS p FROM items),
  ch1 AS (SELECT doc_id, page_no, kind, seq, p AS text FROM ch0 WHERE kind <> 'removed' AND p <> '' AND length(p) <= 80 AND NOT contains(p, '。')
    AND NOT {d_has('p', r'^【(?:注釈文|注)\d+】')} AND NOT (kind = 'heading' AND EXISTS (SELECT 1 FROM ch0 r WHERE r.kind = 'removed' AND r.doc_id = ch0.doc_id
      AND r.page_no = ch0.page_no AND lower(r.p) = lower(ch0.p)))),
  ch2 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, kind, lower(text) ORDER BY seq) AS rn FROM ch1) WHERE rn = 1),
  cleaned AS (SELECT * FROM ch2 a WHERE NOT EXISTS (SELECT 1 FROM ch2 b WHERE b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.kind = a.kind
      AND length(b.text) > length(a.text) AND starts_with(lower(b.text), lower(a.text))))"""


@query("clean_headings", f"WITH {HITEMS}, {D_CLEAN} SELECT doc_id, page_no, kind, seq, text FROM cleaned")
def _(spark, sf):
    return HD.clean_headings(heading_items(spark, sf)).select(*PAGE, "kind", "seq", "text")


@query(
    "reclassify_headings",
    f"""WITH {HITEMS}, {D_CLEAN}, m AS (SELECT *, kind = 'heading' AND {d_sub('text', 'text', 'text')} AND NOT {d_major('text')} AS mv FROM cleaned),
    k AS (SELECT doc_id, page_no, CASE WHEN mv THEN 'subheading' ELSE kind END AS kind, CASE WHEN mv THEN seq + 1073741824 ELSE seq END AS seq, text FROM m)
    SELECT doc_id, page_no, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, kind, lower(text) ORDER BY seq) AS rn FROM k)
    WHERE rn = 1 OR kind = 'heading'""",
)
def _(spark, sf):
    cleaned = HD.clean_headings(heading_items(spark, sf))
    return HD.reclassify_headings(cleaned).select(*PAGE, "kind", "text")


@query(
    "filter_tagged_headings",
    f"""WITH {HITEMS}, q AS (SELECT *, {d_prefix('text')} AS p, regexp_extract(text, '^\\[P(\\p{{Nd}}+)(?:-\\p{{Nd}}+)?\\]', 1) AS tg FROM items WHERE kind = 'heading')
    SELECT doc_id, page_no, seq, p AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, lower(p) ORDER BY seq) AS rn FROM q
      WHERE p <> '' AND (tg = '' OR CAST(tg AS INT) = page_no)) WHERE rn = 1""",
)
def _(spark, sf):
    out = HD.filter_tagged_headings(heading_items(spark, sf).filter("kind = 'heading'"))
    return out.select(*PAGE, "seq", "text")


_SAFE = rf"^(?:序章|終章|第[{H.CHAPTER_DIGITS}]+[章節編部])"


@query(
    "drop_removed_headings",
    f"""WITH {HITEMS}, h AS (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind <> 'removed')
    SELECT doc_id, page_no, kind, seq FROM h WHERE p <> '' AND (regexp_matches(p, '{_SAFE}') OR NOT EXISTS (
      SELECT 1 FROM items r WHERE r.kind = 'removed' AND r.doc_id = h.doc_id AND r.page_no = h.page_no AND regexp_matches(r.text, '[^{SPACE}]')
      AND (contains(lower(h.p), lower(r.text)) OR contains(lower(r.text), lower(h.p)) OR ({d_norm('h.p')} <> '' AND {d_norm('h.p')} = {d_norm('r.text')}))))""",
)
def _(spark, sf):
    items = heading_items(spark, sf)
    out = HD.drop_removed_headings(items.filter("kind <> 'removed'"), items.filter("kind = 'removed'"))
    return out.select(*PAGE, "kind", "seq")


KEYED = f"hk AS (SELECT *, lower({d_key('p')}) AS key FROM (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind = 'heading'))"


@query(
    "drop_running_headers_carried",
    f"""WITH {HITEMS}, {KEYED}, w AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM hk)
    SELECT doc_id, page_no, seq, text FROM w WHERE key IS NULL OR key IS DISTINCT FROM was""",
)
def _(spark, sf):
    out = HD.drop_running_headers(heading_items(spark, sf).filter("kind = 'heading'"))
    return out.select(*PAGE, "seq", "text")


@query(
    "drop_running_headers_seen",
    f"""WITH {HITEMS}, {KEYED} SELECT doc_id, page_no, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page_no, seq) AS rn FROM hk)
    WHERE key IS NULL OR rn = 1""",
)
def _(spark, sf):
    out = HD.drop_running_headers(heading_items(spark, sf).filter("kind = 'heading'"), mode="seen")
    return out.select(*PAGE, "seq", "text")


@query(
    "first_occurrence",
    f"""WITH {HITEMS}, q AS (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind = 'heading'), r AS (SELECT *, {d_norm('p')} AS n FROM q)
    SELECT doc_id, page_no, seq, p AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY page_no, seq) AS rn FROM r WHERE n <> '')
    WHERE rn = 1""",
)
def _(spark, sf):
    return HD.first_occurrence(heading_items(spark, sf).filter("kind = 'heading'")).select(*PAGE, "seq", "text")


def bodies(spark, sf):
    """Body lines: every heading line of an even number stands in the body as well."""
    items = X.page_items(spark, sf).filter("kind = 'body'").select(*PAGE, "seq", "text")
    titles = heading_items(spark, sf).filter("seq % 2 = 0").select(
        *PAGE, "seq", F.expr("concat(text, chr(10), ' second line ')").alias("text")
    )
    return items.unionByName(titles)


BODIES = f"""{HITEMS}, pi AS (SELECT doc_id, CAST(ord // 30 + 1 AS INT) AS page_no, CAST(ord AS INT) AS seq, {X._ITEM_KIND} AS kind, {X._ITEM_TEXT['duck']} AS text
    FROM (SELECT *, CAST(ord // 30 + 1 AS INT) AS page_no FROM segments)),
  bodies AS (SELECT doc_id, page_no, seq, text FROM pi WHERE kind = 'body' UNION ALL
    SELECT doc_id, page_no, seq, concat(text, chr(10), ' second line ') FROM items WHERE seq % 2 = 0),
  blines AS (SELECT doc_id, page_no, seq, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM bodies)"""


@query(
    "standalone_headings",
    f"""WITH {BODIES}, q AS (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind = 'heading'), r AS (SELECT *, {d_norm('p')} AS n FROM q)
    SELECT doc_id, page_no, seq, p AS text FROM r WHERE n <> '' AND NOT EXISTS (SELECT 1 FROM blines b WHERE b.doc_id = r.doc_id
      AND b.page_no = r.page_no AND {d_norm('b.line')} = r.n)""",
)
def _(spark, sf):
    headings = heading_items(spark, sf).filter("kind = 'heading'")
    return HD.standalone_headings(headings, bodies(spark, sf)).select(*PAGE, "seq", "text")


@query(
    "mark_heading_lines",
    f"""WITH {BODIES}, hp AS (SELECT DISTINCT doc_id, page_no, CASE WHEN {d_norm('p')} <> '' THEN 'n' || {d_norm('p')} ELSE 'u' || lower(p) END AS k
      FROM (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind <> 'removed' AND seq % 3 = 0 AND regexp_matches(text, '[^{SPACE}]'))),
    l AS (SELECT doc_id, page_no, seq, {d_strip('line')} AS t FROM blines WHERE line <> '')
    SELECT doc_id, page_no, seq, t AS text, length(t) <= 80 AND NOT contains(t, '。') AND NOT {d_has('t', r'^【(?:注釈文|注)\d+】')}
      AND hp.k IS NOT NULL AS is_heading FROM (SELECT *, CASE WHEN {d_norm('t')} <> '' THEN 'n' || {d_norm('t')} ELSE 'u' || lower(t) END AS k FROM l) l
    LEFT JOIN hp USING (doc_id, page_no, k)""",
)
def _(spark, sf):
    from quire.functions.text import strip

    lines = HD.body_lines(bodies(spark, sf)).withColumn("text", strip("text"))
    headings = heading_items(spark, sf).filter("kind <> 'removed' AND seq % 3 = 0")
    return HD.mark_heading_lines(lines, headings).select(*PAGE, "seq", "text", "is_heading")


@query(
    "update_removed",
    f"""WITH {HITEMS}, o AS (SELECT *, {d_prefix('text')} AS p FROM items WHERE kind = 'heading'),
    nw AS (SELECT doc_id, page_no, text FROM items WHERE kind = 'heading' AND seq % 5 <> 0 AND page_no % 4 <> 0),
    rm AS (SELECT doc_id, page_no, text FROM items WHERE kind = 'removed'),
    kept AS (SELECT * FROM rm WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.doc_id = rm.doc_id AND nw.page_no = rm.page_no
      AND (lower(nw.text) = lower(rm.text) OR {d_norm('nw.text')} = {d_norm('rm.text')}))),
    gone AS (SELECT doc_id, page_no, seq, p FROM o WHERE EXISTS (SELECT 1 FROM nw WHERE nw.doc_id = o.doc_id AND nw.page_no = o.page_no)
      AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.doc_id = o.doc_id AND nw.page_no = o.page_no AND lower(nw.text) = lower(o.p))
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = o.doc_id AND k.page_no = o.page_no AND lower(k.text) = lower(o.p)))
    SELECT doc_id, page_no, text FROM kept UNION ALL SELECT doc_id, page_no, p FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, lower(p) ORDER BY seq) AS rn FROM gone) WHERE rn = 1""",
)
def _(spark, sf):
    items = heading_items(spark, sf)
    old = items.filter("kind = 'heading'")
    new = old.filter("seq % 5 <> 0 AND page_no % 4 <> 0")
    return HD.update_removed(old, new, items.filter("kind = 'removed'"))


@query(
    "merge_removed",
    f"""WITH {HITEMS}, b AS (SELECT doc_id, page_no, text, 0 AS s FROM items WHERE kind = 'removed' AND seq < 1000000
      UNION ALL SELECT doc_id, page_no, text, 1 FROM items WHERE kind = 'removed' AND seq >= 1000000)
    SELECT doc_id, page_no, lower(text) AS text FROM b GROUP BY doc_id, page_no, lower(text)""",
)
def _(spark, sf):
    removed = heading_items(spark, sf).filter("kind = 'removed'")
    out = HD.merge_removed(removed.filter("seq < 1000000"), removed.filter("seq >= 1000000"))
    return out.select(*PAGE, F.lower("text").alias("text"))


@query("sync_headings")
def _(spark, sf):
    body = X.page_items(spark, sf).filter("kind = 'body'")
    items = heading_items(spark, sf).unionByName(body.select(*PAGE, "seq", "kind", "text"))
    return HD.sync_headings(items, auto_detect=True)

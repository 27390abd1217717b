"""Rule, search, document and progress queries."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import SPACE, d_has, d_norm, d_prefix, d_strip, query
from quire.catalog.lines import LINES
from quire.catalog.notes import HITEMS, bodies, heading_items
from quire.catalog.reading import d_ends
from quire.catalog.tables import BOOK, book_rows, ruled_tables
from quire.catalog.text import d_sub, d_western
from quire.operators import documents as D
from quire.operators import page_breaks as B
from quire.operators import rules as R
from quire.operators import search as S
from quire.plans import document as P
from quire.plans import fixtures as X

ITEMS = X.ITEMS_SQL


def rule_table(spark, sf):
    """A small dictionary; its order and switches come with the rules."""
    rows = [
        ("the ", "THE ", False, True, 0, False),
        ("ation", "ATION", False, True, 1, True),
        ("tion", "TION", False, True, 2, False),
        ("[0-9]{2,}", "#", True, True, 3, False),
        ("en", "EN", False, False, 4, False),
        ("([", "x", True, True, 5, False),
        ("#", "No.", False, True, 6, False),
    ]
    schema = "original string, replacement string, is_regex boolean, enabled boolean, ord int, builtin boolean"
    return spark.createDataFrame(rows, schema)


def _rule_query(name, order, sql):
    @query(name, f"WITH {LINES} SELECT doc_id, page_no, line_id, {sql} AS text FROM ocr_lines")
    def _(spark, sf):
        out = R.apply_rules(X.ocr_lines(spark, sf), rule_table(spark, sf), "text", order=order)
        return out.select(*PAGE, "line_id", "text")


_LONG = "replace(replace(replace(replace({t}, 'ation', 'ATION'), 'the ', 'THE '), 'tion', 'TION'), '#', 'No.')"
_rule_query(
    "apply_rules_longest_first", "longest_first",
    f"regexp_replace({_LONG.format(t='text')}, '[0-9]{{2,}}', '#', 'g')",
)
_rule_query(
    "apply_rules_insertion", "insertion",
    "regexp_replace(replace(replace(replace(replace(text, 'the ', 'THE '), 'ation', 'ATION'), 'tion', 'TION'), '#', 'No.'), '[0-9]{2,}', '#', 'g')",
)
_rule_query(
    "apply_rules_engine", "engine",
    _LONG.format(t=f"regexp_replace({_LONG.format(t='text')}, '[0-9]{{2,}}', '#', 'g')"),
)


@query(
    "proofread_candidates",
    f"""WITH {LINES}, r AS (SELECT * FROM (VALUES ('the ', 'THE ', 1), ('ation', 'ATION', 0), ('tion', 'TION', 2), ('#', 'No.', 3)) AS v(o, s, k)),
    e AS (SELECT doc_id, page_no, line_id, text, o, s, 'rule' AS kd, unnest([i FOR i IN range(1, length(text) + 1) IF substr(text, i, length(o)) = o]) AS i
          FROM ocr_lines, r WHERE contains(text, o)),
    x0 AS (SELECT doc_id, page_no, line_id, text, unnest([i FOR i IN range(1, length(text) + 1) IF regexp_matches(substr(text, i, 2), '^[0-9]{{2}}$')
          AND NOT regexp_matches(substr(text, i - 1, 1), '[0-9]')]) AS i FROM ocr_lines),
    x AS (SELECT doc_id, page_no, line_id, text, regexp_extract(substr(text, i), '^[0-9]+') AS o, '#' AS s, 'regex' AS kd, i FROM x0),
    c AS (SELECT * FROM e UNION ALL SELECT * FROM x)
    SELECT doc_id, page_no, line_id, 'cand_' || kd || '_' || (i - 1) || '_' || (i - 1 + length(o)) AS id, o AS original, s AS suggested,
      CASE kd WHEN 'rule' THEN '{R.REASON_EXACT}' ELSE '{R.REASON_REGEX}' END AS reason, 'rule' AS engine,
      CAST(i - 1 AS INT) AS start_idx, CAST(i - 1 + length(o) AS INT) AS end_idx,
      substr(text, CAST(greatest(1, i - 30) AS BIGINT), CAST(least(30, i - 1) AS BIGINT)) AS context_before, substr(text, CAST(i + length(o) AS BIGINT), 30) AS context_after, 'pending' AS status
    FROM c""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf).select(*PAGE, "line_id", "text")
    return R.proofread_candidates(lines, rule_table(spark, sf))


_CHARS = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"


@query(
    "charset_coverage",
    f"""WITH {LINES} SELECT doc_id, page_no, line_id, length(regexp_replace(text, '[a-zA-Z .,]', '', 'g')) AS outside, length(text) AS total FROM ocr_lines""",
)
def _(spark, sf):
    out = R.charset_coverage(X.ocr_lines(spark, sf), "text", _CHARS)
    return out.select(*PAGE, "line_id", "outside", "total")


# --- search ----------------------------------------------------------------------------

def table_rows(spark, sf):
    return book_rows(spark, sf)


def _hits_sql(match: str, lines: str = "1 = 1") -> str:
    return f"""WITH {ITEMS}, {BOOK},
    b AS (SELECT doc_id, page_no, 'body' AS kind, seq, text AS t, {d_strip('text')} AS snippet, 0 AS line_index FROM page_items WHERE kind = 'body'),
    o AS (SELECT doc_id, page_no, kind, seq, {d_prefix('text')} AS t, {d_prefix('text')} AS snippet,
            CAST(row_number() OVER (PARTITION BY doc_id, page_no, kind ORDER BY seq) - 1 AS INT) AS line_index FROM page_items WHERE kind <> 'body'),
    tb AS (SELECT doc_id, page_no, 'table' AS kind, row_index AS seq, array_to_string([coalesce(c, '') FOR c IN cells], ' | ') AS t,
            '[' || table_name || '] ' || array_to_string([coalesce(c, '') FOR c IN cells], ' | ') AS snippet, 0 AS line_index FROM book),
    al AS (SELECT * FROM b UNION ALL SELECT * FROM o UNION ALL SELECT * FROM tb),
    hits AS (SELECT doc_id, page_no, kind, CAST(seq AS INT) AS seq, {match} AS matched_text, snippet, line_index FROM al WHERE {lines})"""


@query(
    "search_pages",
    _hits_sql("substr(t, strpos(lower(t), 'ver'), 3)", "contains(lower(t), 'ver')") + " SELECT * FROM hits",
)
def _(spark, sf):
    out = S.search_pages(X.page_items(spark, sf), table_rows(spark, sf), "VER")
    return out.drop("kind_rank")


@query(
    "search_pages_regex",
    _hits_sql("regexp_extract(t, '[0-9]{3}[a-z1-5 ]', 0)", "regexp_matches(t, '[0-9]{3}[a-z1-5 ]') AND page_no BETWEEN 1 AND 3")
    + " SELECT * FROM hits",
)
def _(spark, sf):
    out = S.search_pages(
        X.page_items(spark, sf), table_rows(spark, sf), "[0-9]{3}[a-z1-5 ]", regex=True, match_case=True, pages=(1, 3)
    )
    return out.drop("kind_rank")


@query(
    "search_summary",
    _hits_sql("t", "contains(lower(t), 'ver')") + " SELECT count(*) AS hits, count(DISTINCT (doc_id, page_no)) AS pages FROM hits",
)
def _(spark, sf):
    return S.search_summary(S.search_pages(X.page_items(spark, sf), table_rows(spark, sf), "ver"))


@query(
    "order_hits",
    _hits_sql("t", "contains(lower(t), 'ver')") + " SELECT doc_id, page_no, kind, seq FROM hits",
)
def _(spark, sf):
    hits = S.search_pages(X.page_items(spark, sf), table_rows(spark, sf), "ver")
    return S.order_hits(hits).select(*PAGE, "kind", "seq")


# --- documents -------------------------------------------------------------------------

@query(
    "number_tables_figures",
    f"""WITH {ITEMS}, t AS (SELECT 'table' AS kind, doc_id, page_no, seq FROM page_items WHERE kind = 'footnote'
      UNION ALL SELECT 'figure', doc_id, page_no, seq FROM page_items WHERE kind = 'heading'),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY page_no, seq) AS INT) AS number FROM t)
    SELECT *, CASE kind WHEN 'table' THEN '表' ELSE '図' END || number AS name FROM n""",
)
def _(spark, sf):
    items = X.page_items(spark, sf)
    return D.number_tables_figures(items.filter("kind = 'footnote'"), items.filter("kind = 'heading'"))


def page_data(spark, sf):
    """Wide pages of heading and body arrays."""
    items = X.page_items(spark, sf)

    def texts(kind):
        s = F.struct("seq", "text")
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, s))), lambda x: x["text"])

    return items.groupBy(*PAGE).agg(texts("heading").alias("headings"), texts("body").alias("body"), texts("footnote").alias("footnotes"))


@query(
    "overlay_pages",
    f"""WITH {ITEMS}, w AS (SELECT doc_id, page_no, count(*) FILTER (kind = 'body') AS nb, coalesce(string_agg(text, '|' ORDER BY seq) FILTER (kind = 'body'), '') AS body
      FROM page_items GROUP BY ALL),
    k AS (SELECT *, page_no % 4 AS m FROM w)
    SELECT doc_id, page_no, CASE m WHEN 3 THEN 'edited' WHEN 2 THEN 'memory' ELSE body END AS body,
      CASE WHEN m = 3 THEN 'New' WHEN m = 2 THEN 'Kept' ELSE 'x' END AS headings FROM k WHERE m <> 0""",
)
def _(spark, sf):
    base = page_data(spark, sf).withColumn("headings", F.array(F.lit("[P1] x"), F.lit("X"), F.lit("長い。")))
    disk = base.filter("page_no % 4 IN (1, 2)")
    memory = base.filter("page_no % 4 = 2").withColumns({"body": F.array(F.lit("memory")), "headings": F.array(F.lit("Kept"))})
    edits = base.filter("page_no % 4 IN (0, 1, 3)").selectExpr(
        "doc_id", "page_no", "CASE WHEN page_no % 4 = 3 THEN array('edited') ELSE array() END AS body",
        "CASE WHEN page_no % 4 = 3 THEN array('[P9-01] New', 'new', '【注1】 z') ELSE array() END AS headings",
    )
    out = D.overlay_pages(disk, memory, edits)
    return out.select(*PAGE, F.array_join("body", "|").alias("body"), F.array_join("headings", "|").alias("headings"))


def _d_runs_on(a: str, b: str, raw: str, first: str) -> str:
    """``b`` is a trimmed one-line paragraph, ``a`` a trimmed text and ``{a}_l`` its last line."""
    barred = " OR ".join(
        [
            f"{a} = ''", f"{b} = ''", d_sub(b, b, f"{b}_p"), f"CASE WHEN length({a}) > 120 THEN false ELSE {d_sub(a, a, f'{a}_p')} END", d_sub(f"{a}_l", f"{a}_l", f"{a}_lp"),
            rf"regexp_matches({b}, '^(?:[-*・■◆▲●○▶※][{SPACE}]+|\p{{Nd}}+[.)]|\(\p{{Nd}}+\)|[①-⑳])')",
            rf"""(regexp_matches({b}, '^[「『“"（【［\[]') AND NOT regexp_matches({a}, '[“"「『]$'))""",
            f"regexp_matches({a}, '[:：]$')",
        ]
    )
    latin = rf"""(ends_with({a}, '-') OR regexp_matches({b}, '^\p{{Ll}}') OR regexp_matches({b}, '^[,;)\]]') OR NOT regexp_matches({a}, '[.!?]["'')]*$'))"""
    japanese = f"(regexp_matches({b}, '{B.JAPANESE_RUN_ON}') OR regexp_matches({a}, '[、,・―—…]$') OR (NOT regexp_matches({first}, '^　') AND NOT {d_ends(a)}))"
    return f"(NOT ({barred}) AND CASE WHEN {d_western(raw)} OR {d_western(first)} THEN {latin} ELSE {japanese} END)"


def _merge_sql(body: str) -> str:
    """Page by page, as it is read: each text is held against the paragraph as merged so far."""
    return f"""WITH RECURSIVE {ITEMS}, {body},
    b AS (SELECT *, {d_strip('text')} AS t, {d_prefix('text')} AS t_p, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, seq) AS n FROM body),
    h AS (SELECT doc_id, page_no, {d_strip('text')} AS h, {d_prefix('text')} AS hp, {d_norm(d_prefix('text'))} AS hn FROM page_items WHERE kind = 'heading'),
    tl AS (SELECT DISTINCT b.doc_id, b.n FROM b JOIN h USING (doc_id, page_no) WHERE starts_with(lower(b.t), lower(h.h)) OR starts_with(lower(b.t), lower(h.hp))
      OR ({d_norm('b.t')} <> '' AND {d_norm('b.t')} = h.hn)),
    bt AS (SELECT b.*, tl.n IS NOT NULL AS titled, lag(b.page_no) OVER (PARTITION BY b.doc_id ORDER BY b.n) AS pp FROM b LEFT JOIN tl ON b.doc_id = tl.doc_id AND b.n = tl.n),
    w AS (SELECT doc_id, n, text AS p, CAST(1 AS BIGINT) AS para FROM bt WHERE n = 1
      UNION ALL
      SELECT doc_id, n, CASE WHEN jn THEN concat(regexp_replace(p, '[{SPACE}]+$', ''), chr(10), regexp_replace(text, '^[{SPACE}]+', '')) ELSE text END,
        para + CASE WHEN jn THEN 0 ELSE 1 END
      FROM (SELECT *, pp <> page_no AND NOT titled AND {_d_runs_on('a', 't', 'p', 'text')} AS jn
        FROM (SELECT *, {d_prefix('a')} AS a_p, {d_prefix('a_l')} AS a_lp FROM (SELECT *, {d_strip("split_part(a, chr(10), -1)")} AS a_l
        FROM (SELECT bt.*, w.p, w.para, {d_strip('w.p')} AS a FROM w JOIN bt ON bt.doc_id = w.doc_id AND bt.n = w.n + 1)))))
    SELECT w.doc_id, arg_min(bt.page_no, w.n) AS page_no, arg_min(bt.seq, w.n) AS seq, arg_max(w.p, w.n) AS text
    FROM w JOIN bt ON bt.doc_id = w.doc_id AND bt.n = w.n GROUP BY w.doc_id, w.para"""


@query("merge_cross_page", _merge_sql("body AS (SELECT doc_id, page_no, seq, text FROM page_items WHERE kind = 'body')"))
def _(spark, sf):
    items = X.page_items(spark, sf)
    return B.merge_cross_page(items.filter("kind = 'body'"), items.filter("kind = 'heading'"))


# Runs of pages with one paragraph each between fuller pages; paragraphs as they are, indented or with Japanese words put in front of the whole text.
_SINGLE_PAGE = "CAST(seq - CASE WHEN seq % 12 < 3 THEN seq % 12 ELSE 0 END AS INT)"
_SINGLE = f"""CASE (seq + doc_id) % 7 WHEN 1 THEN concat('　{"漢字" * 30}', text) WHEN 2 THEN concat(text, '。') WHEN 3 THEN concat('{"日本語" * 40} ', text)
      WHEN 4 THEN concat('また', text, ' of') ELSE text END"""


@query(
    "merge_cross_page_single",
    _merge_sql(f"body AS (SELECT doc_id, {_SINGLE_PAGE} AS page_no, seq, {_SINGLE} AS text FROM page_items WHERE kind = 'body')"),
)
def _(spark, sf):
    items = X.page_items(spark, sf)
    body = items.filter("kind = 'body'").selectExpr(
        "doc_id", f"{_SINGLE_PAGE} AS page_no", "seq", f"{_SINGLE} AS text"
    )
    return B.merge_cross_page(body, items.filter("kind = 'heading'"))


@query(
    "move_notes_from_body",
    f"""WITH {HITEMS}, pi AS (SELECT doc_id, CAST(ord // 30 + 1 AS INT) AS page_no, CAST(ord AS INT) AS seq, {X._ITEM_KIND} AS kind, {X._ITEM_TEXT['duck']} AS text
      FROM (SELECT *, CAST(ord // 30 + 1 AS INT) AS page_no FROM segments)),
    bd AS (SELECT doc_id, page_no, seq, text FROM pi WHERE kind = 'body' UNION ALL
      SELECT doc_id, page_no, seq, concat(text, chr(10), ' second line ') FROM items WHERE seq % 2 = 0),
    bl AS (SELECT doc_id, page_no, seq, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM bd),
    lt AS (SELECT *, {d_strip('line')} AS t FROM bl WHERE {d_strip('line')} <> ''
      AND NOT regexp_matches({d_strip('line')}, '^---[{SPACE}]*ページ[{SPACE}]*\\p{{Nd}}+[{SPACE}]*---$')),
    nt AS (SELECT *, {d_has('t', r'^【(?:注釈文|注)\d+】')} AS note FROM lt)
    SELECT 'body' AS kind, count(*) AS n FROM (SELECT DISTINCT doc_id, page_no, seq FROM nt WHERE NOT note)
    UNION ALL SELECT 'footnote', (SELECT count(*) FROM pi WHERE kind = 'footnote') + count(*) FROM (SELECT DISTINCT doc_id, page_no, t FROM nt WHERE note
      AND NOT EXISTS (SELECT 1 FROM pi f WHERE f.kind = 'footnote' AND f.doc_id = nt.doc_id AND f.page_no = nt.page_no AND f.text = nt.t))""",
)
def _(spark, sf):
    foot = X.page_items(spark, sf).filter("kind = 'footnote'").select(*PAGE, "kind", "seq", "text")
    items = bodies(spark, sf).withColumn("kind", F.lit("body")).unionByName(foot)
    out = D.move_notes_from_body(items)
    # Dressed lines reuse the numbers of body lines, so paragraphs are counted by number.
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "batch_dashboard",
    f"""WITH {ITEMS}, {X.ARRIVALS_SQL}, total AS (SELECT doc_id, max(page_no) + 7 AS tp FROM page_items GROUP BY doc_id),
    al AS (SELECT doc_id, tp, unnest(range(0, (tp - 1) // 5 + 1)) AS b FROM total),
    pp AS (SELECT doc_id, page_no, count(*) FILTER (kind = 'footnote') AS notes FROM page_items WHERE page_no % 3 <> 0 GROUP BY ALL),
    dn AS (SELECT doc_id, (page_no - 1) // 5 AS b, count(*) AS completed, sum(notes) AS notes FROM pp GROUP BY ALL),
    tc AS (SELECT doc_id, (page_no - 1) // 5 AS b, max(arrived) AS lm FROM page_arrivals GROUP BY ALL)
    SELECT doc_id, CAST(b + 1 AS INT) AS batch_no, CAST(b * 5 + 1 AS INT) AS start_page, CAST(least(tp, b * 5 + 5) AS INT) AS end_page,
      coalesce(completed, 0) AS completed, CAST(coalesce(notes, 0) AS BIGINT) AS notes, 0 AS figures, 0 AS tables, lm AS last_modified,
      coalesce(completed, 0) = least(tp, b * 5 + 5) - b * 5 AS is_completed
    FROM al LEFT JOIN dn USING (doc_id, b) LEFT JOIN tc USING (doc_id, b)""",
)
def _(spark, sf):
    items = X.page_items(spark, sf)
    documents = items.groupBy("doc_id").agg((F.max("page_no") + 7).alias("total_pages"))
    stored = X.page_arrivals(spark, sf).withColumnRenamed("arrived", "last_modified")
    return D.batch_dashboard(items.filter("page_no % 3 <> 0"), stored, documents, batch_size=4)


@query("document_stream")
def _(spark, sf):
    items = X.page_items(spark, sf).unionByName(
        heading_items(spark, sf).filter("kind = 'subheading'").select(*PAGE, "kind", "seq", "text")
    )
    rows = book_rows(spark, sf).withColumn("table_seq", F.lit(1))
    figures = items.filter("kind = 'heading'").select(*PAGE, "seq", F.lit("図").alias("name"))
    return P.document_stream(items, rows, figures)


def layout(spark, sf):
    """Text pages with body and footnote regions on every other page, grid pages with a table."""
    lines = X.ocr_lines(spark, sf).select(*PAGE, "line_id", "text", "x", "y", "width", "height", "is_vertical")
    grid = X.grid_lines(spark, sf).withColumn("doc_id", F.col("doc_id") + 10000000).select(*lines.columns)
    framed = lines.select(*PAGE).distinct().filter("(doc_id + page_no) % 2 = 0")
    regions = framed.selectExpr(
        "doc_id", "page_no", """explode(array(
          named_struct('region_seq', 1, 'name', '本文', 'type', 'body', 'orientation', 'auto', 'x', 0, 'y', 60, 'width', 1300, 'height', 420),
          named_struct('region_seq', 2, 'name', '注', 'type', 'footnote', 'orientation', 'auto', 'x', 0, 'y', 480, 'width', 1300, 'height', 900),
          named_struct('region_seq', 3, 'name', '見出し', 'type', 'heading', 'orientation', 'auto', 'x', 0, 'y', 0, 'width', 1300, 'height', 110))) AS r""",
    ).select(*PAGE, "r.*")
    rules = "CAST(array() AS ARRAY<STRUCT<is_vertical: BOOLEAN, pos: INT, start: INT, end: INT>>)"
    tables = ruled_tables(spark, sf).selectExpr(
        "doc_id + 10000000 AS doc_id", "page_no", "region_seq", "name", "type", "'auto' AS orientation", "x", "y", "width", "height",
        f"coalesce(rule_lines, {rules}) AS rule_lines",
    )
    user = regions.withColumn("rule_lines", F.expr(rules))
    return lines.unionByName(grid), user, tables


@query("build_pages")
def _(spark, sf):
    lines, user, auto = layout(spark, sf)
    return P.build_pages(lines, user, auto)[0]


@query(
    "build_pages_tables",
    f"""WITH {X.GRID_SQL} SELECT doc_id + 10000000 AS doc_id, page_no, row_no AS row_index,
      CASE WHEN doc_id % 3 = 1 AND n_rows = 1 THEN array_to_string(cells, ' ') ELSE array_to_string(cells, '|') END AS cells
    FROM grid_rows JOIN grid_regions USING (doc_id, page_no)""",
)
def _(spark, sf):
    lines, user, auto = layout(spark, sf)
    return P.build_pages(lines, user, auto)[1].select(*PAGE, "row_index", F.array_join("cells", "|").alias("cells"))

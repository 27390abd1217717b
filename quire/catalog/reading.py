"""Reading order and paragraph queries."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import SPACE, d_strip, query
from quire.catalog.lines import LINES, blocks
from quire.functions import text as T
from quire.operators.grouping import group_along
from quire.operators import lines as L
from quire.operators import paragraphs as P
from quire.operators import reading as O
from quire.operators.staging import settle
from quire.plans import fixtures as X

WORD = r"\p{L}\p{M}\p{N}_"


def d_cut(source: str, out: str, times: int, unit: str, word_start: bool = False, keep: str = "*") -> str:
    """CTE cutting ``text`` where a unit first repeats ``times`` times."""
    start = f"AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[{WORD}]'))" if word_start else ""
    probe = (
        f"list_min([i FOR i IN range(1, length(text) + 1) IF len([l FOR l IN range(1, (length(text) - i + 1) // {times} + 1) "
        f"IF repeat(substr(text, i, l), {times}) = substr(text, i, {times} * l) AND regexp_matches(substr(text, i, l), '{unit}')]) > 0 {start}])"
    )
    return f"""{out} AS (SELECT * EXCLUDE (cut) REPLACE ({d_strip('CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, cut - 1) END')} AS text)
      FROM (SELECT *, {probe} AS cut FROM {source}))"""


def d_years(source: str, out: str) -> str:
    e = r"regexp_replace(regexp_replace(text, '(\b\d{4}[a-z]?)l\.', '\1].', 'g'), '(\b\d{4}[a-z]?)1\.', '\1].', 'g')"
    return f"{out} AS (SELECT * REPLACE ({e} AS text) FROM {source})"


def d_clean_app(source: str, out: str) -> str:
    return ",\n".join(
        [
            d_cut(source, "_k1", 5, rf"^[^{SPACE}]$"),
            d_cut("_k1", "_k2", 4, rf"^[{WORD}]+[{SPACE}]+$", word_start=True),
            d_cut("_k2", "_k3", 4, rf"^(?:\([^)]*\)|[^{SPACE}]+)[{SPACE}]*$"),
            d_years("_k3", "_k4"),
            f"{out} AS (SELECT * FROM _k4 WHERE regexp_matches(text, '[^{SPACE}]'))",
        ]
    )


CLEAN = f"{LINES},\n{d_clean_app('ocr_lines', 'clean')}"


@query("clean_runaway_app", f"WITH {LINES},\n{d_clean_app('ocr_lines', 'clean')} SELECT doc_id, page_no, line_id, text FROM clean")
def _(spark, sf):
    return O.without_runaway(X.ocr_lines(spark, sf)).select(*PAGE, "line_id", "text")


@query(
    "clean_runaway_region",
    f"""WITH {LINES},
    {d_cut('ocr_lines', '_k1', 5, f'^[^{SPACE}]$')},
    {d_cut('_k1', '_k2', 4, f'^[{WORD}]+[{SPACE}]+$', word_start=True)},
    {d_years('_k2', '_k3')} SELECT doc_id, page_no, line_id, text FROM _k3""",
)
def _(spark, sf):
    return X.ocr_lines(spark, sf).select(*PAGE, "line_id", T.clean_runaway("text", "region").alias("text"))


@query("clean_runaway_recognizer")
def _(spark, sf):
    return X.ocr_lines(spark, sf).select(*PAGE, "line_id", T.clean_runaway("text", "recognizer").alias("text"))


def _order_sql(vertical_rest: int) -> str:
    return f"""{X.lines_sql(vertical_rest)},
    {d_clean_app('ocr_lines', 'clean')},
    a AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy, CASE WHEN doc_id % 2 = 1 THEN (line_id % 30) % 15 ELSE line_id % 30 END AS row,
            min(x) OVER p AS x1, max(x + width) OVER p AS x2, min(y) OVER p AS y1, max(y + height) OVER p AS y2, count(*) OVER p AS n
          FROM clean WINDOW p AS (PARTITION BY doc_id, page_no)),
    b AS (SELECT *, count(*) FILTER (abs(cy - (y1 + (y2 - y1) / 2)) < (y2 - y1) / 8) OVER p AS mid,
            count(*) FILTER (cy < y1 + (y2 - y1) / 2) OVER p AS up FROM a WINDOW p AS (PARTITION BY doc_id, page_no)),
    c AS (SELECT *, is_vertical AND n >= 6 AND y2 - y1 >= 100 AND mid = 0 AND up >= 2 AND n - up >= 2 AS decks,
            x2 - x1 > 250 AND x2 - x1 > (y2 - y1) * 0.85 AS spread FROM b)"""


def _reading_sql(vertical_rest: int) -> str:
    return f"""WITH {_order_sql(vertical_rest)},
    h AS (SELECT *, CASE WHEN decks AND spread AND cx < x1 + (x2 - x1) / 2 THEN 1 ELSE 0 END AS half FROM c),
    k AS (SELECT *, min(y) OVER q AS hy1, max(y + height) OVER q AS hy2 FROM h WINDOW q AS (PARTITION BY doc_id, page_no, half)),
    t AS (SELECT *, CASE WHEN decks THEN least(greatest(CAST(floor((cy - hy1) / ((hy2 - hy1) / 2)) AS INT), 0), 1) ELSE 0 END AS deck,
            CASE WHEN NOT is_vertical AND spread AND cx >= x1 + (x2 - x1) / 2 THEN 1 ELSE 0 END AS side FROM k)
    SELECT doc_id, page_no, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY half, deck, side,
      CASE WHEN is_vertical THEN -x ELSE row END, CASE WHEN is_vertical THEN y ELSE x END) AS INT) AS position FROM t"""


@query("reading_order", _reading_sql(0))
def _(spark, sf):
    return O.reading_order(X.ocr_lines(spark, sf))


@query("reading_order_decks", _reading_sql(1))
def _(spark, sf):
    return O.reading_order(X.ocr_lines(spark, sf, vertical_rest=1))


@query(
    "reading_order_regions",
    f"""WITH {CLEAN}, r AS (SELECT *, CASE WHEN floor(y + height / 2) >= 300 THEN 1 WHEN floor(y + height / 2) >= 60 THEN 2 END AS reg,
        CASE WHEN doc_id % 2 = 1 THEN (line_id % 30) % 15 ELSE line_id % 30 END AS row FROM clean),
    e AS (SELECT *, min(x) OVER p AS x1, max(x + width) OVER p AS x2, min(y) OVER p AS y1, max(y + height) OVER p AS y2
          FROM r WHERE reg IS NOT NULL AND floor(y + height / 2) < 900 WINDOW p AS (PARTITION BY doc_id, page_no, reg)),
    t AS (SELECT *, CASE WHEN x2 - x1 > 250 AND x2 - x1 > (y2 - y1) * 0.85 AND x + width / 2 >= x1 + (x2 - x1) / 2 THEN 1 ELSE 0 END AS side FROM e)
    SELECT doc_id, page_no, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reg, side, row, x) AS INT) AS position
    FROM t WHERE NOT is_vertical
    UNION ALL SELECT doc_id, page_no, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY reg, x DESC) AS INT)
    FROM t WHERE is_vertical""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    pages = lines.select(*PAGE).distinct()
    # The lower part is read first; the two regions overlap and the first one wins.
    regions = pages.selectExpr("doc_id", "page_no", "1 AS region_seq", "0 AS x", "300 AS y", "1300 AS width", "600 AS height").unionByName(
        pages.selectExpr("doc_id", "page_no", "2 AS region_seq", "0 AS x", "60 AS y", "1300 AS width", "840 AS height")
    )
    return O.reading_order(lines, regions=regions)


def d_ends(e: str) -> str:
    return f"regexp_matches({d_strip(e)}, " + r"""'[。.！？!?](?:\[[^\]]*\]|\([^)]*\)|[」』）)"''\]])*$')"""


def _t16(subheadings: bool) -> str:
    return f"""WITH {_order_sql(0)},
    t AS (SELECT *, CASE WHEN decks THEN least(greatest(CAST(floor((cy - y1) / ((y2 - y1) / 2)) AS INT), 0), 1) ELSE 0 END AS deck FROM c),
    l AS (SELECT doc_id, page_no, deck, is_vertical AS v, CASE WHEN is_vertical THEN -x ELSE row END AS ln,
            string_agg(text, '' ORDER BY CASE WHEN is_vertical THEN y ELSE x END) AS text,
            min(CASE WHEN is_vertical THEN y ELSE x END) AS s, max(CASE WHEN is_vertical THEN y + height ELSE x + width END) AS e,
            min(CASE WHEN is_vertical THEN -(x + width) ELSE y END) AS near, max(CASE WHEN is_vertical THEN -x ELSE y + height END) AS far,
            max(CASE WHEN is_vertical THEN width ELSE height END) AS size FROM t GROUP BY ALL),
    m AS (SELECT *, near - lag(far) OVER w AS gap, lag(text) OVER w AS pt, lag(s) OVER w AS ps, lag(e) OVER w AS pe, lag(s, 2) OVER w AS pps,
            lag(text) OVER (PARTITION BY doc_id, page_no ORDER BY deck, ln) AS lt
          FROM l WINDOW w AS (PARTITION BY doc_id, page_no, deck ORDER BY ln)),
    st AS (SELECT doc_id, page_no, deck, avg(size) AS z, min(s) AS ms, max(e) AS me, list_sort(list(gap) FILTER (gap > 0)) AS gs FROM m GROUP BY ALL),
    j AS (SELECT m.*, z, ms, me, coalesce(gs[len(gs) // 2 + 1], z * 0.4) AS med FROM m JOIN st USING (doc_id, page_no, deck)),
    f AS (SELECT *, regexp_matches(text, '^[　 \t]') AS sp, s >= ps + z * 0.65 AS sh, abs(s - ps) < z * 0.35 AS al,
            gap >= greatest(z * 0.7, med * 1.3) AS wd, {d_ends('pt')} AS pend, {d_ends('lt')} AS lend FROM j),
    g AS (SELECT *, wd OR sp OR sh OR (s - ms >= z * CASE WHEN v THEN 0.65 ELSE 0.75 END AND NOT al)
            OR (gap >= least(z * 0.45, med * 1.15) AND (sh OR sp OR (s - ms >= z * 0.45 AND NOT al)))
            OR (coalesce(pps - ms >= z, false) AND ps - ms >= z * 1.2 AND s - ms <= ps - ms - z * 0.8)
            OR me - pe > z * CASE WHEN v THEN 2.0 ELSE 2.5 END
            OR CASE WHEN v THEN s - ms > z * 3 ELSE regexp_matches(text, '^[「『“"（(]') END AS cause FROM f),
    n AS (SELECT *, CASE WHEN pt IS NOT NULL THEN CASE WHEN pend AND cause THEN 1 ELSE 0 END
                         WHEN lt IS NULL THEN 1 WHEN lend OR false THEN 1 ELSE 0 END AS brk FROM g),
    o AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no ORDER BY deck, ln) AS para FROM n)
    SELECT doc_id, page_no, CAST(para AS INT) AS para_no, string_agg(text, '' ORDER BY deck, ln) AS text FROM o GROUP BY ALL"""


@query("format_paragraphs", _t16(False))
def _(spark, sf):
    return P.format_paragraphs(X.ocr_lines(spark, sf))


# --- rows on crowded pages -------------------------------------------------------------

# Lines of four pages on one and rows 9 px apart, so that rows drift into one another and lines overlap.
CROWDED = """crowded AS (SELECT doc_id, CAST((page_no - 1) // 4 AS INT) AS page_no, line_id, x AS lo, x + width AS hi,
    2 * CAST(80 + 9 * ((line_id % 30) % 15) + (line_id * 7) % 5 AS BIGINT) + height AS c2, height * 0.7 AS reach
  FROM ocr_lines WHERE NOT is_vertical)"""


@query(
    "group_rows_crowded",
    # One recursion step takes the next line of every page into the nearest free group, in plain lists.
    f"""WITH RECURSIVE {LINES}, {CROWDED},
    i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY c2, line_id) AS k FROM crowded),
    walk AS (
      SELECT DISTINCT doc_id, page_no, CAST(0 AS BIGINT) AS k,
        CAST([] AS STRUCT(t BIGINT, n BIGINT, r DOUBLE, m STRUCT(id BIGINT, lo BIGINT, hi BIGINT)[])[]) AS gs FROM i
      UNION ALL
      SELECT doc_id, page_no, k, CASE WHEN best IS NULL
          THEN list_append(gs, {{'t': c2, 'n': CAST(1 AS BIGINT), 'r': reach, 'm': [me]}})
          ELSE list_transform(gs, lambda g, j: CASE WHEN j = best
            THEN {{'t': g.t + c2, 'n': g.n + 1, 'r': least(g.r, reach), 'm': list_append(g.m, me)}} ELSE g END) END
      FROM (SELECT *, {{'id': CAST(line_id AS BIGINT), 'lo': CAST(lo AS BIGINT), 'hi': CAST(hi AS BIGINT)}} AS me,
              list_min(list_filter(list_transform(gs, lambda g, j: CASE WHEN abs(c2 - g.t / g.n) < least(reach, g.r)
                AND len(list_filter(g.m, lambda e: greatest(lo, e.lo) < least(hi, e.hi))) = 0
                THEN {{'d': abs(c2 - g.t / g.n), 'j': j}} END), lambda e: e IS NOT NULL)).j AS best
            FROM (SELECT i.*, w.gs FROM walk w JOIN i ON i.doc_id = w.doc_id AND i.page_no = w.page_no AND i.k = w.k + 1)))
    SELECT doc_id, page_no, e.id AS line_id, g.m[1].id AS first_id FROM (
      SELECT doc_id, page_no, g, unnest(g.m) AS e FROM (
        SELECT doc_id, page_no, unnest(gs) AS g FROM walk QUALIFY k = max(k) OVER (PARTITION BY doc_id, page_no)))""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf).filter("NOT is_vertical").selectExpr(
        "doc_id", "cast((page_no - 1) div 4 as int) AS page_no", "cast(line_id as bigint) AS line_id", "x AS lo", "x + width AS hi",
        "2 * (80 + 9 * ((line_id % 30) % 15) + (line_id * 7) % 5) + height AS c2", "height * 0.7D AS reach",
    )
    # Read twice below; the walk through the tangled rows runs once.
    rows = settle(group_along(lines, PAGE, "line_id", F.col("c2"), F.col("reach"), F.col("lo"), F.col("hi")))
    entered = rows.join(lines.select(*PAGE, "line_id", "c2"), [*PAGE, "line_id"])
    first = entered.groupBy(*PAGE, "band", "grp").agg(F.min_by("line_id", F.struct("c2", "line_id")).alias("first_id"))
    return rows.join(first, [*PAGE, "band", "grp"]).select(*PAGE, "line_id", "first_id")


# --- simple order --------------------------------------------------------------------

@query("simple_reading_order")
def _(spark, sf):
    return O.simple_reading_order(L.with_orientation(blocks(spark, sf)))


@query(
    "columns_right_to_left",
    f"""WITH {LINES} SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY x DESC, line_id) AS INT) AS column_no,
        x FROM ocr_lines WHERE is_vertical""",
)
def _(spark, sf):
    columns = X.ocr_lines(spark, sf).filter("is_vertical").selectExpr("doc_id", "page_no", "line_id AS id", "x")
    return O.columns_right_to_left(columns).select(*PAGE, "column_no", "x")


@query(
    "order_table_lines",
    f"""WITH {X.GRID_SQL}, s AS (SELECT doc_id, page_no, line_id, x, y FROM grid_lines UNION ALL
        SELECT doc_id, page_no, 0, x, y FROM grid_captions UNION ALL SELECT doc_id, page_no, 9999, 100, 2000 FROM grid_regions)
    SELECT doc_id, page_no, line_id, CAST(CASE WHEN line_id = 0 THEN 1 WHEN line_id = 9999 THEN count(*) OVER p
        ELSE 1 + row_number() OVER (PARTITION BY doc_id, page_no, line_id IN (0, 9999) ORDER BY x, y) END AS INT) AS position
    FROM s WINDOW p AS (PARTITION BY doc_id, page_no)""",
)
def _(spark, sf):
    cells = X.grid_lines(spark, sf).withColumn("is_table", F.lit(True))
    # A caption above each table and a line below it, from one reading of the orders.
    ends = X.grid_captions(spark, sf).withColumns(
        {"is_table": F.lit(False), "_e": F.expr("explode(array(struct(line_id, y), struct(9999 AS line_id, 2000 AS y)))")}
    ).withColumns({"line_id": F.col("_e.line_id"), "y": F.col("_e.y")}).drop("_e")
    return O.order_table_lines(cells.unionByName(ends))


@query(
    "reading_positions",
    f"""WITH {LINES} SELECT doc_id, page_no, line_id, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, line_id) AS INT) AS position
    FROM ocr_lines""",
)
def _(spark, sf):
    from quire.operators.ordered import span

    lines = X.ocr_lines(spark, sf).select(*PAGE, "line_id", "x", "y")
    order = [F.col("y"), F.col("x"), F.col("line_id")]
    return O.reading_positions(lines, order, span("y", 1024)).select(*PAGE, "line_id", "position")

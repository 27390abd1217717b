"""Region, table-box and detection queries."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import query
from quire.catalog.lines import DETS, LINES, detections
from quire.operators import decks as D
from quire.operators import detections as N
from quire.operators import regions as R
from quire.plans import fixtures as X

GRID = X.GRID_SQL


def grid_lines_and_captions(spark, sf):
    return X.grid_lines(spark, sf).unionByName(X.grid_captions(spark, sf))


GRID_ALL = f"""{GRID},
all_lines AS (SELECT * FROM grid_lines UNION ALL SELECT * FROM grid_captions)"""


# Regions over the text pages: the upper half is body, the lower left a table, the lower
# right an image, a strip at the top has no type but a telling name.
def page_regions(spark, sf):
    return (
        X.ocr_lines(spark, sf).select(*PAGE).distinct()
        .withColumn("r", F.expr("""explode(array(
            named_struct('region_seq', 1, 'name', '見出し', 'type', 'unclassified', 'x', 0, 'y', 0, 'width', 1200, 'height', 100),
            named_struct('region_seq', 2, 'name', '本文', 'type', 'text', 'x', 50, 'y', 90, 'width', 1100, 'height', 450),
            named_struct('region_seq', 3, 'name', '', 'type', '表', 'x', 0, 'y', 541, 'width', 500, 'height', 350),
            named_struct('region_seq', 4, 'name', '', 'type', 'image', 'x', 470, 'y', 600, 'width', 700, 'height', 400)))"""))
        .select(*PAGE, "r.*")
    )


PAGE_REGIONS = """
regions AS (SELECT doc_id, page_no, v.* FROM (SELECT DISTINCT doc_id, page_no FROM ocr_lines),
  (VALUES (1, '見出し', 'unclassified', 0, 0, 1200, 100), (2, '本文', 'text', 50, 90, 1100, 450),
          (3, '', '表', 0, 541, 500, 350), (4, '', 'image', 470, 600, 700, 400))
    AS v(region_seq, name, type, rx, ry, rw, rh))"""
_KIND = "CASE type WHEN 'text' THEN 'body' WHEN '表' THEN 'table' WHEN 'unclassified' THEN {u} ELSE type END"
_CENTRE = "x + width // 2 >= rx AND x + width // 2 < rx + rw AND y + height // 2 >= ry AND y + height // 2 < ry + rh"
_IW = "(least(rx + rw, x + width) - greatest(rx, x))"
_IH = "(least(ry + rh, y + height) - greatest(ry, y))"


def _assigned(kind: str) -> str:
    return f"""m AS (SELECT doc_id, page_no, line_id, min(region_seq) AS region_seq, arg_min({kind}, region_seq) AS kind
      FROM ocr_lines JOIN regions USING (doc_id, page_no)
      WHERE ({_CENTRE}) OR ({_IW} > 0 AND {_IH} > 0 AND ({_IW} * {_IH} * 2 >= width * height OR {_IW} * {_IH} >= 100))
      GROUP BY ALL)"""


@query(
    "assign_regions",
    f"""WITH {LINES}, {PAGE_REGIONS}, {_assigned(_KIND.format(u="'heading'"))}
    SELECT doc_id, page_no, line_id, m.region_seq, coalesce(kind, '') AS region_type
    FROM ocr_lines LEFT JOIN m USING (doc_id, page_no, line_id)""",
)
def _(spark, sf):
    out = R.assign_regions(X.ocr_lines(spark, sf), page_regions(spark, sf))
    return out.select(*PAGE, "line_id", "region_seq", "region_type")


@query(
    "assign_regions_auto",
    f"""WITH {LINES}, {PAGE_REGIONS}, {_assigned(_KIND.format(u="'unclassified'"))}
    SELECT doc_id, page_no, line_id, m.region_seq, coalesce(kind, '') AS region_type
    FROM ocr_lines LEFT JOIN m USING (doc_id, page_no, line_id)""",
)
def _(spark, sf):
    out = R.assign_regions(X.ocr_lines(spark, sf), page_regions(spark, sf), source="auto")
    return out.select(*PAGE, "line_id", "region_seq", "region_type")


@query(
    "assign_regions_legacy",
    f"""WITH {LINES}, {PAGE_REGIONS},
    m AS (SELECT doc_id, page_no, line_id, min(region_seq) AS region_seq,
                 arg_min({_KIND.format(u="'unclassified'")}, region_seq) AS kind
      FROM ocr_lines JOIN regions USING (doc_id, page_no)
      WHERE x + width // 2 BETWEEN rx AND rx + rw AND y + height // 2 BETWEEN ry AND ry + rh GROUP BY ALL)
    SELECT doc_id, page_no, line_id, m.region_seq, coalesce(kind, '') AS region_type
    FROM ocr_lines LEFT JOIN m USING (doc_id, page_no, line_id)""",
)
def _(spark, sf):
    out = R.assign_regions(X.ocr_lines(spark, sf), page_regions(spark, sf), legacy=True)
    return out.select(*PAGE, "line_id", "region_seq", "region_type")


def user_and_auto(spark, sf):
    """User regions on every third page, detected ones on another third, none on the rest."""
    regions = page_regions(spark, sf)
    return regions.filter("(doc_id + page_no) % 3 = 0"), regions.filter("(doc_id + page_no) % 3 = 1")


@query(
    "route_lines_by_region",
    f"""WITH {LINES}, {PAGE_REGIONS}, {_assigned("type")},
    t AS (SELECT l.doc_id, l.page_no, line_id, m.region_seq, m.kind AS type, (doc_id + page_no) % 3 AS mode
          FROM ocr_lines l LEFT JOIN m USING (doc_id, page_no, line_id)),
    u AS (SELECT *, CASE WHEN mode = 2 THEN 'body' WHEN mode = 0 THEN coalesce({_KIND.format(u="'heading'")}, '')
                    ELSE coalesce({_KIND.format(u="'unclassified'")}, '') END AS region_type FROM t)
    SELECT doc_id, page_no, line_id, region_type FROM u WHERE region_type NOT IN ('', 'unclassified', 'image')""",
)
def _(spark, sf):
    user, auto = user_and_auto(spark, sf)
    return R.route_lines_by_region(X.ocr_lines(spark, sf), user, auto).select(*PAGE, "line_id", "region_type")


@query(
    "assign_lines_to_cells",
    f"""WITH {GRID_ALL}
    SELECT c.doc_id, c.page_no, c.region_seq, c.row_no, c.col_no,
           coalesce(string_agg(l.text, ' ' ORDER BY l.line_id), '') AS text, CAST(count(l.line_id) AS INT) AS ocr_count
    FROM grid_cells c LEFT JOIN all_lines l ON l.doc_id = c.doc_id AND l.page_no = c.page_no
      AND l.x + l.width / 2 BETWEEN c.x AND c.x + c.width AND l.y + l.height / 2 BETWEEN c.y AND c.y + c.height
    GROUP BY ALL""",
)
def _(spark, sf):
    out = R.assign_lines_to_cells(X.grid_cells(spark, sf), grid_lines_and_captions(spark, sf))
    return out.select(*PAGE, "region_seq", "row_no", "col_no", "text", "ocr_count")


@query(
    "remove_table_lines",
    f"""WITH {GRID_ALL} SELECT doc_id, page_no, line_id FROM all_lines l
    WHERE NOT EXISTS (SELECT 1 FROM grid_regions t WHERE t.doc_id = l.doc_id
      AND l.x + l.width / 2 BETWEEN t.x AND t.x + t.width AND l.y + l.height / 2 BETWEEN t.y AND t.y + t.height)""",
)
def _(spark, sf):
    lines, cells = grid_lines_and_captions(spark, sf), X.grid_cells(spark, sf)
    used = R.lines_in_cells(cells.filter("row_no > 1"), lines)
    return R.remove_table_lines(lines, used, X.grid_regions(spark, sf)).select(*PAGE, "line_id")


CAPTIONS = f"""{GRID_ALL},
caps AS (SELECT t.doc_id, t.page_no, t.region_seq AS table_index, l.line_id,
    row_number() OVER (PARTITION BY t.doc_id, t.page_no, t.region_seq ORDER BY t.y - l.y - l.height, l.x, l.line_id) AS rn
  FROM grid_regions t JOIN all_lines l ON l.doc_id = t.doc_id AND l.page_no = t.page_no
  WHERE t.y - l.y - l.height BETWEEN 0 AND 40 AND least(l.x + l.width, t.x + t.width) > greatest(l.x, t.x)
    AND (least(l.x + l.width, t.x + t.width) - greatest(l.x, t.x)) / greatest(1, l.width) >= 0.3)"""


@query("table_captions", f"WITH {CAPTIONS} SELECT doc_id, page_no, table_index, line_id FROM caps WHERE rn = 1")
def _(spark, sf):
    return R.table_captions(grid_lines_and_captions(spark, sf), X.grid_regions(spark, sf))


@query(
    "without_captions",
    f"""WITH {CAPTIONS} SELECT doc_id, page_no, line_id FROM all_lines
    ANTI JOIN (SELECT * FROM caps WHERE rn = 1) USING (doc_id, page_no, line_id)""",
)
def _(spark, sf):
    lines = grid_lines_and_captions(spark, sf)
    captions = R.table_captions(lines, X.grid_regions(spark, sf))
    return R.without_captions(lines, captions).select(*PAGE, "line_id")


@query(
    "segments_in_regions",
    f"""WITH {GRID} SELECT s.doc_id, s.page_no, r.region_seq, orient, pos, a AS start, b AS "end", b - a + 1 AS length FROM (
      SELECT s.*, r.region_seq, greatest(start, CASE WHEN orient = 'h' THEN r.x ELSE r.y END) AS a,
             least("end", CASE WHEN orient = 'h' THEN r.x + r.width ELSE r.y + r.height END) AS b,
             CASE WHEN orient = 'h' THEN r.y ELSE r.x END - 3 AS lo,
             CASE WHEN orient = 'h' THEN r.y + r.height ELSE r.x + r.width END + 3 AS hi
      FROM grid_segments s JOIN grid_regions r USING (doc_id, page_no)) s, (SELECT 1 AS region_seq) r
    WHERE pos BETWEEN lo AND hi AND b > a""",
)
def _(spark, sf):
    return R.segments_in_regions(X.grid_segments(spark, sf), X.grid_regions(spark, sf))


_PAIRS = f"""{GRID},
h AS (SELECT DISTINCT doc_id, page_no, pos, start, "end", ord FROM grid_segments WHERE orient = 'h'),
v AS (SELECT DISTINCT doc_id, page_no, pos, start, "end" FROM grid_segments WHERE orient = 'v'),
pr AS (SELECT t.doc_id, t.page_no, t.ord AS t_ord, b.ord AS b_ord, t.pos AS y1, b.pos AS y2,
              greatest(t.start, b.start) AS cx1, least(t."end", b."end") AS cx2
       FROM h t JOIN h b ON t.doc_id = b.doc_id AND t.page_no = b.page_no AND t.ord < b.ord AND b.pos - t.pos >= 30),
cl AS (SELECT pr.*, min(v.pos) AS vl, max(v.pos) AS vr FROM pr JOIN v USING (doc_id, page_no)
       WHERE v.pos BETWEEN cx1 AND cx2 AND v.start <= y1 + 5 AND v."end" >= y2 - 5 GROUP BY ALL HAVING min(v.pos) < max(v.pos)),
bordered AS (SELECT doc_id, page_no, CASE WHEN vl - cx1 > 40 THEN cx1 ELSE vl END AS x, y1 AS y,
       CASE WHEN cx2 - vr > 40 THEN cx2 ELSE vr END - CASE WHEN vl - cx1 > 40 THEN cx1 ELSE vl END AS width,
       y2 - y1 AS height FROM cl)"""


def ruled_pages(spark, sf):
    return X.grid_regions(spark, sf).selectExpr("doc_id", "page_no", "800 AS width", "100 + height AS height")


@query("bordered_regions", f"WITH {_PAIRS} SELECT * FROM bordered WHERE width >= 30 AND height >= 30")
def _(spark, sf):
    return R.bordered_regions(X.grid_segments(spark, sf), ruled_pages(spark, sf)).drop("region_seq")


@query(
    "bordered_regions_open",
    f"""WITH {_PAIRS}, o AS (SELECT * FROM pr WHERE cx2 - cx1 >= 160 AND EXISTS (
        SELECT 1 FROM h m WHERE m.doc_id = pr.doc_id AND m.page_no = pr.page_no AND m.pos > y1 + 5 AND m.pos < y2 - 5))
    SELECT doc_id, page_no, cx1 AS x, y1 AS y, cx2 - cx1 AS width, y2 - y1 AS height FROM o""",
)
def _(spark, sf):
    # Without vertical rules only the open three-rule tables are left.
    flat = X.grid_segments(spark, sf).filter("orient = 'h'")
    return R.bordered_regions(flat, ruled_pages(spark, sf)).drop("region_seq")


@query(
    "drop_contained",
    f"""WITH {_PAIRS} SELECT doc_id, page_no, x, y, width, height FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY width * height DESC, y) AS rn FROM bordered)
    WHERE rn = 1""",
)
def _(spark, sf):
    found = R.bordered_regions(X.grid_segments(spark, sf), ruled_pages(spark, sf))
    return R.drop_contained(found).drop("region_seq")


@query(
    "drop_contained_largest",
    f"""WITH {_PAIRS} SELECT doc_id, page_no, x, y, width, height FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY width * height DESC, y) AS rn FROM bordered)
    WHERE rn = 1""",
)
def _(spark, sf):
    found = R.bordered_regions(X.grid_segments(spark, sf), ruled_pages(spark, sf))
    return R.drop_contained(found, mode="largest").drop("region_seq")


def wobbly(spark, sf):
    """Each rule three times, up to 4 px apart."""
    seg = X.grid_segments(spark, sf).select(*PAGE, "orient", "pos", "ord")
    return seg.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "doc_id", "page_no", "orient", "CAST(pos + 2 * k * (ord % 2) AS INT) AS pos"
    )


WOBBLY = f"""{GRID}, wobbly AS (SELECT doc_id, page_no, orient, CAST(pos + 2 * k * (ord % 2) AS INT) AS pos
  FROM grid_segments, range(3) AS t(k)),
numbered_pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, orient ORDER BY pos) AS i FROM wobbly)"""


@query(
    "cluster_positions",
    f"""WITH RECURSIVE {WOBBLY},
    f AS (SELECT doc_id, page_no, orient, i, 1 AS c, CAST(pos AS BIGINT) AS s, 1 AS n FROM numbered_pos WHERE i = 1
          UNION ALL SELECT p.doc_id, p.page_no, p.orient, p.i,
            CASE WHEN abs(p.pos - f.s / f.n) > 6 THEN f.c + 1 ELSE f.c END,
            CASE WHEN abs(p.pos - f.s / f.n) > 6 THEN p.pos ELSE f.s + p.pos END,
            CASE WHEN abs(p.pos - f.s / f.n) > 6 THEN 1 ELSE f.n + 1 END
          FROM f JOIN numbered_pos p ON p.doc_id = f.doc_id AND p.page_no = f.page_no AND p.orient = f.orient AND p.i = f.i + 1)
    SELECT doc_id, page_no, orient, CAST(round_even(arg_max(s, i) / arg_max(n, i), 0) AS INT) AS pos
    FROM f GROUP BY doc_id, page_no, orient, c""",
)
def _(spark, sf):
    return R.cluster_positions(wobbly(spark, sf), 6)


MERGED = """mf AS (SELECT doc_id, page_no, orient, i, 1 AS c, pos AS p FROM numbered_pos WHERE i = 1
          UNION ALL SELECT q.doc_id, q.page_no, q.orient, q.i,
            CASE WHEN abs(q.pos - mf.p) > 8 THEN mf.c + 1 ELSE mf.c END,
            CASE WHEN abs(q.pos - mf.p) > 8 THEN q.pos ELSE CAST(round_even((q.pos + mf.p) / 2, 0) AS INT) END
          FROM mf JOIN numbered_pos q ON q.doc_id = mf.doc_id AND q.page_no = mf.page_no AND q.orient = mf.orient AND q.i = mf.i + 1),
    merged AS (SELECT doc_id, page_no, orient, arg_max(p, i) AS pos FROM mf GROUP BY doc_id, page_no, orient, c)"""


@query("merge_positions", f"WITH RECURSIVE {WOBBLY}, {MERGED} SELECT * FROM merged")
def _(spark, sf):
    return R.merge_positions(wobbly(spark, sf))


@query(
    "cells_from_positions",
    f"""WITH RECURSIVE {WOBBLY}, {MERGED},
    g AS (SELECT *, lead(pos) OVER w - pos AS size, row_number() OVER w AS no FROM merged
          WINDOW w AS (PARTITION BY doc_id, page_no, orient ORDER BY pos))
    SELECT r.doc_id, r.page_no, 1 AS region_seq, CAST(r.no AS INT) AS row_no, CAST(c.no AS INT) AS col_no, c.pos AS x, r.pos AS y,
           c.size AS width, r.size AS height
    FROM g r JOIN g c USING (doc_id, page_no) WHERE r.orient = 'h' AND c.orient = 'v' AND r.size > 0 AND c.size > 0""",
)
def _(spark, sf):
    merged = R.merge_positions(wobbly(spark, sf)).withColumn("region_seq", F.lit(1))
    return R.cells_from_positions(merged)


def side_tables(spark, sf):
    """The grid of each order and a second one, left or right of it."""
    first = X.grid_regions(spark, sf)
    second = first.selectExpr(
        "doc_id", "page_no", "2 AS region_seq", "name", "type",
        "CAST(CASE WHEN doc_id % 2 = 0 THEN 1700 ELSE 900 END AS INT) AS x", "CAST(50 AS INT) AS y", "width", "height", "n_rows",
    )
    return first.unionByName(second)


SIDE = f"""{GRID}, side_tables AS (SELECT doc_id, page_no, region_seq, x, y, width, height, n_rows FROM grid_regions
  UNION ALL SELECT doc_id, page_no, 2, CASE WHEN doc_id % 2 = 0 THEN 1700 ELSE 900 END, 50, width, height, n_rows FROM grid_regions)"""


@query(
    "order_tables",
    f"""WITH {SIDE} SELECT doc_id, page_no, region_seq, CAST(row_number() OVER (PARTITION BY doc_id, page_no
        ORDER BY CASE WHEN x < 1650 THEN 0 ELSE 1 END, y, region_seq) AS INT) AS table_seq FROM side_tables""",
)
def _(spark, sf):
    return R.order_tables(side_tables(spark, sf)).select(*PAGE, "region_seq", "table_seq")


@query(
    "order_regions",
    f"""WITH {SIDE} SELECT doc_id, page_no, region_seq, 'h' AS mode, CAST(row_number() OVER (PARTITION BY doc_id, page_no
        ORDER BY x // 500, y, region_seq) AS INT) AS order_seq FROM side_tables
    UNION ALL SELECT doc_id, page_no, region_seq, 'v', CAST(row_number() OVER (PARTITION BY doc_id, page_no
        ORDER BY -(x // 400), y, region_seq) AS INT) FROM side_tables""",
)
def _(spark, sf):
    tables = side_tables(spark, sf)
    h = R.order_regions(tables).select(*PAGE, "region_seq", F.lit("h").alias("mode"), "order_seq")
    v = R.order_regions(tables, "vertical").select(*PAGE, "region_seq", F.lit("v").alias("mode"), "order_seq")
    return h.unionByName(v)


@query(
    "table_summary",
    f"""WITH {GRID} SELECT doc_id, page_no, '表1' AS name, n_rows AS rows, 4 AS columns,
      array_to_string([100 + 40 * k FOR k IN range(1, n_rows)], ',') AS horizontal_lines, '250,400,550' AS vertical_lines
    FROM grid_regions""",
)
def _(spark, sf):
    out = R.table_summary(X.grid_cells(spark, sf), X.grid_regions(spark, sf))
    return out.select(
        *PAGE, "name", "rows", "columns", F.array_join("horizontal_lines", ",").alias("horizontal_lines"),
        F.array_join("vertical_lines", ",").alias("vertical_lines"),
    )


@query(
    "match_table",
    f"""WITH {SIDE}, t AS (SELECT doc_id, page_no, region_seq AS table_seq, '表' || region_seq AS table_name FROM side_tables),
    r AS (SELECT doc_id, page_no, CASE doc_id % 4 WHEN 0 THEN '表2' ELSE 'x' END AS table_name,
                 CASE doc_id % 4 WHEN 1 THEN '表1' ELSE '表' END AS region_name,
                 CASE doc_id % 4 WHEN 2 THEN 1 ELSE 5 END AS table_index FROM grid_regions)
    SELECT doc_id, page_no, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS table_seq FROM r""",
)
def _(spark, sf):
    tables = side_tables(spark, sf).selectExpr(
        "doc_id", "page_no", "region_seq AS table_seq", "concat('表', region_seq) AS table_name"
    )
    replacement = X.grid_regions(spark, sf).selectExpr(
        "doc_id", "page_no", "CASE doc_id % 4 WHEN 0 THEN '表2' ELSE 'x' END AS table_name",
        "CASE doc_id % 4 WHEN 1 THEN '表1' ELSE '表' END AS region_name",
        "CASE doc_id % 4 WHEN 2 THEN 1 ELSE 5 END AS table_index",
    )
    return R.match_table(tables, replacement).select(*PAGE, "table_seq")


def ruled(regions, dx):
    """Tables with their own vertical rules on even documents only."""
    return regions.selectExpr(
        "doc_id", "page_no", "region_seq", f"x + {dx} AS x", f"y + {dx} AS y", "width", "height", "name", "type",
        f"""CASE WHEN {dx} = 0 AND doc_id % 2 = 1 THEN array() ELSE array(
            named_struct('is_vertical', true, 'pos', 250 + {dx}, 'start', 0, 'end', 0),
            named_struct('is_vertical', false, 'pos', 140 + {dx}, 'start', 700, 'end', 100)) END AS rule_lines""",
    )


@query(
    "borrow_rule_lines",
    f"""WITH {GRID} SELECT doc_id, page_no, 250 + CASE WHEN doc_id % 2 = 1 THEN 20 ELSE 0 END AS v_pos,
        140 + CASE WHEN doc_id % 2 = 1 THEN 20 ELSE 0 END AS h_pos FROM grid_regions""",
)
def _(spark, sf):
    regions = X.grid_regions(spark, sf)
    auto = ruled(regions, 20).unionByName(ruled(regions, 29).withColumn("region_seq", F.lit(2)))
    auto = auto.unionByName(ruled(regions, 30).withColumn("region_seq", F.lit(0)))
    out = R.borrow_rule_lines(ruled(regions, 0), auto)
    return out.selectExpr(
        "doc_id", "page_no", "filter(rule_lines, r -> r.is_vertical)[0].pos AS v_pos",
        "filter(rule_lines, r -> NOT r.is_vertical)[0].pos AS h_pos",
    )


@query(
    "to_user_regions",
    f"""WITH {GRID} SELECT doc_id, page_no, 'table' AS type, '表' AS name, 'auto' AS orientation, 120 AS v_start,
        120 + height AS v_end, 100 AS h_start, 700 AS h_end FROM grid_regions""",
)
def _(spark, sf):
    auto = ruled(X.grid_regions(spark, sf), 20).withColumns(
        {"name": F.lit(""), "orientation": F.lit(None).cast("string"), "type": F.lit("Tabular ")}
    )
    return R.to_user_regions(auto).selectExpr(
        "doc_id", "page_no", "type", "name", "orientation", "rule_lines[0].start AS v_start",
        "rule_lines[0].end AS v_end", "rule_lines[1].start AS h_start", "rule_lines[1].end AS h_end",
    )


# --- body regions --------------------------------------------------------------------

def _groups(coord: str, limit: str, part: str, source: str) -> str:
    return f"""
    s AS (SELECT *, {coord} AS c, {part} AS part FROM {source}),
    m AS (SELECT *, {limit} AS lim FROM s),
    g1 AS (SELECT *, CASE WHEN c - lag(c) OVER w > lim THEN 1 ELSE 0 END AS brk FROM m
           WINDOW w AS (PARTITION BY doc_id, page_no, part, is_vertical ORDER BY c, line_id)),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_no, part, is_vertical ORDER BY c, line_id) + 1 AS grp FROM g1),
    b AS (SELECT doc_id, page_no, part, is_vertical, grp, count(*) AS n, min(x) AS x, min(y) AS y, max(x + width) AS x2,
                 max(y + height) AS y2 FROM g GROUP BY ALL)"""


_SIDES = """
    e AS (SELECT doc_id, page_no, min(x) AS x1, max(x + width) AS x2 FROM ocr_lines WHERE NOT is_vertical GROUP BY ALL),
    f AS (SELECT l.*, x1, x2 AS xx, l.x + l.width / 2 < x1 + (x2 - x1) / 2 AS lft FROM ocr_lines l LEFT JOIN e USING (doc_id, page_no)),
    t AS (SELECT doc_id, page_no, count(*) FILTER (lft) >= 3 AND count(*) FILTER (NOT lft) >= 3 AND
            (min(x) FILTER (NOT lft) - max(x + width) FILTER (lft) >= 15 OR any_value(xx - x1) > 450) AS two
          FROM f WHERE NOT is_vertical GROUP BY ALL),
    q AS (SELECT f.*, CASE WHEN is_vertical THEN '本文' WHEN coalesce(two, false) THEN
            CASE WHEN lft THEN '左' ELSE '右' END || CASE WHEN xx - x1 > 550 THEN 'ページ本文' ELSE '段本文' END
            ELSE '本文横' END AS prt FROM f LEFT JOIN t USING (doc_id, page_no))"""


@query(
    "body_regions",
    f"""WITH {LINES}, {_SIDES}, {_groups("CASE WHEN is_vertical THEN -x ELSE y END",
        "greatest(CASE WHEN is_vertical THEN 45 ELSE 60 END, floor(median(CASE WHEN is_vertical THEN width ELSE height END) "
        "OVER (PARTITION BY doc_id, page_no, part, is_vertical) * 2.2))", "prt", "q")}
    SELECT doc_id, page_no, CASE WHEN count(*) OVER (PARTITION BY doc_id, page_no, part, is_vertical) > 1
             THEN part || '_' || grp ELSE part END AS name, 'body' AS type, x, y, x2 - x AS width, y2 - y AS height,
           CASE WHEN is_vertical THEN 'vertical' ELSE 'horizontal' END AS orientation, CAST(n AS INT) AS ocr_count FROM b""",
)
def _(spark, sf):
    return R.body_regions(X.ocr_lines(spark, sf))


@query(
    "body_regions_simple",
    f"""WITH {LINES}, {_groups("CASE WHEN is_vertical THEN -x ELSE y END", "CASE WHEN is_vertical THEN 30 ELSE 20 END",
        "CASE WHEN is_vertical THEN '本文' ELSE '本文横' END", "ocr_lines")}
    SELECT doc_id, page_no, part AS name, 'body' AS type, x, y, x2 - x AS width, y2 - y AS height,
           CASE WHEN is_vertical THEN 'vertical' ELSE 'horizontal' END AS orientation, CAST(n AS INT) AS ocr_count
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, part ORDER BY n DESC, grp) AS rn FROM b) WHERE rn = 1""",
)
def _(spark, sf):
    return R.body_regions(X.ocr_lines(spark, sf), variant="simple")


# --- overrides -----------------------------------------------------------------------

@query(
    "effective_regions",
    f"""WITH {LINES}, {PAGE_REGIONS}
    SELECT doc_id, page_no, region_seq, 'user' AS source FROM regions WHERE (doc_id + page_no) % 3 = 0
    UNION ALL SELECT doc_id, page_no, region_seq, 'auto' FROM regions WHERE (doc_id + page_no) % 3 <> 0""",
)
def _(spark, sf):
    regions = page_regions(spark, sf)
    user = regions.filter("(doc_id + page_no) % 3 = 0").withColumn("source", F.lit("user"))
    out = R.effective_regions(user, regions.withColumn("source", F.lit("auto")))
    return out.select(*PAGE, "region_seq", "source")


@query(
    "changed_pages",
    f"""WITH {LINES} SELECT DISTINCT doc_id, page_no FROM ocr_lines WHERE (doc_id + page_no) % 3 IN (1, 2)""",
)
def _(spark, sf):
    auto = page_regions(spark, sf)
    moved = auto.withColumn("x", F.col("x") + F.when(F.expr("(doc_id + page_no) % 3 = 1 AND region_seq = 2"), 1).otherwise(0))
    user = moved.filter("NOT ((doc_id + page_no) % 3 = 2 AND region_seq = 4)")
    return R.changed_pages(user, auto)


@query(
    "copy_regions",
    f"""WITH {LINES}, {PAGE_REGIONS}, p AS (SELECT DISTINCT doc_id, page_no FROM ocr_lines)
    SELECT doc_id, page_no, region_seq, x FROM (
      SELECT doc_id, page_no, region_seq, rx + page_no AS x FROM regions WHERE page_no % 2 = 1
      UNION ALL SELECT p.doc_id, p.page_no, region_seq, rx + 1 FROM p JOIN regions r ON r.doc_id = p.doc_id AND r.page_no = 1
      WHERE p.page_no % 2 = 0)""",
)
def _(spark, sf):
    regions = page_regions(spark, sf).withColumn("x", F.col("x") + F.col("page_no"))
    pages = regions.select(*PAGE).distinct()
    source = pages.filter("page_no = 1")
    targets = pages.filter("page_no % 2 = 0 OR page_no = 1")
    return R.copy_regions(regions, source, targets).select(*PAGE, "region_seq", "x")


@query(
    "union_regions",
    f"""WITH {GRID} SELECT doc_id, page_no, 'table' AS type FROM grid_regions
    UNION ALL SELECT doc_id, page_no, 'body' FROM grid_captions""",
)
def _(spark, sf):
    bodies = R.body_regions(X.grid_captions(spark, sf))
    return R.union_regions(X.grid_regions(spark, sf), bodies).select(*PAGE, "type")


def _split_sql(start, length, parts):
    piece = f"CAST(floor(({length}) * {0.485 if parts == 2 else 0.315}) AS INT)"
    gap = f"(({length}) - 2 * {piece})" if parts == 2 else f"greatest(2, (({length}) - 3 * {piece}) // 2)"
    return [(f"{start} + ({piece} + {gap}) * {i}", piece) for i in range(parts)]


def _deck_sql(parts, names):
    rows = []
    for i, (y, h) in enumerate(_split_sql("y1", "y2 - y1", parts)):
        rows.append(f"SELECT doc_id, page_no, {i + 1} AS region_seq, '{names[i]}' AS name, x1 AS x, {y} AS y, x2 - x1 AS width, {h} AS height FROM bb")
    return " UNION ALL ".join(rows)


BODY_BOX = """bb AS (SELECT doc_id, page_no, min(x) AS x1, min(y) AS y1, max(x + width) AS x2, max(y + height) AS y2
  FROM ocr_lines GROUP BY ALL)"""


@query(
    "divide_decks",
    f"""WITH {LINES}, {BODY_BOX}, page AS (SELECT *, (x2 - x1 > (y2 - y1) * 1.15) AND x2 - x1 > 250 AS spread FROM bb),
    single AS (SELECT * FROM ({_deck_sql(3, ['上段本文', '中段本文', '下段本文'])}) SEMI JOIN (SELECT * FROM page WHERE NOT spread) USING (doc_id, page_no)),
    side AS (SELECT doc_id, page_no, s, CASE WHEN s = 0 THEN
               CASE WHEN x1 + (x2 - x1) / 2 <= x1 + (x2 - x1) / 2 THEN x1 ELSE NULL END
               ELSE x1 END AS sx1, CASE WHEN s = 0 THEN x2 ELSE CAST(floor(x1 + (x2 - x1) / 2) AS INT) - 5 END AS sx2, y1, y2, x1
             FROM page, range(2) AS t(s) WHERE spread),
    sb AS (SELECT doc_id, page_no, s, sx1 AS x, greatest(10, sx2 - sx1) AS w, y1, greatest(10, y2 - y1) AS h FROM side),
    cut AS (SELECT *, CAST(floor(h * 0.315) AS INT) AS p FROM sb),
    sp AS (SELECT doc_id, page_no, CAST(s * 3 + k + 1 AS INT) AS region_seq,
             CASE WHEN s = 0 THEN '右' ELSE '左' END || ['上', '中', '下'][k + 1] || '本文' AS name, x,
             CAST(y1 + (p + greatest(2, (h - 3 * p) // 2)) * k AS INT) AS y, w AS width, p AS height FROM cut, range(3) AS t(k))
    SELECT * FROM single UNION ALL SELECT * FROM sp""",
)
def _(spark, sf):
    bodies = (
        X.ocr_lines(spark, sf).groupBy(*PAGE)
        .agg(F.expr("min(x)").alias("x"), F.expr("min(y)").alias("y"), F.expr("max(x + width)").alias("x2"),
             F.expr("max(y + height)").alias("y2"))
        .selectExpr("doc_id", "page_no", "1 AS region_seq", "'本文' AS name", "'body' AS type", "'vertical' AS orientation",
                    "x", "y", "x2 - x AS width", "y2 - y AS height")
    )
    return D.divide_decks(bodies, deck_count=3).drop("type", "orientation")


# --- detections ----------------------------------------------------------------------

def doubled(spark, sf):
    """Each line twice: the second a few pixels off at half the confidence."""
    lines = X.ocr_lines(spark, sf)
    shift = F.col("line_id") % 3
    copies = lines.withColumns(
        {"x": F.col("x") + shift, "y": F.col("y") + shift, "confidence": F.col("confidence") / 2,
         "line_id": F.col("line_id") + 1000000}
    )
    return lines.unionByName(copies)


@query("resolve_duplicate_lines", f"WITH {LINES} SELECT doc_id, page_no, line_id, confidence FROM ocr_lines")
def _(spark, sf):
    return N.resolve_duplicate_lines(doubled(spark, sf)).select(*PAGE, "line_id", "confidence")


# On two-deck pages the left and right piece of a row are one split line when less than
# 80 px lie between them; the stronger piece stays and takes the other in.  Lines are at
# least 30 px long here, so that a box is never upright on a horizontal page or flat on a
# vertical one.
@query(
    "merge_detections",
    f"""WITH {LINES}, d AS (SELECT doc_id, page_no, 2 * line_id AS det_id, x AS x1, y AS y1,
        x + greatest(width, CASE WHEN is_vertical THEN 0 ELSE 30 END) AS x2, y + greatest(height, CASE WHEN is_vertical THEN 30 ELSE 0 END) AS y2,
        greatest(width, CASE WHEN is_vertical THEN 0 ELSE 30 END) AS w, confidence + 0.01 AS conf,
        CASE WHEN doc_id % 2 = 1 THEN (line_id % 30) % 15 ELSE line_id % 30 END AS row,
        CASE WHEN doc_id % 2 = 1 THEN (line_id % 30) // 15 ELSE 0 END AS side FROM ocr_lines),
    p AS (SELECT *, count(*) OVER g AS n, max(x1) OVER g - min(x2) OVER g AS apart, min(w) OVER g AS thin,
            row_number() OVER (PARTITION BY doc_id, page_no, row ORDER BY conf DESC, w DESC, det_id) AS rk
          FROM d WINDOW g AS (PARTITION BY doc_id, page_no, row)),
    k AS (SELECT a.*, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2, b.w AS bw, b.conf AS bconf
          FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.row = b.row AND a.rk = 1 AND b.rk = 2
            AND b.apart < 80 AND a.thin >= 24 WHERE a.rk = 1 OR a.apart >= 80 OR a.thin < 24),
    o AS (SELECT *, bw IS NOT NULL AND bconf >= 0.35 AND (bx1 < x1 - 25 OR bx2 > x2 + 25) AS widen FROM k)
    SELECT doc_id, page_no, det_id, CASE WHEN widen THEN least(x1, bx1) ELSE x1 END AS x1,
      CASE WHEN NOT widen OR w > bw * 1.3 AND NOT bw > w * 1.3 THEN y1 WHEN bw > w * 1.3 THEN by1
           ELSE CAST(round_even((y1 + by1) / 2, 0) AS INT) END AS y1,
      CASE WHEN widen THEN greatest(x2, bx2) ELSE x2 END AS x2,
      CASE WHEN NOT widen OR w > bw * 1.3 AND NOT bw > w * 1.3 THEN y2 WHEN bw > w * 1.3 THEN by2
           ELSE CAST(round_even((y2 + by2) / 2, 0) AS INT) END AS y2
    FROM o""",
)
def _(spark, sf):
    dets = detections(spark, sf).withColumn(
        "confidence", F.expr("CASE WHEN det_id % 2 = 0 THEN confidence + 0.01D ELSE 0.001D END")
    )
    flat = F.expr("NOT doc_id % 4 = 0")
    dets = dets.withColumns(
        {
            "x2": F.when(flat, F.greatest("x2", F.col("x1") + 30)).otherwise(F.col("x2")),
            "y2": F.when(flat, F.col("y2")).otherwise(F.greatest("y2", F.col("y1") + 30)),
        }
    )
    return N.merge_detections(dets).select(*PAGE, "det_id", "x1", "y1", "x2", "y2")


@query(
    "box_overlap_scores",
    f"""WITH {DETS}, p AS (SELECT a.doc_id, a.page_no, a.det_id AS id_a, b.det_id AS id_b,
        CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS DOUBLE) AS s,
        greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) AS aa, greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)) AS ab
        FROM detections a JOIN detections b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.det_id < b.det_id
        WHERE least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1))
    SELECT doc_id, page_no, id_a, id_b, greatest(s / (aa + ab - s), s / least(aa, ab) * 0.85) AS score FROM p""",
)
def _(spark, sf):
    return N.box_overlap_scores(detections(spark, sf))


@query(
    "union_detections",
    f"WITH {DETS} SELECT doc_id, page_no, count(*) AS n FROM detections GROUP BY ALL",
)
def _(spark, sf):
    d = detections(spark, sf)
    both = N.union_detections(d.filter("det_id % 2 = 0"), d.filter("det_id % 2 = 1"))
    return both.groupBy(*PAGE).agg(F.count("*").alias("n"))


@query("reconcile_blocks")
def _(spark, sf):
    dets = detections(spark, sf)
    lines = dets.filter("det_id % 2 = 0")
    blocks = dets.filter("det_id % 10 = 1").withColumn("class_index", F.lit(0))
    pages = dets.groupBy(*PAGE).agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    return N.reconcile_blocks(blocks, lines, pages)

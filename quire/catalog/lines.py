"""Line and block queries."""

from pyspark.sql import functions as F

from quire.catalog.base import SPACE, d_strip, query
from quire.functions.geometry import normalize_region_type, polygon_to_box, line_bucket
from quire.functions.text import is_mostly_latin, is_western
from quire.operators import lines as L
from quire.plans import fixtures as X

LINES = X.lines_sql()


def blocks(spark, sf):
    return X.ocr_lines(spark, sf).selectExpr(
        "doc_id", "page_no", "line_id AS id", "text", "confidence AS score", "x AS x1", "y AS y1",
        "x + width AS x2", "y + height AS y2",
    )


BLOCKS = f"""{LINES},
blocks AS (SELECT doc_id, page_no, line_id AS id, text, confidence AS score, x AS x1, y AS y1,
                  x + width AS x2, y + height AS y2 FROM ocr_lines)"""

_PW = "greatest(1, x2 - x1)"
_PH = "greatest(1, y2 - y1)"
_CATEGORY = f"""CASE
  WHEN length({d_strip('text')}) <= 6 AND regexp_matches(replace(replace({d_strip('text')}, ' ', ''), '　', ''), '^\\p{{Nd}}+$')
    THEN 'page_number'
  WHEN y1 / ph < 0.08 THEN 'header_candidate'
  WHEN y2 / ph > 0.92 THEN 'footer_candidate'
  WHEN {_PH} > {_PW} * 1.5 THEN 'body_vertical_candidate'
  WHEN {_PW} > {_PH} * 1.5 THEN 'horizontal_candidate'
  ELSE 'unknown' END"""


@query("ocr_lines", f"WITH {LINES} SELECT * FROM ocr_lines")
def _(spark, sf):
    return X.ocr_lines(spark, sf)


@query(
    "block_category_counts",
    f"""WITH {BLOCKS},
    sized AS (SELECT *, max(y2) OVER (PARTITION BY doc_id, page_no) AS ph FROM blocks)
    SELECT {_CATEGORY} AS category, count(*) AS n FROM sized GROUP BY 1""",
)
def _(spark, sf):
    return L.classify_blocks(blocks(spark, sf)).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "classify_blocks",
    f"""WITH {BLOCKS},
    sized AS (SELECT *, max(y2) OVER (PARTITION BY doc_id, page_no) AS ph FROM blocks)
    SELECT doc_id, page_no, id, {_CATEGORY} AS category FROM sized""",
)
def _(spark, sf):
    return L.classify_blocks(blocks(spark, sf)).select("doc_id", "page_no", "id", "category")


@query(
    "page_sizes",
    f"WITH {BLOCKS} SELECT doc_id, page_no, max(x2) AS width, max(y2) AS height FROM blocks GROUP BY ALL",
)
def _(spark, sf):
    return L.page_sizes(blocks(spark, sf))


@query(
    "with_orientation",
    f"""WITH {BLOCKS} SELECT doc_id, page_no, id, CASE WHEN {_PH} > {_PW} * 1.5 THEN 'vertical'
        WHEN {_PW} > {_PH} * 1.5 THEN 'horizontal' ELSE 'unknown' END AS orientation FROM blocks""",
)
def _(spark, sf):
    return L.with_orientation(blocks(spark, sf)).select("doc_id", "page_no", "id", "orientation")


@query(
    "polygon_to_box",
    f"""WITH {LINES},
    poly AS (SELECT doc_id, page_no, line_id, x + 0.5 AS px1, y + 0.5 AS py1,
                    x + width + (line_id % 3) * 0.5 AS px2, y + height - 30 * (line_id % 2) + 0.25 AS py2 FROM ocr_lines),
    box AS (SELECT doc_id, page_no, line_id, CAST(round_even(least(px1, px2), 0) AS INT) AS x,
                   CAST(round_even(least(py1, py2), 0) AS INT) AS y,
                   CAST(round_even(abs(px2 - px1), 0) AS INT) AS width,
                   CAST(round_even(abs(py2 - py1), 0) AS INT) AS height FROM poly)
    SELECT * FROM box WHERE width > 0 AND height > 0""",
)
def _(spark, sf):
    poly = X.ocr_lines(spark, sf).selectExpr(
        "doc_id", "page_no", "line_id",
        """array(array(x + 0.5D, y + 0.5D), array(x + 0.5D, y + height - 30 * (line_id % 2) + 0.25D),
           array(x + width + (line_id % 3) * 0.5D, y + 0.5D),
           array(x + width + (line_id % 3) * 0.5D, y + height - 30 * (line_id % 2) + 0.25D)) AS pts""",
    )
    return (
        poly.withColumn("b", polygon_to_box("pts"))
        .filter("b IS NOT NULL")
        .select("doc_id", "page_no", "line_id", "b.x", "b.y", "b.width", "b.height")
    )


_MARKS = "._,-~|''`\"^*:;・+=/\\()[]{}<>"


@query(
    "drop_noise_lines",
    f"""WITH {LINES}, t AS (SELECT *, {d_strip('text')} AS t FROM ocr_lines)
    SELECT doc_id, page_no, line_id FROM t
    WHERE t <> '' AND NOT (length(t) = 1 AND contains('{_MARKS}', t) AND confidence < 0.35)
      AND width >= 8 AND height >= 8 AND NOT (confidence > 0 AND confidence < 0.15)
      AND NOT (confidence = 0 AND length(t) <= 1)""",
)
def _(spark, sf):
    return L.drop_noise_lines(X.ocr_lines(spark, sf)).select("doc_id", "page_no", "line_id")


@query(
    "drop_display_noise",
    f"""WITH {LINES}, t AS (SELECT *, {d_strip('text')} AS t FROM ocr_lines)
    SELECT doc_id, page_no, line_id FROM t
    WHERE t <> '' AND NOT (confidence <= 0.01 AND (length(t) <= 1 OR
      (length(t) <= 3 AND regexp_matches(t, '^[\\p{{P}}{SPACE}~|`^+=<>ー]*$'))))""",
)
def _(spark, sf):
    return L.drop_display_noise(X.ocr_lines(spark, sf)).select("doc_id", "page_no", "line_id")


@query(
    "drop_empty_recognition",
    f"""WITH {LINES} SELECT doc_id, page_no, line_id FROM ocr_lines
    WHERE NOT (confidence = 0 AND length({d_strip('text')}) <= 3)""",
)
def _(spark, sf):
    return L.drop_empty_recognition(X.ocr_lines(spark, sf)).select("doc_id", "page_no", "line_id")


@query(
    "page_direction",
    f"""WITH {LINES} SELECT doc_id, page_no, count(*) FILTER (is_vertical) * 2 >= count(*) AS is_vertical
        FROM ocr_lines GROUP BY ALL""",
)
def _(spark, sf):
    return L.page_direction(X.ocr_lines(spark, sf))


@query(
    "page_direction_strict",
    f"""WITH {BLOCKS}, o AS (SELECT *, CASE WHEN {_PH} > {_PW} * 1.5 THEN 'vertical'
        WHEN {_PW} > {_PH} * 1.5 THEN 'horizontal' ELSE 'unknown' END AS o FROM blocks)
    SELECT doc_id, page_no, count(*) FILTER (o = 'vertical') > count(*) FILTER (o = 'horizontal') AS is_vertical
    FROM o GROUP BY ALL""",
)
def _(spark, sf):
    return L.page_direction(L.with_orientation(blocks(spark, sf)), mode="strict")


DECKS = """e AS (SELECT doc_id, page_no, count(*) AS n, min(y) AS top, max(y + height) AS bottom
        FROM ocr_lines GROUP BY ALL),
    c AS (SELECT l.doc_id, l.page_no, any_value(n) AS n, any_value(bottom - top) AS h,
                 count(*) FILTER (abs(y + height / 2 - (top + (bottom - top) / 2)) < (bottom - top) / 8) AS mid,
                 count(*) FILTER (y + height / 2 < top + (bottom - top) / 2) AS up,
                 count(*) FILTER (y + height / 2 >= top + (bottom - top) / 2) AS down
          FROM ocr_lines l JOIN e USING (doc_id, page_no) GROUP BY ALL),
    decks AS (SELECT doc_id, page_no, CASE WHEN n >= 6 AND h >= 100 AND mid = 0 AND up >= 2 AND down >= 2
        THEN 2 ELSE 1 END AS deck_count FROM c)"""


@query("detect_decks", f"WITH {X.lines_sql(1)}, {DECKS} SELECT * FROM decks")
def _(spark, sf):
    return L.detect_decks(X.ocr_lines(spark, sf, vertical_rest=1))


@query(
    "page_metrics",
    f"""WITH {LINES} SELECT doc_id, page_no, count(*) AS line_count,
        count(*) FILTER (is_vertical) AS vertical_line_count FROM ocr_lines GROUP BY ALL""",
)
def _(spark, sf):
    return L.page_metrics(X.ocr_lines(spark, sf))


def doubled_lines(spark, sf):
    lines = X.ocr_lines(spark, sf)
    again = lines.withColumn("line_id", F.col("line_id") + 1000000)
    return lines.unionByName(again)


@query(
    "dedupe_lines",
    f"""WITH {LINES}, d AS (SELECT * FROM ocr_lines UNION ALL SELECT * REPLACE (line_id + 1000000 AS line_id) FROM ocr_lines)
    SELECT doc_id, page_no, line_id, text FROM (SELECT *, row_number() OVER (
        PARTITION BY doc_id, page_no, text, x, y, width, height, is_vertical ORDER BY line_id) AS rn FROM d)
    WHERE rn = 1""",
)
def _(spark, sf):
    return L.dedupe_lines(doubled_lines(spark, sf)).select("doc_id", "page_no", "line_id", "text")


@query(
    "run_outcomes",
    f"WITH {X.ARRIVALS_SQL} SELECT status, count(*) AS n FROM page_arrivals GROUP BY status",
)
def _(spark, sf):
    return L.run_outcomes(X.page_arrivals(spark, sf))


@query(
    "latin_runaway",
    f"""WITH {LINES} SELECT doc_id, page_no, line_id,
        height >= width * 2 AND regexp_matches(text, '[A-Za-z]{{5,}}') AS flag FROM ocr_lines""",
)
def _(spark, sf):
    return L.latin_runaway(X.ocr_lines(spark, sf)).select("doc_id", "page_no", "line_id", "flag")


@query(
    "script_profile",
    rf"""WITH {LINES}, s AS (SELECT doc_id, page_no, line_id, text,
        length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS total,
        length(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'), '[^\x{{00}}-\x{{FF}}]', '', 'g')) AS latin
        FROM ocr_lines)
    SELECT doc_id, page_no, line_id,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >
          length(regexp_replace(text, '[^\x{{3000}}-\x{{9FFF}}]', '', 'g')) AS is_western,
        total > 0 AND latin >= total * 0.70 AS is_latin FROM s""",
)
def _(spark, sf):
    return X.ocr_lines(spark, sf).select(
        "doc_id", "page_no", "line_id", is_western("text").alias("is_western"),
        is_mostly_latin("text").alias("is_latin"),
    )


# --- detections ----------------------------------------------------------------------

def detections(spark, sf):
    lines = X.ocr_lines(spark, sf).selectExpr(
        "doc_id", "page_no", "2 * line_id AS det_id", "x AS x1", "y AS y1", "x + width AS x2",
        "y + height AS y2", "confidence", "1 AS class_index", "line_id % 3 AS shift",
    )
    copies = lines.selectExpr(
        "doc_id", "page_no", "det_id + 1 AS det_id", "x1 + shift AS x1", "y1 + shift AS y1",
        "x2 + shift AS x2", "y2 + shift AS y2", "confidence / 2 AS confidence", "class_index", "shift",
    )
    return lines.unionByName(copies).drop("shift")


DETS = f"""{LINES},
_d AS (SELECT doc_id, page_no, 2 * line_id AS det_id, x AS x1, y AS y1, x + width AS x2, y + height AS y2,
              confidence, 1 AS class_index, line_id % 3 AS s FROM ocr_lines),
detections AS (SELECT doc_id, page_no, det_id, x1, y1, x2, y2, confidence, class_index FROM _d
  UNION ALL SELECT doc_id, page_no, det_id + 1, x1 + s, y1 + s, x2 + s, y2 + s, confidence / 2, class_index FROM _d)"""


@query(
    "filter_detections",
    f"""WITH {DETS} SELECT doc_id, page_no, det_id FROM detections
    WHERE confidence >= 0.15 AND NOT (x2 - x1 > 120 AND y2 - y1 > 120)""",
)
def _(spark, sf):
    return L.filter_detections(detections(spark, sf)).select("doc_id", "page_no", "det_id")


def scanned_pages(spark, sf):
    return X.table(spark, sf, "documents").selectExpr(
        "doc_id", "1 AS page_no", "CAST(1000 + n_chars % 1500 AS INT) AS width",
        "CAST(1000 + (n_chars * 7) % 1500 AS INT) AS height",
    )


PAGES = """scanned AS (SELECT doc_id, 1 AS page_no, CAST(1000 + n_chars % 1500 AS INT) AS width,
  CAST(1000 + (n_chars * 7) % 1500 AS INT) AS height FROM documents)"""
TILES = f"""{PAGES},
_m AS (SELECT *, CAST(floor(width * 0.15) AS INT) AS ox, CAST(floor(height * 0.15) AS INT) AS oy,
              width // 2 AS mx, height // 2 AS my, width > 1600 AS wide, height > 1600 AS tall FROM scanned),
tiles AS (
  SELECT doc_id, page_no, CAST((CASE WHEN wide THEN 2 ELSE 1 END) * r + c AS INT) AS tile_no,
         CASE WHEN wide AND c = 1 THEN mx - ox ELSE 0 END AS x1,
         CASE WHEN tall AND r = 1 THEN my - oy ELSE 0 END AS y1,
         CASE WHEN wide AND c = 0 THEN mx + ox ELSE width END AS x2,
         CASE WHEN tall AND r = 0 THEN my + oy ELSE height END AS y2
  FROM _m, range(2) AS a(r), range(2) AS b(c)
  WHERE (wide OR tall) AND (tall OR r = 0) AND (wide OR c = 0))"""


@query("plan_tiles", f"WITH {TILES} SELECT * FROM tiles")
def _(spark, sf):
    return L.plan_tiles(scanned_pages(spark, sf))


@query(
    "offset_tile_boxes",
    f"""WITH {TILES} SELECT doc_id, page_no, tile_no, k AS det_id, x1 + 10 * k AS x1, y1 + 7 * k AS y1,
        x1 + 10 * k + 90 AS x2, y1 + 7 * k + 20 AS y2 FROM tiles, range(3) AS t(k)""",
)
def _(spark, sf):
    tiles = L.plan_tiles(scanned_pages(spark, sf))
    dets = tiles.select("doc_id", "page_no", "tile_no", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("det_id"))
    dets = dets.selectExpr(
        "doc_id", "page_no", "tile_no", "CAST(det_id AS BIGINT) AS det_id", "10 * det_id AS x1", "7 * det_id AS y1",
        "10 * det_id + 90 AS x2", "7 * det_id + 20 AS y2",
    )
    return L.offset_tile_boxes(dets, tiles)


@query(
    "merge_spread_halves",
    f"""WITH {LINES}, half AS (SELECT doc_id, page_no, max(x + width) // 2 AS split_x FROM ocr_lines GROUP BY ALL)
    SELECT doc_id, page_no, line_id, 'l' AS side, x FROM ocr_lines
    UNION ALL SELECT doc_id, page_no, line_id, 'r', x + split_x FROM ocr_lines JOIN half USING (doc_id, page_no)""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    split = lines.groupBy("doc_id", "page_no").agg(F.expr("max(x + width) DIV 2").alias("split_x"))
    left, right = (lines.withColumn("side", F.lit(s)) for s in "lr")
    return L.merge_spread_halves(left, right, split).select("doc_id", "page_no", "line_id", "side", "x")


@query(
    "route_lines",
    rf"""WITH {LINES}, s AS (SELECT *, greatest(width, height) AS m, least(width, height) AS c, line_id % 4 AS p,
        length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS total,
        length(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'), '[^\x{{00}}-\x{{FF}}]', '', 'g')) AS latin
        FROM ocr_lines),
    t AS (SELECT *, CASE WHEN m >= 350 OR m >= c * 6 THEN 100 WHEN p = 3 AND m < 250 THEN 30
                         WHEN p = 2 AND m < 350 THEN 50 ELSE 100 END AS tier FROM s)
    SELECT doc_id, page_no, line_id, tier, CASE WHEN tier = 30 THEN length(text) >= 20 OR (total > 0 AND latin >= total * 0.7)
        WHEN tier = 50 THEN length(text) >= 38 OR (total > 0 AND latin >= total * 0.7) ELSE false END AS escalate FROM t""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf).withColumn("pred_char_count", F.expr("line_id % 4"))
    return L.route_lines(lines).select("doc_id", "page_no", "line_id", "tier", "escalate")


@query(
    "transform_boxes_back",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_no, line_id, k,
        CASE WHEN k IN (0, 3) THEN x ELSE x + width END AS px, CASE WHEN k < 2 THEN y ELSE y + height END AS py
        FROM ocr_lines, range(4) AS t(k)),
    q AS (SELECT *, py + CASE WHEN doc_id % 2 = 0 THEN (least(px, 1199) % 7) * 0.5 ELSE 0 END AS dy FROM p),
    r AS (SELECT doc_id, page_no, line_id, CAST(round_even(greatest(0, least(px + 0.25 * dy + 2.5, 1300)), 0) AS INT) AS rx,
                 CAST(round_even(greatest(0, least(dy - 3.25, 1000)), 0) AS INT) AS ry FROM q)
    SELECT doc_id, page_no, line_id, min(rx) AS x, min(ry) AS y, greatest(1, max(rx) - min(rx)) AS width,
           greatest(1, max(ry) - min(ry)) AS height FROM r GROUP BY ALL""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    transforms = lines.select("doc_id", "page_no").distinct().selectExpr(
        "doc_id", "page_no",
        "CASE WHEN doc_id % 2 = 0 THEN transform(sequence(0, 1199), i -> (i % 7) * 0.5D) END AS disp_y",
        "CAST(NULL AS ARRAY<DOUBLE>) AS disp_x",
        "array(1.0D, 0.25D, 2.5D, 0.0D, 1.0D, -3.25D) AS m_inv", "1300 AS orig_width", "1000 AS orig_height",
    )
    return L.transform_boxes_back(lines, transforms).select(
        "doc_id", "page_no", "line_id", "x", "y", "width", "height"
    )


# --- page sets -----------------------------------------------------------------------

@query(
    "expand_page_ranges",
    """WITH r AS (SELECT o_orderkey AS doc_id, o_custkey % 30 + 1 AS a, o_orderkey % 30 + 1 AS b, o_custkey % 50 AS c FROM orders),
    s AS (SELECT doc_id, unnest(range(greatest(1, least(a, b)), least(40, greatest(a, b)) + 1)) AS page_no FROM r
          UNION ALL SELECT doc_id, c FROM r WHERE c BETWEEN 1 AND 40
          UNION ALL SELECT doc_id, unnest(range(38, 41)) FROM r)
    SELECT DISTINCT doc_id, CAST(page_no AS INT) AS page_no FROM s""",
)
def _(spark, sf):
    exprs = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id",
        "concat(o_custkey % 30 + 1, '-', o_orderkey % 30 + 1, ', ', o_custkey % 50, '、38~99, x-3, 4-5-6') AS expr",
    )
    return L.expand_page_ranges(exprs, "expr", 1, 40)


@query(
    "select_pages",
    f"""WITH {X.ARRIVALS_SQL}, p AS (SELECT DISTINCT doc_id, page_no FROM page_arrivals)
    SELECT 'odd' AS mode, doc_id, page_no FROM p WHERE page_no % 2 = 1 AND page_no <> 3
    UNION ALL SELECT 'from_current', doc_id, page_no FROM p WHERE page_no > 3
    UNION ALL SELECT 'batch', doc_id, page_no FROM p WHERE page_no BETWEEN 5 AND 9
    UNION ALL SELECT 'modified', doc_id, page_no FROM p SEMI JOIN
      (SELECT doc_id, page_no FROM page_arrivals WHERE status = 'click') USING (doc_id, page_no)""",
)
def _(spark, sf):
    arrivals = X.page_arrivals(spark, sf)
    p = arrivals.select("doc_id", "page_no").distinct()
    picks = {
        "odd": L.select_pages(p, "odd", current=3, exclude_current=True),
        "from_current": L.select_pages(p, "from_current", current=3),
        "batch": L.select_pages(p, "batch", first=9, last=5),
        "modified": L.select_pages(p, "modified", modified=arrivals.filter("status = 'click'")),
    }
    out = None
    for mode, pages in picks.items():
        part = pages.select(F.lit(mode).alias("mode"), "doc_id", "page_no")
        out = part if out is None else out.unionByName(part)
    return out


GRID_PAGES = "pg AS (SELECT doc_id, page_no, 800 AS width, 100 + height AS height FROM grid_regions)"


@query(
    "ruling_candidates",
    f"""WITH {X.GRID_SQL}, {GRID_PAGES}
    SELECT doc_id, page_no, 'canonical' AS mode, orient, ord FROM grid_segments JOIN pg USING (doc_id, page_no)
    WHERE length >= CASE WHEN orient = 'h' THEN greatest(30, width * 0.25) ELSE greatest(20, pg.height * 0.15) END
    UNION ALL SELECT doc_id, page_no, 'strict', orient, ord FROM grid_segments JOIN pg USING (doc_id, page_no)
    WHERE length >= CASE WHEN orient = 'h' THEN width * 0.6 ELSE pg.height * 0.4 END""",
)
def _(spark, sf):
    seg = X.grid_segments(spark, sf)
    pages = X.grid_regions(spark, sf).selectExpr("doc_id", "page_no", "800 AS width", "100 + height AS height")
    parts = [
        L.ruling_candidates(seg, pages, mode).select(
            "doc_id", "page_no", F.lit(mode).alias("mode"), "orient", "ord"
        )
        for mode in ("canonical", "strict")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "normalize_region_type",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'body' WHEN p_partkey % 6 = 1 THEN 'heading'
        WHEN p_partkey % 6 = 2 THEN 'footnote' WHEN p_partkey % 6 = 3 THEN 'table' WHEN p_partkey % 6 = 4 THEN 'image'
        ELSE lower(p_brand) END AS type FROM part""",
)
def _(spark, sf):
    named = X.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 6 WHEN 0 THEN ' Text ' WHEN 1 THEN '見出し' WHEN 2 THEN '注釈' WHEN 3 THEN 'TABULAR'"
        " WHEN 4 THEN 'イラスト' ELSE p_brand END AS t",
    )
    return named.select("p_partkey", normalize_region_type("t").alias("type"))


@query(
    "line_bucket",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'footnote' WHEN 2 THEN 'footnote'
        ELSE 'body' END AS bucket FROM part""",
)
def _(spark, sf):
    named = X.table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE p_partkey % 4 WHEN 0 THEN '大見出し' WHEN 1 THEN '頭注' WHEN 2 THEN 'キャプション' ELSE p_brand END AS t",
    )
    return named.select("p_partkey", line_bucket("t").alias("bucket"))

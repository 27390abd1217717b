"""Table grid queries."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import query
from quire.operators import grid as G
from quire.operators import tables as T
from quire.plans import fixtures as X

GRID = X.GRID_SQL


# --- extraction ------------------------------------------------------------------------

@query(
    "infer_column_gaps",
    f"""WITH {GRID} SELECT doc_id, page_no, 1 AS table_seq, CAST(p AS INT) AS pos FROM grid_regions, (VALUES (235), (385), (535)) AS v(p)
    WHERE n_rows >= 2""",
)
def _(spark, sf):
    tables = X.grid_regions(spark, sf).withColumnRenamed("region_seq", "table_seq")
    return T.infer_column_gaps(X.grid_lines(spark, sf), tables)


def ruled_tables(spark, sf):
    """Both kinds of rules, horizontal ones only, or vertical ones only, by document."""
    seg = X.grid_segments(spark, sf).selectExpr(
        "doc_id", "page_no", "named_struct('is_vertical', orient = 'v', 'pos', pos, 'start', start, 'end', end) AS r"
    ).filter("doc_id % 3 = 0 OR (doc_id % 3 = 1 AND NOT r.is_vertical) OR (doc_id % 3 = 2 AND r.is_vertical)")
    rules = seg.groupBy(*PAGE).agg(F.collect_list("r").alias("rule_lines"))
    return X.grid_regions(spark, sf).join(rules, PAGE, "left")


@query(
    "extract_tables",
    f"""WITH {GRID} SELECT doc_id, page_no, '表1' AS table_name, row_no AS row_index,
      CASE WHEN doc_id % 3 = 1 AND n_rows = 1 THEN array_to_string(cells, ' ') ELSE array_to_string(cells, '|') END AS cells
    FROM grid_rows JOIN grid_regions USING (doc_id, page_no)""",
)
def _(spark, sf):
    out = T.extract_tables(X.grid_lines(spark, sf), ruled_tables(spark, sf), ruled_tables(spark, sf).limit(0))
    return out.select(*PAGE, "table_name", "row_index", F.array_join("cells", "|").alias("cells"))


@query("split_lines_at_rules")
def _(spark, sf):
    lines = X.ocr_lines(spark, sf).withColumn("rules", F.array(F.lit(200), F.lit(330)))
    return T.split_lines_at_rules(lines).select(*PAGE, "line_id", "piece_no", "text", "x", "width")


@query(
    "join_cell_text",
    f"""WITH {GRID} SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY y, x) AS text FROM grid_lines GROUP BY ALL""",
)
def _(spark, sf):
    return T.join_cell_text(X.grid_lines(spark, sf), PAGE)


# --- cell edits ------------------------------------------------------------------------

def cells(spark, sf):
    """Grid cells, every third one blank."""
    return X.grid_cells(spark, sf).selectExpr(
        "doc_id", "page_no", "region_seq AS table_seq", "row_no", "col_no",
        "CASE WHEN (row_no * 2 + col_no + doc_id) % 3 = 0 THEN ' ' ELSE text END AS text",
    )


CELLS = f"""{GRID}, cells AS (SELECT doc_id, page_no, region_seq AS table_seq, row_no, col_no,
  CASE WHEN (row_no * 2 + col_no + doc_id) % 3 = 0 THEN ' ' ELSE text END AS text FROM grid_cells)"""


def old_spans(spark, sf):
    return cells(spark, sf).filter("row_no = 2 AND col_no = 2 AND doc_id % 2 = 0").selectExpr(
        "doc_id", "page_no", "table_seq", "2 AS start_row", "2 AS start_col", "1 AS row_span", "2 AS col_span",
        "'old' AS merged_text", "map('2,2', 'left', '3,2', 'right') AS originals",
    )


@query(
    "auto_merge_blanks",
    f"""WITH {CELLS}, t AS (SELECT *, trim(text) <> '' AS val, row_no = 2 AND col_no IN (2, 3) AND doc_id % 2 = 0 AS in_span FROM cells),
    r AS (SELECT *, sum(CASE WHEN val OR in_span THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, row_no ORDER BY col_no) AS run FROM t)
    SELECT doc_id, page_no, table_seq, row_no AS start_row, CAST(min(col_no) AS INT) AS start_col, CAST(count(*) AS INT) AS col_span,
      arg_min(trim(text), col_no) AS merged_text FROM r WHERE run > 0 GROUP BY doc_id, page_no, table_seq, row_no, run
    HAVING count(*) > 1 AND arg_min(val AND NOT in_span, col_no)""",
)
def _(spark, sf):
    out = G.auto_merge_blanks(cells(spark, sf), old_spans(spark, sf))
    return out.select(*PAGE, "table_seq", "start_row", "start_col", "col_span", "merged_text")


def new_spans(spark, sf):
    return X.grid_regions(spark, sf).selectExpr(
        "doc_id", "page_no", "1 AS table_seq", "1 AS start_row", "2 AS start_col", "least(2, n_rows) AS row_span", "2 AS col_span"
    )


MERGED = f"""{CELLS}, m AS (SELECT doc_id, string_agg(trim(text), ' ' ORDER BY row_no, col_no) AS mt FROM cells
    WHERE row_no <= 2 AND col_no IN (2, 3) AND trim(text) <> '' GROUP BY doc_id),
  merged AS (SELECT c.doc_id, page_no, table_seq, row_no, col_no, CASE WHEN row_no = 1 AND col_no = 2 THEN coalesce(mt, '')
    WHEN row_no <= 2 AND col_no IN (2, 3) THEN '' ELSE text END AS text FROM cells c LEFT JOIN m USING (doc_id))"""


@query("apply_merges", f"WITH {MERGED} SELECT * FROM merged")
def _(spark, sf):
    return G.apply_merges(cells(spark, sf), new_spans(spark, sf))[0]


@query(
    "apply_merges_spans",
    f"""WITH {MERGED} SELECT doc_id, 1 AS start_row, row_span, coalesce(mt, '') AS merged_text FROM
      (SELECT doc_id, least(2, n_rows) AS row_span FROM grid_regions) LEFT JOIN m USING (doc_id)""",
)
def _(spark, sf):
    # The old span at (2, 2) touches every new one and goes.
    out = G.apply_merges(cells(spark, sf), new_spans(spark, sf), old_spans(spark, sf))[1]
    return out.select("doc_id", "start_row", "row_span", "merged_text")


@query(
    "undo_merges",
    f"""WITH {MERGED} SELECT c.doc_id, c.page_no, c.table_seq, c.row_no, c.col_no, CASE WHEN c.doc_id % 2 = 0 THEN c.text ELSE m.text END AS text
    FROM cells c JOIN merged m USING (doc_id, row_no, col_no)""",
)
def _(spark, sf):
    merged, spans = G.apply_merges(cells(spark, sf), new_spans(spark, sf))
    selection = X.grid_regions(spark, sf).filter("doc_id % 2 = 0").selectExpr(
        "doc_id", "page_no", "1 AS table_seq", "1 AS row_no", "3 AS col_no"
    )
    return G.undo_merges(merged, spans, selection)[0]


@query(
    "shift_cells",
    f"""WITH {CELLS}, e AS (SELECT doc_id, row_no, trim(text) AS t FROM cells WHERE col_no = 4 AND row_no % 2 = 1 AND trim(text) <> ''),
    f AS (SELECT doc_id, row_no, trim(text) AS t FROM cells WHERE col_no = 2 AND row_no % 2 = 0 AND trim(text) <> '')
    SELECT 'right' AS dir, doc_id, page_no, table_seq, row_no, col_no, CASE WHEN col_no = 4 AND e.t IS NOT NULL THEN '' ELSE text END AS text
      FROM cells LEFT JOIN e USING (doc_id, row_no)
    UNION ALL SELECT 'right', doc_id, 1, 1, row_no, 5, t FROM e
    UNION ALL SELECT 'left', doc_id, page_no, table_seq, row_no, col_no, CASE WHEN f.t IS NULL OR col_no > 2 THEN text WHEN col_no = 2 THEN ''
      WHEN trim(text) = '' THEN f.t ELSE trim(text) || ' ' || f.t END FROM cells LEFT JOIN f USING (doc_id, row_no)""",
)
def _(spark, sf):
    grid = cells(spark, sf)
    right = G.shift_cells(grid, grid.filter("col_no = 4 AND row_no % 2 = 1"), "right")
    left = G.shift_cells(grid, grid.filter("col_no = 2 AND row_no % 2 = 0"), "left")
    return right.select(F.lit("right").alias("dir"), "*").unionByName(left.select(F.lit("left").alias("dir"), "*"))


@query(
    "split_cells",
    f"""WITH {CELLS} SELECT doc_id, page_no, table_seq, row_no, col_no, CASE
        WHEN col_no = 2 AND row_no % 2 = 1 THEN CASE WHEN row_no % 3 = 0 THEN text || '）' ELSE text || 'a b' END
        WHEN col_no = 2 THEN text || 'a b'
        WHEN col_no = 3 AND row_no % 2 = 1 THEN CASE WHEN row_no % 3 = 0 THEN 'x y' ELSE 'cccccccccccc' END || CASE WHEN trim(text) = '' THEN '' ELSE ' ' || trim(text) END
        ELSE text END AS text FROM (SELECT * REPLACE (CASE WHEN col_no = 2 THEN '12' ELSE text END AS text) FROM cells)""",
)
def _(spark, sf):
    grid = cells(spark, sf).withColumn(
        "text",
        F.expr(
            """CASE WHEN col_no <> 2 THEN text WHEN row_no % 2 = 0 THEN '12a b'
                 WHEN row_no % 3 = 0 THEN '12） x y' ELSE '12a b cccccccccccc' END"""
        ),
    )
    return G.split_cells(grid, grid.filter("col_no = 2 AND row_no % 2 = 1"))


def paired_spans(grid):
    """Columns 1-2 and 3-4 merged in two rows of three, from odd rows on over two rows."""
    return grid.filter("col_no IN (1, 3) AND row_no % 3 <> 0").selectExpr(
        "doc_id", "page_no", "table_seq", "row_no AS start_row", "col_no AS start_col", "CAST(1 + row_no % 2 AS INT) AS row_span",
        "2 AS col_span", "text AS merged_text", "map(concat(col_no, ',', row_no), text) AS originals",
    )


_SPANS = """sp AS (SELECT doc_id, page_no, row_no AS start_row, col_no AS start_col, CAST(1 + row_no % 2 AS INT) AS row_span, text AS merged_text
      FROM cells WHERE col_no IN (1, 3) AND row_no % 3 <> 0)"""


def _untouched(direction: str, edited: str, start_col: int) -> str:
    return f"""SELECT '{direction}' AS dir, * FROM sp WHERE start_col <> {start_col} OR NOT EXISTS (SELECT 1 FROM cells c
      WHERE c.doc_id = sp.doc_id AND c.row_no >= sp.start_row AND c.row_no < sp.start_row + sp.row_span AND {edited} AND trim(c.text) <> '')"""


@query(
    "shift_cells_spans",
    f"""WITH {CELLS}, {_SPANS} {_untouched('right', 'c.col_no = 4 AND c.row_no % 2 = 1', 3)}
    UNION ALL {_untouched('left', 'c.col_no = 2 AND c.row_no % 2 = 0', 1)}""",
)
def _(spark, sf):
    grid = cells(spark, sf)
    spans = paired_spans(grid)
    right = G.shift_cells(grid, grid.filter("col_no = 4 AND row_no % 2 = 1"), "right", spans)[1]
    left = G.shift_cells(grid, grid.filter("col_no = 2 AND row_no % 2 = 0"), "left", spans)[1]
    both = right.select(F.lit("right").alias("dir"), "*").unionByName(left.select(F.lit("left").alias("dir"), "*"))
    return both.select("dir", *PAGE, "start_row", "start_col", "row_span", "merged_text")


@query(
    "split_cells_spans",
    # Splits write to columns 2 and 3 of every odd row, so both spans of such rows go.
    f"WITH {CELLS}, {_SPANS} SELECT * FROM sp WHERE start_row % 2 = 0",
)
def _(spark, sf):
    grid = cells(spark, sf)
    dressed = grid.withColumn("text", F.expr("CASE WHEN col_no = 2 THEN '12a b cccccccccccc' ELSE text END"))
    out = G.split_cells(dressed, dressed.filter("col_no = 2 AND row_no % 2 = 1"), paired_spans(grid))[1]
    return out.select(*PAGE, "start_row", "start_col", "row_span", "merged_text")


# --- whole tables ----------------------------------------------------------------------

def book_rows(spark, sf):
    """Four orders to a document, one table to a page, each with a header row and a ragged end."""
    rows = X.grid_rows(spark, sf).selectExpr(
        "doc_id DIV 4 AS doc_id", "CAST(doc_id % 4 + 1 AS INT) AS page_no", "concat('表', doc_id % 4) AS table_name", "row_no",
        "CASE WHEN doc_id % 4 = 2 THEN concat(cells, array('', ' ')) ELSE cells END AS cells",
    )
    # The first row brings the header along, so the lines are numbered once.
    head = """CASE WHEN page_no = 3 THEN array('PART', 'supp', 'x', 'y') WHEN page_no = 4 THEN array('a', 'b', '', 'd')
        ELSE array('part', 'Supp', 'qty', 'cents') END"""
    both = f"""inline(filter(array(struct(row_no + 1 AS row_index, cells),
        CASE WHEN row_no = 1 THEN struct(1 AS row_index, {head} AS cells) END), r -> r IS NOT NULL))"""
    return rows.selectExpr("doc_id", "page_no", "table_name", both)


BOOK = f"""{GRID}, br AS (SELECT doc_id // 4 AS doc_id, CAST(doc_id % 4 + 1 AS INT) AS page_no, '表' || (doc_id % 4) AS table_name,
    row_no + 1 AS row_index, CASE WHEN doc_id % 4 = 2 THEN cells || ['', ' '] ELSE cells END AS cells FROM grid_rows),
  book AS (SELECT * FROM br UNION ALL SELECT doc_id, page_no, table_name, 1, CASE WHEN page_no = 3 THEN ['PART', 'supp', 'x', 'y']
    WHEN page_no = 4 THEN ['a', 'b', '', 'd'] ELSE ['part', 'Supp', 'qty', 'cents'] END FROM br WHERE row_index = 2)"""


@query("effective_columns", f"WITH {BOOK} SELECT DISTINCT doc_id, page_no, table_name, 4 AS n FROM book")
def _(spark, sf):
    return G.effective_columns(book_rows(spark, sf))


def flat_grid(spark, sf):
    return G.tables_to_grid(book_rows(spark, sf))


FLAT = f"""{BOOK}, wide AS (SELECT doc_id, max(len(cells)) AS w FROM book GROUP BY doc_id),
  flat AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, table_name, row_index) AS INT) AS grid_row, page_no,
    table_name, row_index, [coalesce(cells[i], '') FOR i IN range(1, w + 1)] AS cells FROM book JOIN wide USING (doc_id))"""


@query(
    "tables_to_grid",
    f"WITH {FLAT} SELECT doc_id, grid_row, page_no, table_name, row_index, array_to_string(cells, '|') AS cells FROM flat",
)
def _(spark, sf):
    return flat_grid(spark, sf).withColumn("cells", F.array_join("cells", "|"))


@query(
    "table_catalog",
    f"""WITH {FLAT} SELECT doc_id, page_no, table_name, min(grid_row) AS start_row, CAST(count(*) AS INT) AS rows, 4 AS columns
    FROM flat GROUP BY ALL""",
)
def _(spark, sf):
    return G.table_catalog(flat_grid(spark, sf))


@query(
    "grid_to_tables",
    f"WITH {BOOK} SELECT doc_id, page_no, table_name, CAST(row_index AS INT) AS row_index, array_to_string(cells[1:4], '|') AS cells FROM book",
)
def _(spark, sf):
    grid = flat_grid(spark, sf)
    none = grid.selectExpr(
        "doc_id", "grid_row AS start_row", "3 AS start_col", "2 AS row_span", "9 AS col_span", "'m' AS merged_text"
    )
    out = G.grid_to_tables(grid, none.filter("start_row = 1"))[0]
    return out.withColumn("cells", F.array_join("cells", "|"))


@query(
    "grid_to_tables_spans",
    f"""WITH {FLAT}, f AS (SELECT doc_id, page_no, table_name, min(grid_row) AS fr, count(*) AS n FROM flat GROUP BY ALL)
    SELECT doc_id, page_no, table_name, CAST(grid_row - fr + 1 AS INT) AS start_row, 3 AS start_col,
      CAST(least(2, n - (grid_row - fr)) AS INT) AS row_span, 2 AS col_span FROM flat JOIN f USING (doc_id, page_no, table_name)""",
)
def _(spark, sf):
    grid = flat_grid(spark, sf)
    spans = grid.selectExpr("doc_id", "grid_row AS start_row", "3 AS start_col", "2 AS row_span", "9 AS col_span", "'m' AS merged_text")
    return G.grid_to_tables(grid, spans)[1].drop("merged_text")


@query(
    "duplicate_headers",
    f"""WITH {BOOK}, h AS (SELECT * FROM book WHERE row_index = 1), l AS (SELECT doc_id, min(page_no) AS p1 FROM h GROUP BY doc_id),
    z AS (SELECT h.doc_id, h.page_no, h.table_name, f.cells AS a, h.cells AS b FROM h JOIN l USING (doc_id) JOIN h f ON f.doc_id = h.doc_id AND f.page_no = p1
          WHERE h.page_no <> p1)
    SELECT doc_id, page_no, table_name, len([i FOR i IN range(1, 5) IF lower(a[i]) = lower(b[i]) AND a[i] <> '']) * 2 >=
      len([i FOR i IN range(1, 5) IF a[i] <> '' AND b[i] <> '']) AS is_duplicate FROM z""",
)
def _(spark, sf):
    return G.duplicate_headers(book_rows(spark, sf))


def spec(spark, sf):
    return book_rows(spark, sf).filter("row_index = 1").selectExpr(
        "doc_id", "1 AS group_no", "page_no AS member_no", "page_no", "table_name", "'joined' AS new_name"
    )


DUP = f"""{BOOK}, h AS (SELECT * FROM book WHERE row_index = 1), l AS (SELECT doc_id, min(page_no) AS p1 FROM h GROUP BY doc_id),
  d AS (SELECT h.doc_id, h.page_no, p1, h.page_no <> p1 AND len([i FOR i IN range(1, 5) IF lower(f.cells[i]) = lower(h.cells[i]) AND f.cells[i] <> '']) * 2 >=
      len([i FOR i IN range(1, 5) IF f.cells[i] <> '' AND h.cells[i] <> '']) AS dup FROM h JOIN l USING (doc_id)
      JOIN h f ON f.doc_id = h.doc_id AND f.page_no = p1),
  t AS (SELECT b.*, dup, p1, count(*) OVER (PARTITION BY b.doc_id, b.page_no) AS n FROM book b JOIN d USING (doc_id, page_no))"""


@query(
    "concat_tables_vertical",
    f"""WITH {DUP} SELECT doc_id, 1 AS group_no, page_no, 'joined' AS table_name,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_index) AS INT) AS row_index, array_to_string(cells[1:4], '|') AS cells
    FROM t WHERE NOT (dup AND n > 1 AND row_index = 1)""",
)
def _(spark, sf):
    out = G.concat_tables(book_rows(spark, sf), spec(spark, sf))
    return out.withColumn("cells", F.array_join("cells", "|"))


@query(
    "concat_tables_horizontal",
    f"""WITH {BOOK}, p AS (SELECT DISTINCT doc_id, page_no FROM book), r AS (SELECT DISTINCT doc_id, row_index FROM book),
    f AS (SELECT doc_id, row_index, page_no, coalesce(array_to_string(cells[1:4], '|'), '|||') AS c FROM r JOIN p USING (doc_id)
          LEFT JOIN book USING (doc_id, row_index, page_no))
    SELECT doc_id, 1 AS group_no, min(page_no) AS page_no, 'joined' AS table_name, CAST(row_index AS INT) AS row_index,
      string_agg(c, '|' ORDER BY page_no) AS cells FROM f GROUP BY doc_id, row_index""",
)
def _(spark, sf):
    out = G.concat_tables(book_rows(spark, sf), spec(spark, sf), direction="horizontal")
    return out.withColumn("cells", F.array_join("cells", "|"))


@query(
    "concat_tables_spans",
    f"""WITH {DUP}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, row_index) AS INT) AS pos FROM t
      WHERE NOT (dup AND n > 1 AND row_index = 1))
    SELECT doc_id, 'joined' AS table_name, pos AS start_row, 2 AS start_col FROM o""",
)
def _(spark, sf):
    rows = book_rows(spark, sf)
    spans = rows.selectExpr(
        "doc_id", "page_no", "table_name", "row_index AS start_row", "2 AS start_col", "1 AS row_span", "2 AS col_span", "'m' AS merged_text"
    )
    return G.concat_tables(rows, spec(spark, sf), spans=spans)[1].select("doc_id", "table_name", "start_row", "start_col")


@query(
    "edit_grid",
    f"""WITH {BOOK}, s AS (SELECT doc_id, page_no, table_name, count(*) AS n, max(len(cells)) AS w FROM book GROUP BY ALL),
    g AS (SELECT *, greatest(1, CASE page_no WHEN 1 THEN n + 2 WHEN 2 THEN n - 3 ELSE n END) AS n2,
            greatest(1, CASE page_no WHEN 1 THEN w + 1 WHEN 2 THEN w - 9 ELSE w END) AS w2 FROM s),
    r AS (SELECT g.*, unnest(range(1, n2 + 1)) AS row_index FROM g)
    SELECT r.doc_id, r.page_no, r.table_name, CAST(r.row_index AS INT) AS row_index,
      array_to_string([coalesce(b.cells[i], '') FOR i IN range(1, w2 + 1)], '|') AS cells
    FROM r LEFT JOIN book b USING (doc_id, page_no, table_name, row_index)""",
)
def _(spark, sf):
    rows = book_rows(spark, sf)
    edits = rows.filter("row_index = 1 AND page_no <= 2").selectExpr(
        "doc_id", "page_no", "table_name", "CASE WHEN page_no = 1 THEN 2 ELSE 0 END AS add_rows",
        "CASE WHEN page_no = 2 THEN 3 ELSE 0 END AS delete_rows", "CASE WHEN page_no = 1 THEN 1 ELSE 0 END AS add_columns",
        "CASE WHEN page_no = 2 THEN 9 ELSE 0 END AS delete_columns",
    )
    return G.edit_grid(rows, edits).withColumn("cells", F.array_join("cells", "|"))


@query(
    "export_tables_tsv",
    f"""WITH {BOOK} SELECT doc_id, page_no, table_name, CAST(row_index AS INT) AS row_index, array_to_string(
        CASE WHEN row_index = 1 THEN ['merged' , ''] || cells[3:] WHEN row_index = 2 THEN ['', ''] || cells[3:] ELSE cells END, chr(9)) AS line
    FROM (SELECT * REPLACE (CASE WHEN row_index = 1 THEN [' '] || cells[2:] ELSE cells END AS cells) FROM book)""",
)
def _(spark, sf):
    rows = book_rows(spark, sf).withColumn(
        "cells", F.expr("CASE WHEN row_index = 1 THEN concat(array(' '), slice(cells, 2, size(cells) - 1)) ELSE cells END")
    )
    spans = rows.filter("row_index = 1").selectExpr(
        "doc_id", "page_no", "table_name", "1 AS start_row", "1 AS start_col", "2 AS row_span", "2 AS col_span", "'merged' AS merged_text"
    )
    return G.export_tables(rows, spans)


@query(
    "export_tables_html",
    f"""WITH {BOOK} SELECT doc_id, page_no, table_name, CAST(row_index AS INT) AS row_index, '<tr>' || CASE
        WHEN row_index = 1 THEN '<td colspan="2" rowspan="2">' || cells[1] || '</td>' || list_reduce([('<td>' || c || '</td>') FOR c IN cells[3:]], lambda a, b: a || b)
        WHEN row_index = 2 THEN list_reduce([('<td>' || c || '</td>') FOR c IN cells[3:]], lambda a, b: a || b)
        ELSE list_reduce([('<td>' || c || '</td>') FOR c IN cells], lambda a, b: a || b) END || '</tr>' AS line FROM book""",
)
def _(spark, sf):
    rows = book_rows(spark, sf)
    spans = rows.filter("row_index = 1").selectExpr(
        "doc_id", "page_no", "table_name", "1 AS start_row", "1 AS start_col", "2 AS row_span", "2 AS col_span", "'merged' AS merged_text"
    )
    return G.export_tables(rows, spans, "html")

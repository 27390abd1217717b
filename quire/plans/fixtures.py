"""Page tables derived from the driver's parquet tables, and the same in DuckDB SQL.

``documents`` give page lines, ``lineitem`` gives table grids, ``events`` give
page arrivals.  Each Spark function has a twin ``*_SQL`` common table
expression; both describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Tables whose rows are worked on heavily right after the scan.
HEAVY = {"documents", "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A file that is one big row group gives one task; heavy tables are then
    spread over the cores.  With as many splits as cores nothing is moved."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cut at newlines, then into 40-character pieces; blank pieces dropped.

    The cutting happens inside the row, so numbering needs no shuffle.
    """
    pieces = F.expr(
        r"""filter(flatten(transform(split(text, '\n'), (line, i) ->
              transform(regexp_extract_all(line, '(?s).{1,40}', 0),
                        (piece, s) -> struct(i AS line_no, s AS seg_no, piece AS text)))),
              p -> p.text rlike '\\S')"""
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(pieces).alias("ord", "piece"))
        .select(
            "doc_id",
            "ord",
            F.col("piece.line_no").alias("line_no"),
            F.col("piece.seg_no").alias("seg_no"),
            F.col("piece.text").alias("text"),
        )
    )


_LINE_COLUMNS = """
    doc_id,
    CAST(floor(ord / 30) + 1 AS INT) AS page_no,
    CAST(ord AS INT) AS line_id,
    text,
    CAST({horizontal_x} AS INT) AS x,
    CAST({y} AS INT) AS y,
    CAST({w} AS INT) AS width,
    CAST({h} AS INT) AS height,
    ((doc_id * 31 + ord * 17) % 100) / 100.0D AS confidence,
    vert AS is_vertical,
    CAST(1 AS INT) AS class_index,
    CAST(line_no AS INT) AS line_no
"""

_X = (
    "CASE WHEN vert THEN 1100 - 36 * (CASE WHEN two = 1 THEN i % 15 ELSE i END)"
    " ELSE 60 + 420 * (CASE WHEN two = 1 THEN floor(i / 15) ELSE 0 END)"
    " + (CASE WHEN seg_no = 0 AND line_no % 3 = 0 THEN 20 ELSE 0 END) END"
)
_Y = (
    "CASE WHEN vert THEN 80 + (CASE WHEN two = 1 THEN 420 * floor(i / 15) ELSE 0 END)"
    " ELSE 80 + 36 * (CASE WHEN two = 1 THEN i % 15 ELSE i END) + (ord * 7) % 5 END"
)
_W = "CASE WHEN vert THEN 24 ELSE least(400, 10 * length(text)) END"
_H = "CASE WHEN vert THEN least(400, 10 * length(text)) ELSE 24 END"


def _line_columns(duck: bool) -> str:
    text = _LINE_COLUMNS.format(horizontal_x=_X, y=_Y, w=_W, h=_H)
    return text.replace("100.0D", "100.0::DOUBLE") if duck else text


def ocr_lines(spark: SparkSession, sf_dir: str, vertical_rest: int = 0) -> DataFrame:
    """Page lines, 30 to a page, one or two decks; documents with
    ``doc_id % 4 = vertical_rest`` are set vertically (1 gives two-deck ones)."""
    placed = segments(spark, sf_dir).selectExpr(
        "*",
        "ord % 30 AS i",
        "doc_id % 2 AS two",
        f"doc_id % 4 = {vertical_rest} AS vert",
    )
    cols = [c.strip() for c in _split_columns(_line_columns(False))]
    return placed.selectExpr(*cols)


def _split_columns(text: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


SEGMENTS_SQL = r"""
_cut AS (
  SELECT doc_id, line_no, line, unnest(range(CAST(ceil(length(line) / 40.0) AS BIGINT))) AS seg_no
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents)
  WHERE length(line) > 0
),
segments AS (
  SELECT doc_id, line_no, seg_no, text,
         row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) - 1 AS ord
  FROM (SELECT doc_id, line_no, seg_no, substring(line, seg_no * 40 + 1, 40) AS text FROM _cut)
  WHERE regexp_matches(text, '\S')
)"""


def lines_sql(vertical_rest: int = 0, name: str = "ocr_lines") -> str:
    return f"""{SEGMENTS_SQL},
{name} AS (
  SELECT {_line_columns(True)}
  FROM (SELECT *, ord % 30 AS i, doc_id % 2 AS two, doc_id % 4 = {vertical_rest} AS vert
        FROM segments)
)"""


# --- grids from lineitem ---------------------------------------------------------

def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order: row number and the four cell texts."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        "CAST(l_quantity AS INT) AS qty",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents",
    )
    # An order has few lines, and their numbers stream out of the sort; tables of pages are then grouped without another shuffle.
    order = Window.partitionBy("doc_id").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return rows.filter("doc_id IS NOT NULL").withColumn("row_no", F.row_number().over(order)).selectExpr(
        "doc_id",
        "1 AS page_no",
        "row_no",
        "array(CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(qty AS STRING),"
        " CAST(cents AS STRING)) AS cells",
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their boxes and the text their line carries."""
    return (
        grid_rows(spark, sf_dir)
        .selectExpr("doc_id", "page_no", "1 AS region_seq", "row_no", "posexplode(cells) AS (c, text)")
        .selectExpr(
            "doc_id",
            "page_no",
            "region_seq",
            "row_no",
            "c + 1 AS col_no",
            "100 + 150 * c AS x",
            "100 + 40 * (row_no - 1) AS y",
            "150 AS width",
            "40 AS height",
            "text",
        )
    )


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text line inside every cell."""
    return grid_cells(spark, sf_dir).selectExpr(
        "doc_id",
        "page_no",
        "4 * (row_no - 1) + col_no AS line_id",
        "text",
        "x + 10 AS x",
        "y + 5 AS y",
        "100 AS width",
        "20 AS height",
        "0.9D AS confidence",
        "false AS is_vertical",
    )


def grid_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.count("*").cast("int").alias("n_rows"))
        .selectExpr(
            "doc_id", "1 AS page_no", "0 AS line_id", "concat('Table ', doc_id) AS text",
            "100 AS x", "60 AS y", "200 AS width", "20 AS height", "0.9D AS confidence",
            "false AS is_vertical",
        )
    )


def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.count("*").cast("int").alias("n_rows"))
        .selectExpr(
            "doc_id", "1 AS page_no", "1 AS region_seq", "'表' AS name", "'table' AS type",
            "100 AS x", "100 AS y", "600 AS width", "40 * n_rows AS height", "n_rows",
        )
    )


def grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruling segments of every grid; horizontal ones wobble by 0-2 px."""
    r = grid_regions(spark, sf_dir)
    vertical = r.selectExpr(
        "doc_id", "page_no", "explode(sequence(0, 4)) AS k", "height"
    ).selectExpr(
        "doc_id", "page_no", "'v' AS orient", "100 + 150 * k AS pos", "100 AS start",
        "100 + height AS end", "height AS length", "100 + k AS ord",
    )
    horizontal = r.selectExpr(
        "doc_id", "page_no", "explode(sequence(0, n_rows)) AS k"
    ).selectExpr(
        "doc_id", "page_no", "'h' AS orient", "100 + 40 * k + (k * 7) % 3 AS pos", "100 AS start",
        "700 AS end", "600 AS length", "k AS ord",
    )
    return horizontal.unionByName(vertical)


GRID_SQL = """
grid_rows AS (
  SELECT l_orderkey AS doc_id, 1 AS page_no,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
              l_extendedprice) AS INT) AS row_no,
         [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR),
          CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)] AS cells
  FROM lineitem
),
grid_cells AS (
  SELECT doc_id, page_no, 1 AS region_seq, row_no, CAST(c AS INT) AS col_no,
         CAST(100 + 150 * (c - 1) AS INT) AS x, 100 + 40 * (row_no - 1) AS y, 150 AS width, 40 AS height,
         cells[c] AS text
  FROM grid_rows, range(1, 5) AS t(c)
),
grid_lines AS (
  SELECT doc_id, page_no, 4 * (row_no - 1) + col_no AS line_id, text, x + 10 AS x, y + 5 AS y,
         100 AS width, 20 AS height, 0.9::DOUBLE AS confidence, false AS is_vertical
  FROM grid_cells
),
grid_regions AS (
  SELECT l_orderkey AS doc_id, 1 AS page_no, 1 AS region_seq, '表' AS name, 'table' AS type,
         100 AS x, 100 AS y, 600 AS width, CAST(40 * count(*) AS INT) AS height,
         CAST(count(*) AS INT) AS n_rows
  FROM lineitem GROUP BY l_orderkey
),
grid_captions AS (
  SELECT doc_id, 1 AS page_no, 0 AS line_id, 'Table ' || doc_id AS text, 100 AS x, 60 AS y,
         200 AS width, 20 AS height, 0.9::DOUBLE AS confidence, false AS is_vertical
  FROM grid_regions
),
grid_segments AS (
  SELECT doc_id, page_no, 'h' AS orient, CAST(100 + 40 * k + (k * 7) % 3 AS INT) AS pos, 100 AS start,
         700 AS "end", 600 AS length, CAST(k AS INT) AS ord
  FROM (SELECT doc_id, page_no, unnest(range(n_rows + 1)) AS k FROM grid_regions)
  UNION ALL
  SELECT doc_id, page_no, 'v', CAST(100 + 150 * k AS INT), 100, 100 + height, height, CAST(100 + k AS INT)
  FROM grid_regions, range(5) AS t(k)
)"""


# --- page items from documents ---------------------------------------------------

_ITEM_TEXT = {
    "spark": (
        "CASE WHEN ord % 30 = 0 AND page_no % 3 = 1 THEN concat('第', page_no DIV 3 + 1, '章 ', text)"
        " WHEN line_no % 7 = 6 THEN concat('【注釈文', ord % 9 + 1, '】 ', text)"
        " WHEN line_no > 0 AND ord % 5 = 0 THEN concat(text, '【注', ord % 11 + 1, '】')"
        " ELSE text END"
    ),
}
_ITEM_TEXT["duck"] = (
    _ITEM_TEXT["spark"].replace("page_no DIV 3", "(page_no // 3)").replace("concat(", "concat(")
)
_ITEM_KIND = (
    "CASE WHEN line_no = 0 OR (ord % 30 = 0 AND page_no % 3 = 1) THEN 'heading'"
    " WHEN line_no % 7 = 6 THEN 'footnote' ELSE 'body' END"
)


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, body lines and footnotes with note markers, one row per line."""
    seg = segments(spark, sf_dir).selectExpr("*", "CAST(ord DIV 30 + 1 AS INT) AS page_no")
    return seg.selectExpr(
        "doc_id", "page_no", f"{_ITEM_KIND} AS kind", "CAST(ord AS INT) AS seq",
        f"{_ITEM_TEXT['spark']} AS text",
    )


ITEMS_SQL = f"""{SEGMENTS_SQL},
page_items AS (
  SELECT doc_id, page_no, {_ITEM_KIND} AS kind, CAST(ord AS INT) AS seq, {_ITEM_TEXT['duck']} AS text
  FROM (SELECT *, CAST(ord // 30 + 1 AS INT) AS page_no FROM segments)
)"""


def page_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS doc_id", "CAST(event_id % 40 + 1 AS INT) AS page_no", "ts AS arrived",
        "event_type AS status", "event_id",
    )


ARRIVALS_SQL = """
page_arrivals AS (
  SELECT user_id AS doc_id, CAST(event_id % 40 + 1 AS INT) AS page_no, ts AS arrived,
         event_type AS status, event_id
  FROM events
)"""

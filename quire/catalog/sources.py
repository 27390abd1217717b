"""Source and streaming queries.  The JSON read here is written from the tables by Spark."""

from pyspark.sql import functions as F

from quire import PAGE
from quire.catalog.base import SPACE, d_strip, query
from quire.catalog.lines import LINES
from quire.catalog.reading import WORD, d_cut, d_years
from quire.catalog.text import UNWRAP
from quire.operators.staging import fresh_path, settle
from quire.plans import fixtures as X
from quire.sources import page_store
from quire.sources import pages as P
from quire.streaming import ingest as I

_BOX = (
    "array(array(x, y), array(x, y + height), array(x + width, y), array(x + width, y + height))"
)


def engine_pages(spark, sf):
    """One JSON text per page, in one of the five root shapes, with some unusable items."""
    lines = X.ocr_lines(spark, sf)
    item = F.to_json(
        F.struct(
            F.expr(f"CASE WHEN line_id % 17 = 3 THEN CAST(NULL AS ARRAY<ARRAY<INT>>) ELSE {_BOX} END").alias("boundingBox"),
            "text", F.col("confidence"), F.expr("CAST(is_vertical AS STRING)").alias("isVertical"), "class_index",
        )
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("line_id", item.alias("j")))), lambda s: s["j"]
    )
    pages = lines.groupBy(*PAGE).agg(F.array_join(ordered, ",").alias("j"))
    shape = F.expr(
        """CASE (doc_id + page_no) % 5 WHEN 0 THEN concat('{"contents": [[', j, ']]}') WHEN 1 THEN concat('[', j, ']')
           WHEN 2 THEN concat('{"results": [', j, ']}') WHEN 3 THEN concat('{"blocks": [', j, ']}') ELSE concat('{"ocr": [', j, ']}') END"""
    )
    return pages.select(*PAGE, shape.alias("raw"))


REGION_CLEAN = f"""{d_cut('ocr_lines', '_k1', 5, f'^[^{SPACE}]$')},
  {d_cut('_k1', '_k2', 4, f'^[{WORD}]+[{SPACE}]+$', word_start=True)}, {d_years('_k2', '_k3')}"""
_MARKS = "._,-~|''`\"^*:;・+=/\\()[]{}<>"


@query(
    "read_ocr_lines",
    f"""WITH {LINES}, {REGION_CLEAN}, t AS (SELECT *, {d_strip('text')} AS t FROM _k3)
    SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_id) AS INT) AS i, text, x, y, width, height, is_vertical FROM t
    WHERE line_id % 17 <> 3 AND t <> '' AND NOT (length(t) = 1 AND contains('{_MARKS}', t) AND confidence < 0.35)
      AND width >= 8 AND height >= 8 AND NOT (confidence > 0 AND confidence < 0.15) AND NOT (confidence = 0 AND length(t) <= 1)""",
)
def _(spark, sf):
    from quire.operators.ordered import numbered, span

    lines = settle(P.parse_ocr_lines(engine_pages(spark, sf)))
    out = numbered(lines, PAGE, [F.col("line_id")], span("line_id", 4096), "i")
    return out.select(*PAGE, "i", "text", "x", "y", "width", "height", "is_vertical")


@query(
    "read_display_lines",
    f"""WITH {LINES} SELECT doc_id, page_no, text, x, y, width, height, is_vertical FROM ocr_lines
    WHERE NOT (confidence <= 0.01 AND (length({d_strip('text')}) <= 1 OR (length({d_strip('text')}) <= 3 AND
      regexp_matches({d_strip('text')}, '^[\\p{{P}}{SPACE}~|`^+=<>ー]*$'))))""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    item = F.expr(
        f"""CASE line_id % 3 WHEN 0 THEN to_json(named_struct('text', text, 'x', x, 'y', y, 'width', width, 'height', height, 'isVertical', is_vertical, 'confidence', confidence))
          WHEN 1 THEN to_json(named_struct('Text', text, 'boundingBox', {_BOX}, 'isVertical', CAST(is_vertical AS STRING), 'confidence', confidence))
          ELSE to_json(named_struct('isTextline', 'true', 'text', text, 'bbox', array(x, y, x + width, y + height), 'isVertical', is_vertical, 'confidence', confidence)) END"""
    )
    # Pages without a list of results lie under 3 to 20 wrappers, two levels each.
    pages = lines.groupBy(*PAGE).agg(F.array_join(F.collect_list(item), ",").alias("j"))
    pages = pages.withColumn("wraps", F.expr("CAST(3 + pmod(doc_id + page_no, 18) AS INT)")).select(
        *PAGE, F.expr("""CASE WHEN page_no % 2 = 0 THEN concat('{"results": [', j, ']}') ELSE concat('{"contents": [[', repeat('{"k": [', wraps), j, repeat(']}', wraps), ']], "pdfinfo": {}}') END""").alias("raw")
    )
    return P.parse_display_lines(pages).drop("line_at")


@query(
    "read_document_json",
    f"WITH {LINES} SELECT doc_id, page_no, text, x, y, width, height FROM ocr_lines",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    item = F.to_json(F.struct(F.expr(_BOX).alias("boundingBox"), "text"))
    pages = lines.groupBy(*PAGE).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("j"))
    docs = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "j"))), lambda s: s["j"]), ",").alias("j")
    )
    raw = docs.select("doc_id", F.expr("""concat('{"contents": [', j, '], "pages": 1}')""").alias("raw"))
    return P.parse_document_json(raw).select(*PAGE, "text", "x", "y", "width", "height")


@query(
    "read_layout",
    f"""WITH {X.GRID_SQL} SELECT doc_id, page_no, 1 AS region_seq, '表' AS name, x, y, width, height, 4 * n_rows AS cells, n_rows + 2 AS rules,
      CASE WHEN n_rows > 1 THEN array_to_string([100 + 40 * k FOR k IN range(1, n_rows)], ',') ELSE '' END AS horizontal_lines,
      CASE WHEN doc_id % 2 = 0 THEN '250,400,550' ELSE '250,400,550' END AS vertical_lines FROM grid_regions""",
)
def _(spark, sf):
    cells = X.grid_cells(spark, sf)
    pages = cells.groupBy(*PAGE).agg(
        F.collect_list(F.struct(F.col("row_no").alias("row"), F.col("col_no").alias("column"), "x", "y", "width", "height", "text")).alias("cells")
    )
    upper = pages.join(X.grid_regions(spark, sf), PAGE).select(
        *PAGE,
        F.expr(
            """CASE WHEN doc_id % 2 = 0 THEN concat('{"regions": [', to_json(named_struct('name', name, 'type', type, 'x', x, 'y', y, 'width', width, 'height', height,
                 'cells', cells, 'vertical_lines', array(250, 400, 550))), ']}')
               ELSE concat('{"Regions": [', to_json(named_struct('Name', name, 'Type', type, 'X', x, 'Y', y, 'Width', CAST(width AS STRING), 'Height', height, 'cells', cells)), ']}') END"""
        ).alias("raw"),
    )
    return P.parse_layout(upper).select(
        *PAGE, "region_seq", "name", "x", "y", "width", "height", F.size("cells").alias("cells"), F.size("rule_lines").alias("rules"),
        F.array_join("horizontal_lines", ",").alias("horizontal_lines"), F.array_join("vertical_lines", ",").alias("vertical_lines"),
    )


@query(
    "layout_template",
    f"""WITH {LINES} SELECT doc_id, page_no, k AS region_seq, '本文' || k AS name, CAST(k * 10 + page_no AS INT) AS x
    FROM (SELECT DISTINCT doc_id, page_no FROM ocr_lines), range(1, 4) AS t(k)""",
)
def _(spark, sf):
    regions = X.ocr_lines(spark, sf).select(*PAGE).distinct().selectExpr(
        "doc_id", "page_no", "explode(sequence(1, 3)) AS region_seq"
    ).selectExpr(
        "doc_id", "page_no", "region_seq", "concat('本文', region_seq) AS name", "'body' AS type", "'auto' AS orientation",
        "CAST(region_seq * 10 + page_no AS INT) AS x", "0 AS y", "10 AS width", "10 AS height",
        f"CAST(array() AS {P.RULE_LINES}) AS rule_lines",
    )
    raw = P.layout_template_json(regions).withColumn(
        "raw", F.regexp_replace("raw", r'"pages":\{', r'"pages":{"x1":{"use_template":false,"regions":[]},')
    )
    return P.parse_layout_template(raw).select(*PAGE, "region_seq", "name", "x")


@query(
    "read_rules",
    """WITH p AS (SELECT p_partkey, p_name, p_brand FROM part)
    SELECT p_partkey, p_name AS original, p_brand AS replacement, false AS is_regex, 0 AS ord, '' AS description FROM p
    UNION ALL SELECT p_partkey, 'x', 'y', false, 1, '' FROM p WHERE p_partkey % 3 = 2
    UNION ALL SELECT p_partkey, p_brand, '', true, 0, 'd' FROM p WHERE p_partkey % 3 < 2""",
)
def _(spark, sf):
    raw = X.table(spark, sf, "part").select(
        "p_partkey",
        F.expr(
            """CASE p_partkey % 3 WHEN 0 THEN to_json(named_struct('exact_replacements', map(p_name, p_brand), 'regex_replacements', array(named_struct('pattern', p_brand, 'description', 'd'))))
               WHEN 1 THEN to_json(named_struct('terms', map(p_name, p_brand), 'regexes', array(named_struct('pattern', p_brand, 'replacement', '', 'description', 'd'))))
               ELSE to_json(map('_comment', 'c', p_name, p_brand, 'x', 'y')) END"""
        ).alias("raw"),
    )
    return P.parse_rules(raw).drop("enabled")


@query(
    "write_rules",
    """SELECT p_brand AS original, max(p_name) AS replacement FROM part GROUP BY p_brand""",
)
def _(spark, sf):
    rules = X.table(spark, sf, "part").selectExpr(
        "p_brand AS original", "p_name AS replacement", "false AS is_regex", "'' AS description", "CAST(p_partkey AS INT) AS ord"
    )
    last = rules.groupBy("original").agg(F.max("replacement").alias("top"))
    rules = rules.join(last, "original").withColumn("ord", F.when(F.col("replacement") == F.col("top"), 1 << 30).otherwise(F.col("ord")))
    blank = rules.limit(1).withColumn("original", F.lit("　 "))
    raw = P.rules_json(rules.drop("top").unionByName(blank.drop("top")))
    return P.parse_rules(raw).select("original", "replacement")


@query(
    "resolve_page_files",
    """SELECT o_orderkey AS doc_id, 1 AS page_no, '/r/' || o_orderkey || '/page_0001/' || CASE o_orderkey % 3 WHEN 0 THEN 'auto_regions.json' WHEN 1 THEN 'page.json'
      ELSE 'a.json' END AS path FROM orders""",
)
def _(spark, sf):
    files = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc_id", "1 AS page_no",
        """explode(CASE o_orderkey % 3 WHEN 0 THEN array('auto_layout.json', 'auto_regions.json', 'page.json', 'a.json') WHEN 1 THEN array('page.json', 'a.json', 'page_data.json')
           ELSE array('b.json', 'a.json', 'AUTO_LAYOUT.json', 'x_bordered_regions.json', 'a.txt') END) AS name""",
    ).selectExpr("doc_id", "page_no", "concat('/r/', doc_id, '/page_0001/', name) AS path")
    return P.resolve_page_files(files)


@query(
    "with_text_fallback",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_no, line_id, text FROM ocr_lines WHERE page_no % 2 = 1)
    SELECT doc_id, page_no, line_id, text FROM p UNION ALL
    SELECT doc_id, page_no, CAST(i AS INT), t FROM (SELECT DISTINCT doc_id, page_no FROM ocr_lines WHERE page_no % 2 = 0), (VALUES (0, 'first'), (1, ''), (2, 'last')) AS v(i, t)""",
)
def _(spark, sf):
    lines = X.ocr_lines(spark, sf)
    texts = lines.select(*PAGE).distinct().withColumn("text", F.lit("first\n\nlast"))
    return P.with_text_fallback(lines.filter("page_no % 2 = 1"), texts)


@query(
    "read_page_data",
    f"""WITH {UNWRAP} SELECT doc_id, page_no, kind, text FROM (
      SELECT doc_id, 1 AS page_no, 'body' AS kind, CASE WHEN title THEN alone WHEN west THEN w_text ELSE j_text END AS text FROM joined
      UNION ALL SELECT doc_id, 1, 'footnote', '【注釈文1】 ' || source FROM documents
      UNION ALL SELECT doc_id, 1, 'heading', '第1章 ' || lang FROM documents
      UNION ALL SELECT doc_id, 1, 'subheading', '（1） ' || lang FROM documents
      UNION ALL SELECT doc_id, 2, 'body', v FROM documents, (VALUES ('old one'), ('old two')) AS t(v))""",
)
def _(spark, sf):
    docs = X.table(spark, sf, "documents")
    raw = docs.select(
        "doc_id", F.lit(1).alias("page_no"),
        F.to_json(
            F.struct(
                F.lit(1).alias("PageNumber"),
                F.expr("array(concat('[P1] 第1章 ', lang), '第1章', concat('（1） ', lang), '長い文。')").alias("Headings"),
                F.array("text").alias("BodyParagraphs"),
                F.array(F.concat(F.lit("【注釈文1】 "), "source")).alias("Footnotes"),
            )
        ).alias("raw"),
    )
    legacy = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_no"), F.lit("old one\n\n\n\nold two\n").alias("text"))
    return P.load_pages(P.parse_page_data(raw), legacy).select(*PAGE, "kind", "text")


def scratch(spark, label):
    """A folder of its own in the shared checkpoint folder."""
    return fresh_path(spark, label)


@query(
    "write_page_data",
    f"""WITH {X.ITEMS_SQL} SELECT doc_id, page_no, kind, seq, CASE WHEN page_no % 2 = 0 THEN concat('new ', text) ELSE text END AS text
    FROM page_items WHERE page_no % 2 = 1 OR seq % 3 <> 1""",
)
def _(spark, sf):
    """Whole texts, every second page in a later version with fewer items."""
    path = scratch(spark, "pages")
    items = X.page_items(spark, sf)
    P.write_page_data(items, path)
    P.write_page_data(
        items.filter("page_no % 2 = 0 AND seq % 3 <> 1").withColumn("text", F.concat(F.lit("new "), "text")), path
    )
    page_store.compact(spark, path)
    return P.read_stored_pages(spark, path)


# --- streaming -------------------------------------------------------------------------

def arrival_stream(spark, sf):
    return I.stream_table(spark, sf, "events").selectExpr(
        "user_id AS doc_id", "CAST(event_id % 40 + 1 AS INT) AS page_no", "ts AS arrived", "event_type AS status", "event_id",
    )


@query(
    "ingest_pages",
    f"""WITH {X.ARRIVALS_SQL} SELECT doc_id, page_no, arrived, status, event_id FROM (SELECT *, row_number() OVER (
      PARTITION BY doc_id, page_no ORDER BY arrived DESC, event_id DESC) AS rn FROM page_arrivals) WHERE rn = 1""",
)
def _(spark, sf):
    path = scratch(spark, "arrivals")
    query_ = I.ingest_pages(arrival_stream(spark, sf), path, scratch(spark, "offsets"), ["arrived", "event_id"])
    query_.awaitTermination()
    return I.read_pages(spark, path, ["arrived", "event_id"])


@query(
    "ingest_with_new_rules",
    f"""WITH {X.ARRIVALS_SQL} SELECT doc_id, page_no, replace(arg_max(status, (arrived, event_id)), 'i', '<i>') AS status
    FROM page_arrivals GROUP BY ALL""",
)
def _(spark, sf):
    """All arrivals come twice; the dictionary is edited between the two batches."""
    path, offsets, rules = scratch(spark, "arrivals"), scratch(spark, "offsets"), scratch(spark, "rules")
    inbox = scratch(spark, "inbox")
    arrivals = X.page_arrivals(spark, sf)
    schema, order = arrivals.withColumn("turn", F.lit(1)).schema, ["turn", "arrived", "event_id"]
    for turn, new in enumerate(("[i]", "<i>")):
        arrivals.withColumn("turn", F.lit(turn)).write.mode("append").parquet(inbox)
        rule = "original string, replacement string, is_regex boolean, description string, enabled boolean, ord int"
        edited = spark.createDataFrame([("i", new, False, "", True, 0)], rule)
        P.write_rules(edited, f"{rules}/{turn}")
        stream = spark.readStream.schema(schema).parquet(inbox)
        I.ingest_pages(stream, path, offsets, order, rules_path=f"{rules}/{turn}", text_col="status").awaitTermination()
    return I.read_pages(spark, path, order).select(*PAGE, "status")


@query(
    "batch_progress",
    f"""WITH {X.ARRIVALS_SQL} SELECT doc_id, CAST((page_no - 1) // 20 + 1 AS INT) AS batch_no, count(DISTINCT page_no) AS completed FROM page_arrivals GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch(spark, "progress")
    frame = I.batch_progress(arrival_stream(spark, sf), time_col="arrived")
    I.drain(frame, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), scratch(spark, "offsets"))
    # Counts only grow, so a batch's largest update is its last.
    return spark.read.parquet(path).groupBy("doc_id", "batch_no").agg(F.max("completed").alias("completed"))

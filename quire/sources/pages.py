"""Reading and writing the files of page projects.

Parsers take a DataFrame with the page key and a JSON string column, so they run over any
table of documents; readers only add the listing of files.  Folders look like
``<doc_id>/page_0001/page.json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.geometry import cluster_array, line_bucket, polygon_to_box
from quire.functions.text import given, is_blank, strip
from quire.operators.headings import clean_headings, reclassify_headings
from quire.operators.lines import drop_noise_lines
from quire.operators.ordered import first_per
from quire.operators.paragraphs import unwrap_paragraphs
from quire.operators.reading import without_runaway
from quire.operators.staging import settle
from quire.sources import page_store

PAGE_DIR = r"([^/]+)/page_(\d+)/([^/]+)$"


def _page_key(path: Column) -> list[Column]:
    """Page key from a file path; a folder name that is no number is hashed."""
    folder = F.regexp_extract(path, PAGE_DIR, 1)
    return [
        F.coalesce(folder.try_cast("bigint"), F.xxhash64(folder)).alias("doc_id"),
        F.regexp_extract(path, PAGE_DIR, 2).cast("int").alias("page_no"),
    ]


def read_page_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Whole text of the files called ``name`` (a glob) below ``root``, one row per file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", name
    ).text(root)
    path = F.col("_metadata.file_path")
    return files.select(*_page_key(path), path.alias("path"), F.col("value").alias("raw")).filter("page_no IS NOT NULL")


def resolve_page_files(files: DataFrame) -> DataFrame:
    """The file a page is read from: ``auto_regions.json``, else ``page.json``, else the first other
    JSON that is no by-product.  ``files``: page key and ``path``."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    # Files the engine writes beside its result.
    by_products = [
        r"auto_layout\.json", r"page_data\.json", r"detected_line_segments\.json", r"bordered_regions\.json"
    ]
    rank = (
        F.when(name == "auto_regions.json", 1).when(name == "page.json", 2)
        .when(name.endswith(".json") & ~name.rlike("(?:" + "|".join(by_products) + ")$"), 3)
    )
    return first_per(files.withColumn("_rank", rank).filter("_rank IS NOT NULL"), PAGE, [F.col("_rank"), F.col("path")]).drop("_rank")


# --- engine lines ----------------------------------------------------------------------

def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column) -> Column:
    """Items of the five root shapes: ``contents`` (lists or single items), a bare list,
    ``results``, ``blocks``, ``ocr``, or one item."""
    contents = F.flatten(
        F.transform(
            _get(v, "$.contents", "array<variant>"), lambda p: F.coalesce(_get(p, "$", "array<variant>"), F.array(p))
        )
    )
    listed = [_get(v, p, "array<variant>") for p in ("$.results", "$.blocks", "$.ocr")]
    none = F.array().cast("array<variant>")
    return F.when(_get(v, "$.contents", "variant").isNotNull(), F.coalesce(contents, none)).otherwise(
        F.coalesce(_get(v, "$", "array<variant>"), *listed, F.array(v))
    )


def _line_fields(item: Column) -> list[Column]:
    points = F.coalesce(
        _get(item, "$.boundingBox", "array<array<double>>"), _get(item, "$.bbox", "array<array<double>>")
    )
    box = polygon_to_box(F.filter(points, lambda p: F.size(p) >= 2))
    return [
        F.coalesce(_get(item, "$.text", "string"), F.lit("")).alias("text"),
        box.alias("box"),
        F.coalesce(_get(item, "$.confidence", "double"), _get(item, "$.score", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.lower(_get(item, "$.isVertical", "string")) == "true", F.lit(False)).alias("is_vertical"),
        _get(item, "$.class_index", "int").alias("class_index"),
    ]


_LINE = ["line_id", "text", "x", "y", "width", "height", "confidence", "is_vertical", "class_index"]


def _once(value: Column) -> Column:
    """``value`` out of a generator: used as a plain column, every use would compute it again."""
    return F.explode(F.array(value))


def _lines(found: DataFrame) -> DataFrame:
    """Rows of the page key, ``line_id`` and the fields ``l`` as lines; those without a box go."""
    lines = found.filter("l.box IS NOT NULL").select(*PAGE, "line_id", "l.*")
    return lines.select(*PAGE, "line_id", "text", "box.*", "confidence", "is_vertical", "class_index")


def parse_ocr_lines(df: DataFrame, col: str = "raw") -> DataFrame:
    """Lines of engine JSON.  Items without a usable box, blank lines and noise drop out one
    by one; repeated text is cut."""
    parsed = df.select(*PAGE, _once(F.try_parse_json(col)).alias("v"))
    items = parsed.select(*PAGE, F.posexplode(_items(F.col("v"))).alias("line_id", "item"))
    lines = _lines(items.select(*PAGE, "line_id", _once(F.struct(*_line_fields(F.col("item")))).alias("l")))
    return drop_noise_lines(without_runaway(lines, "region")).select(*PAGE, *_LINE)


def parse_document_json(df: DataFrame, col: str = "raw") -> DataFrame:
    """Lines of a whole document, ``contents[page][line]``; ``df`` needs ``doc_id`` only."""
    pages = df.select(
        "doc_id", F.posexplode(_get(F.try_parse_json(col), "$.contents", "array<variant>")).alias("_p", "page")
    )
    items = F.coalesce(_get(F.col("page"), "$", "array<variant>"), F.array("page"))
    lines = pages.select("doc_id", (F.col("_p") + 1).alias("page_no"), F.posexplode(items).alias("line_id", "item"))
    return _lines(lines.select(*PAGE, "line_id", _once(F.struct(*_line_fields(F.col("item")))).alias("l"))).select(*PAGE, *_LINE)


def read_ocr_lines(spark: SparkSession, root: str, name: str = "*.json") -> DataFrame:
    """Engine lines of every page below ``root``, from the right file of each page."""
    files = read_page_files(spark, root, name)
    chosen = resolve_page_files(files.select(*PAGE, "path"))
    return parse_ocr_lines(files.join(chosen, [*PAGE, "path"], "left_semi"))


# --- display lines ---------------------------------------------------------------------

def _display_box(item: Column) -> Column:
    def whole(*paths: str) -> Column:
        return F.coalesce(*[_get(item, p, "int") for p in paths], F.lit(0))

    def box(x, y, w, h) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))

    direct = box(whole("$.x", "$.X"), whole("$.y", "$.Y"), whole("$.width", "$.Width"), whole("$.height", "$.Height"))
    points = F.filter(_get(item, "$.boundingBox", "array<array<int>>"), lambda p: F.size(p) >= 2)

    def polygon(p: Column) -> Column:
        xs = F.transform(p, lambda q: F.get(q, F.lit(0)))
        ys = F.transform(p, lambda q: F.get(q, F.lit(1)))
        return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))

    def corner(flat: Column) -> Column:
        a, b, c, d = (F.get(flat, F.lit(i)) for i in range(4))
        # A second corner right of and below the first is a corner, else it is a size.
        return F.when(F.size(flat) >= 4, box(a, b, F.when(c >= a, c - a).otherwise(c), F.when(d >= b, d - b).otherwise(d)))

    has_x = _get(item, "$.x", "variant").isNotNull() | _get(item, "$.X", "variant").isNotNull()
    placed = F.coalesce(
        given(points, lambda p: F.when(F.size(p) > 0, polygon(p))), given(_get(item, "$.bbox", "array<int>"), corner),
        box(*[F.lit(0)] * 4),
    )
    return F.when(has_x, direct).otherwise(placed)


def _nesting(text: Column) -> Column:
    """How many brackets of a JSON text are open at once at most."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    def depth(marks: Column, pared: int) -> Column:
        if pared == 0:
            start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
            return F.aggregate(F.split(marks, ""), start, step, lambda acc: acc["most"])
        # Without its innermost pairs a text is one level less deep; a few passes leave little to walk through.
        rest = given(F.regexp_replace(marks, r"\[\]|\{\}", ""), lambda m: depth(m, pared - 1))
        return F.when(marks == "", 0).otherwise(1 + rest)

    return given(F.regexp_replace(bare, r"[^\[\]{}]+", ""), lambda m: depth(m, 4))


def _objects_with_text(v: Column, levels: Column) -> Column:
    """``at, item`` of every outermost object with text below ``v``, whose nesting is ``levels``.

    Each step turns the nodes of one level into those of the next, within the row.
    """
    node = F.array().cast("array<struct<at:array<int>,item:variant>>")

    def has_text(n: Column) -> Column:
        text = F.coalesce(_get(n["item"], "$.text", "string"), _get(n["item"], "$.Text", "string"), F.lit(""))
        return text.rlike(r"(?U)\S")

    def children(n: Column) -> Column:
        found = F.coalesce(
            _get(n["item"], "$.results", "array<variant>"), _get(n["item"], "$", "array<variant>"),
            F.map_values(_get(n["item"], "$", "map<string,variant>")),
        )
        return F.transform(found, lambda c, i: F.struct(F.concat(n["at"], F.array(i)).alias("at"), c.alias("item")))

    def step(acc: Column, _: Column) -> Column:
        def split(marked: Column) -> Column:
            hits = F.transform(F.filter(marked, lambda m: m["hit"]), lambda m: m["n"])
            below = F.transform(F.filter(marked, lambda m: ~m["hit"]), lambda m: F.coalesce(children(m["n"]), node))
            return F.struct(F.concat(acc["found"], hits).alias("found"), F.flatten(below).alias("open"))

        return given(F.transform(acc["open"], lambda n: F.struct(n.alias("n"), has_text(n).alias("hit"))), split)

    root = F.array(F.struct(F.array().cast("array<int>").alias("at"), v.alias("item")))
    start = F.struct(node.alias("found"), root.alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, step, lambda acc: acc["found"])


def parse_display_lines(df: DataFrame, col: str = "raw") -> DataFrame:
    """Lines as the viewer shows them: a ``results`` list, or any object with text at whatever
    depth, in document order.  Noise and repeats drop out."""
    parsed = df.select(*PAGE, _once(F.struct(F.try_parse_json(col).alias("v"), F.col(col).alias("raw"))).alias("p"))
    parsed = parsed.filter("p.v IS NOT NULL").select(*PAGE, "p.*")
    results = _get(F.col("v"), "$.results", "array<variant>")
    listed = F.transform(results, lambda c, i: F.struct(F.array(i).alias("at"), c.alias("item")))
    nodes = F.when(F.size(results) > 0, listed).otherwise(_objects_with_text(F.col("v"), _nesting(F.col("raw"))))
    found = parsed.select(*PAGE, F.explode(nodes).alias("n")).select(*PAGE, "n.at", "n.item")
    item = F.col("item")
    text = F.coalesce(_get(item, "$.text", "string"), _get(item, "$.Text", "string"))
    conf = F.coalesce(_get(item, "$.confidence", "double"), _get(item, "$.Confidence", "double"))
    fields = F.struct(
        text.alias("text"), _display_box(item).alias("box"), conf.alias("confidence"),
        F.coalesce(F.lower(_get(item, "$.isVertical", "string")) == "true", F.lit(False)).alias("is_vertical"),
    )
    lines = found.select(*PAGE, "at", _once(fields).alias("l")).select(*PAGE, "at", "l.*")
    lines = lines.select(*PAGE, "at", "text", "box.*", "confidence", "is_vertical")
    t = strip("text")
    noise = (F.col("confidence") <= 0.01) & (
        (F.length(t) <= 1) | ((F.length(t) <= 3) & t.rlike(r"(?U)^[\p{P}\s~|`^+=<>ー]*$"))
    )
    kept = lines.filter(~is_blank("text") & ~F.coalesce(noise, F.lit(False)))
    same = [*PAGE, "text", "x", "y", "width", "height", "is_vertical"]
    return kept.groupBy(*same).agg(F.min("at").alias("line_at")).select(*PAGE, "line_at", *same[2:])


def read_display_lines(spark: SparkSession, root: str) -> DataFrame:
    files = read_page_files(spark, root, "*.json")
    chosen = resolve_page_files(files.select(*PAGE, "path"))
    return parse_display_lines(files.join(chosen, [*PAGE, "path"], "left_semi"))


# --- layout ----------------------------------------------------------------------------

def parse_layout(df: DataFrame, col: str = "raw") -> DataFrame:
    """Detected regions with cells and rule lines.  Keys may be written either way; lines a
    region lacks follow from the inner edges of its cells."""

    def text(v: Column, name: str) -> Column:
        return F.coalesce(_get(v, f"$.{name}", "string"), _get(v, f"$.{name.capitalize()}", "string"), F.lit(""))

    def whole(v: Column, name: str, other: str | None = None) -> Column:
        return F.coalesce(_get(v, f"$.{name}", "int"), _get(v, f"$.{other or name.capitalize()}", "int"), F.lit(0))

    v = F.try_parse_json(col)
    regions = F.coalesce(_get(v, "$.regions", "array<variant>"), _get(v, "$.Regions", "array<variant>"))
    r = F.col("r")
    box = {n: whole(r, n) for n in ("x", "y", "width", "height", "rows", "columns")}
    d = df.select(*PAGE, F.posexplode(regions).alias("i", "r")).select(
        *PAGE, (F.col("i") + 1).alias("region_seq"), text(r, "name").alias("name"), text(r, "type").alias("type"),
        text(r, "orientation").alias("orientation"), *[c.alias(n) for n, c in box.items()],
        F.transform(
            F.coalesce(_get(r, "$.cells", "array<variant>"), F.array().cast("array<variant>")),
            lambda c: F.struct(
                whole(c, "row").alias("row"), whole(c, "column").alias("column"), whole(c, "x").alias("x"),
                whole(c, "y").alias("y"), whole(c, "width").alias("width"), whole(c, "height").alias("height"),
                text(c, "text").alias("text"), whole(c, "ocr_count", "OcrCount").alias("ocr_count"),
            ),
        ).alias("cells"),
        F.coalesce(_get(r, "$.horizontal_lines", "array<int>"), F.array().cast("array<int>")).alias("h"),
        F.coalesce(_get(r, "$.vertical_lines", "array<int>"), F.array().cast("array<int>")).alias("v"),
    )

    def inner(start: str, size: str) -> Column:
        low, high = F.col(start) + 2, F.col(start) + F.col(size) - 2
        edges = F.flatten(F.transform("cells", lambda c: F.array(c[start], c[start] + c[size])))
        kept = F.array_sort(F.array_distinct(F.filter(edges, lambda e: (e > low) & (e < high))))
        return cluster_array(kept, 4)

    d = d.withColumns(
        {
            "h": F.when(F.size("h") == 0, inner("y", "height")).otherwise(F.array_distinct("h")),
            "v": F.when(F.size("v") == 0, inner("x", "width")).otherwise(F.array_distinct("v")),
        }
    )

    def rules(name: str, vertical: bool, start: str, size: str) -> Column:
        return F.transform(
            name,
            lambda p: F.struct(
                F.lit(vertical).alias("is_vertical"), p.alias("pos"), F.col(start).alias("start"),
                (F.col(start) + F.col(size)).alias("end"),
            ),
        )

    return d.withColumn(
        "rule_lines", F.concat(rules("h", False, "x", "width"), rules("v", True, "y", "height"))
    ).withColumnsRenamed({"h": "horizontal_lines", "v": "vertical_lines"})


def read_layout(spark: SparkSession, root: str) -> DataFrame:
    return parse_layout(read_page_files(spark, root, "auto_layout.json"))


RULE_LINES = "ARRAY<STRUCT<is_vertical: BOOLEAN, pos: INT, start: INT, `end`: INT>>"
_REGION = f"STRUCT<name: STRING, type: STRING, orientation: STRING, x: INT, y: INT, width: INT, height: INT, rule_lines: {RULE_LINES}>"
_TEMPLATE = (
    f"STRUCT<template: STRUCT<name: STRING, regions: ARRAY<{_REGION}>>, "
    f"pages: MAP<STRING, STRUCT<use_template: BOOLEAN, regions: ARRAY<{_REGION}>>>>"
)


def parse_layout_template(df: DataFrame, col: str = "raw") -> DataFrame:
    """User regions of a layout file (``doc_id`` and JSON): page keys are 1-based numbers as
    text, other keys are skipped."""
    pages = df.select("doc_id", F.explode(F.from_json(col, _TEMPLATE)["pages"]).alias("k", "p"))
    page = F.when(F.col("k").rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim("k")).try_cast("int")
    return (
        pages.select("doc_id", page.alias("page_no"), F.posexplode("p.regions").alias("i", "r"))
        .filter("page_no IS NOT NULL")
        .select(*PAGE, (F.col("i") + 1).alias("region_seq"), "r.*")
    )


def layout_template_json(regions: DataFrame, name: str = "縦書き本文") -> DataFrame:
    """One layout JSON per document: ``doc_id, raw``.  The regions of a document are the ones a
    user drew, so they fit one text."""
    fields = ["name", "type", "orientation", "x", "y", "width", "height", "rule_lines"]
    present = [c for c in fields if c in regions.columns]
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("region_seq", F.struct(*present).alias("r")))), lambda s: s["r"]
    )
    pages = regions.groupBy(*PAGE).agg(listed.alias("regions"))
    entry = F.struct(F.col("page_no").cast("string"), F.struct(F.lit(False).alias("use_template"), "regions"))
    whole = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("pages"))
    template = F.struct(F.lit(name).alias("name"), F.array().cast(f"ARRAY<{_REGION}>").alias("regions"))
    return whole.select("doc_id", F.to_json(F.struct(template.alias("template"), "pages")).alias("raw"))


def read_layout_template(spark: SparkSession, path: str) -> DataFrame:
    """Layout files ``<doc_id>/page_layout.json`` below ``path``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "page_layout.json"
    ).text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    doc = F.coalesce(folder.try_cast("bigint"), F.xxhash64(folder))
    return parse_layout_template(files.select(doc.alias("doc_id"), F.col("value").alias("raw")))


def write_layout_template(regions: DataFrame, path: str) -> None:
    """One JSON line per document."""
    layout_template_json(regions).write.mode("overwrite").json(path)


# --- rules -----------------------------------------------------------------------------

_REGEX_RULE = "ARRAY<STRUCT<pattern: STRING, replacement: STRING, description: STRING, enabled: BOOLEAN>>"


def parse_rules(df: DataFrame, col: str = "raw") -> DataFrame:
    """Rules of dictionary JSON: ``exact_replacements`` or ``terms``, else a flat map without
    ``_comment`` keys; plus the regex list."""
    v = F.try_parse_json(col)
    plain = "map<string,string>"
    # Read from the text itself: a variant has its keys sorted, and rules count in file order.
    named = F.coalesce(
        F.from_json(F.get_json_object(col, "$.exact_replacements"), plain), F.from_json(F.get_json_object(col, "$.terms"), plain)
    )
    keyed = F.lit(False)
    for k in ("exact_replacements", "terms", "regex_replacements", "regexes"):
        keyed = keyed | _get(v, f"$.{k}", "variant").isNotNull()
    flat = F.map_filter(F.from_json(col, plain), lambda k, _: ~k.startswith("_comment"))
    exact = F.map_entries(F.when(keyed, named).otherwise(flat))
    regex = F.coalesce(
        F.from_json(F.get_json_object(col, "$.regex_replacements"), _REGEX_RULE),
        F.from_json(F.get_json_object(col, "$.regexes"), _REGEX_RULE),
    )
    keep = [c for c in df.columns if c != col]
    a = df.select(*keep, F.posexplode(exact).alias("ord", "e")).select(
        *keep, F.col("e.key").alias("original"), F.col("e.value").alias("replacement"), F.lit(False).alias("is_regex"),
        F.lit("").alias("description"), F.lit(True).alias("enabled"), "ord",
    )
    b = df.select(*keep, F.posexplode(regex).alias("ord", "e")).select(
        *keep, F.col("e.pattern").alias("original"), F.coalesce("e.replacement", F.lit("")).alias("replacement"),
        F.lit(True).alias("is_regex"), F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.enabled", F.lit(True)).alias("enabled"), "ord",
    ).filter("original <> ''")
    return a.filter("replacement IS NOT NULL").unionByName(b)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "raw"))


def rules_json(rules: DataFrame) -> DataFrame:
    """A dictionary as JSON, one row: for equal originals the last rule counts, blank ones are
    left out."""
    named = rules.filter(~is_blank("original"))
    exact = named.filter("NOT is_regex").groupBy("original").agg(
        F.max_by("replacement", "ord").alias("replacement"), F.min("ord").alias("ord")
    )
    pairs = exact.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "original", F.coalesce("replacement", F.lit("")).alias("replacement")))),
            lambda s: F.struct(s["original"].alias("key"), s["replacement"].alias("value")),
        ).alias("e")
    )
    regex = named.filter("is_regex").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", F.col("original").alias("pattern"), F.coalesce("replacement", F.lit("")).alias("replacement"), "description"))),
            lambda s: F.struct(s["pattern"].alias("pattern"), s["replacement"].alias("replacement"),
                               F.nullif(s["description"], F.lit("")).alias("description")),
        ).alias("r")
    )
    return pairs.join(regex).select(
        F.to_json(
            F.struct(F.map_from_entries("e").alias("exact_replacements"), F.col("r").alias("regex_replacements"))
        ).alias("raw")
    )


def write_rules(rules: DataFrame, path: str) -> None:
    rules_json(rules).coalesce(1).write.mode("overwrite").text(path)


# --- XML and plain text ----------------------------------------------------------------

def read_line_xml(spark: SparkSession, root: str, name: str = "*.xml") -> DataFrame:
    """Lines of recogniser XML: ``line_id, kind, text``."""
    lines = (
        spark.read.format("xml").option("rowTag", "LINE").option("attributePrefix", "_")
        .option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .schema("_TYPE STRING, _STRING STRING, _X INT, _Y INT, _WIDTH INT, _HEIGHT INT").load(root)
    )
    path = F.col("_metadata.file_path")
    return lines.select(
        *_page_key(path), F.monotonically_increasing_id().alias("line_id"), line_bucket("_TYPE").alias("kind"),
        F.coalesce("_STRING", F.lit("")).alias("text"), F.col("_X").alias("x"), F.col("_Y").alias("y"),
        F.col("_WIDTH").alias("width"), F.col("_HEIGHT").alias("height"),
    )


def read_figure_xml(spark: SparkSession, root: str, tag: str = "FIGURE", name: str = "*.xml") -> DataFrame:
    """Figure boxes of recogniser XML (``FIGURE`` or ``IMAGE``) over 20 px both ways."""
    boxes = (
        spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_")
        .option("recursiveFileLookup", True).option("pathGlobFilter", name)
        .schema("_X INT, _Y INT, _WIDTH INT, _HEIGHT INT").load(root)
    )
    return boxes.fillna(0).filter("_WIDTH > 20 AND _HEIGHT > 20").select(
        *_page_key(F.col("_metadata.file_path")), F.col("_X").alias("x"), F.col("_Y").alias("y"),
        F.col("_WIDTH").alias("width"), F.col("_HEIGHT").alias("height"),
    )


def with_text_fallback(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages without body lines take the lines of their text file.

    ``lines``: page key, ``line_id``, ``text``; ``texts``: page key, ``text``.
    """
    bare = texts.join(lines.select(*PAGE).distinct(), PAGE, "left_anti")
    split = bare.select(*PAGE, F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    return lines.select(*PAGE, "line_id", "text").unionByName(split)


def read_figures(spark: SparkSession, root: str, limit_kb: int = 500) -> DataFrame:
    """Catalogue of figure files with their size and whether it is over the limit."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "figure_*.*").load(root)
    )
    kb = F.col("length") / 1024
    return files.select(
        *_page_key(F.col("path")), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), kb.alias("size_kb"),
        (F.col("length") > limit_kb * 1024).alias("over_limit"), F.col("content").alias("image"),
    )


# --- page data -------------------------------------------------------------------------

_PAGE_DATA = (
    "STRUCT<PageNumber: INT, Headings: ARRAY<STRING>, Subheadings: ARRAY<STRING>, RemovedHeadings: ARRAY<STRING>, "
    "BodyParagraphs: ARRAY<STRING>, Footnotes: ARRAY<STRING>, Tables: ARRAY<STRUCT<TableName: STRING, "
    "Rows: ARRAY<STRUCT<RowIndex: INT, Cells: ARRAY<STRING>>>>>, Figures: ARRAY<STRUCT<Name: STRING>>>"
)
_FIELDS = {
    "heading": "Headings", "subheading": "Subheadings", "removed": "RemovedHeadings", "body": "BodyParagraphs",
    "footnote": "Footnotes",
}


def parse_page_data(df: DataFrame, col: str = "raw") -> DataFrame:
    """Stored page JSON as page items; figures and tables count as items by name."""
    d = df.select(*PAGE, F.from_json(col, _PAGE_DATA).alias("d"))
    lists = {k: F.col(f"d.{f}") for k, f in _FIELDS.items()}
    lists["table"] = F.transform("d.Tables", lambda t: t["TableName"])
    lists["figure"] = F.transform("d.Figures", lambda t: t["Name"])
    none = F.array().cast("array<struct<kind:string,seq:int,text:string>>")
    items = F.flatten(F.array(*[F.coalesce(_tagged(c, k), none) for k, c in lists.items()]))
    return d.select(*PAGE, F.explode(items).alias("i")).select(*PAGE, "i.kind", "i.seq", "i.text")


def _tagged(texts: Column, kind: str) -> Column:
    return F.transform(
        texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("seq"), F.coalesce(t, F.lit("")).alias("text"))
    )


def load_pages(items: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """Page items as they are worked with: headings cleaned, misfiled ones moved, paragraphs
    unwrapped.  Pages known only by their old text file (``legacy``: page key, ``text``) take their
    paragraphs from it.  A page without content has no rows."""
    if legacy is not None:
        old = legacy.join(items.select(*PAGE).distinct(), PAGE, "left_anti")
        paragraphs = F.filter(F.transform(F.split("text", r"\r?\n\r?\n"), strip), lambda p: p != "")
        items = items.unionByName(
            old.select(*PAGE, F.lit("body").alias("kind"), F.posexplode(paragraphs).alias("seq", "text")).select(
                *PAGE, "kind", "seq", "text"
            )
        )
    items = settle(items)
    titles = reclassify_headings(clean_headings(items))
    body = items.filter("kind = 'body'").select(*PAGE, "seq", "text")
    blocks = unwrap_paragraphs(body, "text").select(
        *PAGE, F.lit("body").alias("kind"), (F.col("seq") * 4096 + F.col("block_no")).alias("seq"), "text"
    )
    others = items.filter("kind NOT IN ('heading', 'subheading', 'body')")
    return titles.unionByName(blocks).unionByName(others)


def read_page_data(spark: SparkSession, root: str) -> DataFrame:
    stored = parse_page_data(read_page_files(spark, root, "page_data.json"))
    legacy = read_page_files(spark, root, "body_reading_order.txt").select(*PAGE, F.col("raw").alias("text"))
    return load_pages(stored, legacy)


def write_page_data(items: DataFrame, path: str) -> None:
    """Store page items as a new version of their pages; other pages are not touched."""
    page_store.append(items, path)


def read_stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every stored page."""
    return page_store.read_latest(spark, path)


def write_reading_order(paragraphs: DataFrame, path: str) -> None:
    """Reading-order text of every page: ``doc_id, page_no, text`` as JSON lines."""
    parts = F.array_sort(F.collect_list(F.struct("para_no", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    paragraphs.groupBy(*PAGE).agg(text.alias("text")).write.mode("overwrite").json(path)


def write_tables(lines: DataFrame, path: str) -> None:
    """Exported table lines as text, the rows of a table together and in order."""
    keyed = lines.repartition(*PAGE, "table_name").sortWithinPartitions(*PAGE, "table_name", "row_index")
    keyed.select("line").write.mode("overwrite").text(path)

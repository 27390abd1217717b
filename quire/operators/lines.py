"""Filters, classification and page-level aggregates over recognised lines and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.geometry import LINE_CLASSES
from quire.functions.text import is_blank, is_mostly_latin, strip

# Marks that count as noise when they stand alone.
NOISE_MARKS = "._,-~|'`\"^*:;・+=/\\()[]{}<>"


def drop_noise_lines(lines: DataFrame) -> DataFrame:
    """Drop blank, tiny and low-confidence lines of the engine output."""
    t = strip("text")
    mark = (F.length(t) == 1) & F.lit(NOISE_MARKS).contains(t)
    conf = F.col("confidence")
    return lines.filter(
        ~is_blank("text")
        & ~(mark & (conf < 0.35))
        & (F.col("width") >= 8)
        & (F.col("height") >= 8)
        & ~((conf > 0.0) & (conf < 0.15))
        & ~((conf == 0.0) & (F.length(t) <= 1))
    )


def drop_display_noise(lines: DataFrame) -> DataFrame:
    """Drop blank lines and, at confidence up to 0.01, single characters and short mark runs."""
    t = strip("text")
    marks = t.rlike(r"(?U)^[\p{P}\s~|`^+=<>ー]*$")
    noise = (F.col("confidence") <= 0.01) & ((F.length(t) <= 1) | ((F.length(t) <= 3) & marks))
    return lines.filter(~is_blank("text") & ~F.coalesce(noise, F.lit(False)))


def drop_empty_recognition(lines: DataFrame) -> DataFrame:
    """Drop lines with confidence 0 and at most three characters."""
    return lines.filter(~((F.col("confidence") == 0.0) & (F.length(strip("text")) <= 3)))


def _box_size() -> tuple[Column, Column]:
    return F.greatest(F.lit(1), F.col("x2") - F.col("x1")), F.greatest(
        F.lit(1), F.col("y2") - F.col("y1")
    )


def with_orientation(blocks: DataFrame) -> DataFrame:
    w, h = _box_size()
    return blocks.withColumn(
        "orientation",
        F.when(h > w * 1.5, "vertical").when(w > h * 1.5, "horizontal").otherwise("unknown"),
    )


def page_sizes(blocks: DataFrame) -> DataFrame:
    """Page width and height: the stored ones, or the outermost block edges when they are
    missing or zero.  ``page_width``/``page_height`` may be absent."""
    for c in ("page_width", "page_height"):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast("int"))
    seen = blocks.groupBy(*PAGE).agg(
        F.max("page_width").alias("_w"),
        F.max("page_height").alias("_h"),
        F.max("x2").alias("_x"),
        F.max("y2").alias("_y"),
    )
    return seen.select(
        *PAGE,
        F.coalesce(F.nullif(F.col("_w"), F.lit(0)), F.col("_x")).cast("int").alias("width"),
        F.coalesce(F.nullif(F.col("_h"), F.lit(0)), F.col("_y")).cast("int").alias("height"),
    )


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Page numbers, header and footer candidates, vertical and horizontal text."""
    sizes = page_sizes(blocks).withColumnRenamed("height", "_ph").drop("width")
    w, h = _box_size()
    t = strip("text")
    digits = F.regexp_replace(t, "[ 　]", "")
    category = (
        F.when((F.length(t) <= 6) & digits.rlike(r"(?U)^\d+$"), "page_number")
        .when((F.col("_ph") > 0) & (F.col("y1") / F.col("_ph") < 0.08), "header_candidate")
        .when((F.col("_ph") > 0) & (F.col("y2") / F.col("_ph") > 0.92), "footer_candidate")
        .when(h > w * 1.5, "body_vertical_candidate")
        .when(w > h * 1.5, "horizontal_candidate")
        .otherwise("unknown")
    )
    return blocks.join(sizes, PAGE).withColumn("category", category).drop("_ph")


def page_direction(
    lines: DataFrame,
    mode: str = "tie_vertical",
    orientation: str = "auto",
    doc_type: str = "japanese",
) -> DataFrame:
    """One row per page: is its text vertical?  Ties are vertical in ``tie_vertical`` mode and
    horizontal in ``strict`` mode, which counts ``orientation`` values of blocks."""
    if mode == "strict":
        vote = F.count_if(F.col("orientation") == "vertical") > F.count_if(
            F.col("orientation") == "horizontal"
        )
    else:
        vote = F.count_if("is_vertical") * 2 >= F.count(F.lit(1))
    if doc_type == "western" or orientation == "horizontal":
        vote = F.max(F.lit(False))
    elif orientation == "vertical":
        vote = F.max(F.lit(True))
    return lines.groupBy(*PAGE).agg(vote.alias("is_vertical"))


def detect_decks(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Two decks when no line centre lies near the middle of the text height."""
    extent = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("y").alias("_top"),
        F.max(F.col("y") + F.col("height")).alias("_bottom"),
    )
    cy = F.col("y") + F.col("height") / 2
    total = F.col("_bottom") - F.col("_top")
    middle = F.col("_top") + total / 2
    counted = (
        lines.join(extent, keys)
        .groupBy(*keys)
        .agg(
            F.max("_n").alias("_n"),
            F.max(total).alias("_h"),
            F.count_if(F.abs(cy - middle) < total / 8).alias("_mid"),
            F.count_if(cy < middle).alias("_up"),
            F.count_if(cy >= middle).alias("_down"),
        )
    )
    two = (
        (F.col("_n") >= 6) & (F.col("_h") >= 100) & (F.col("_mid") == 0)
        & (F.col("_up") >= 2) & (F.col("_down") >= 2)
    )
    return counted.select(*keys, F.when(two, 2).otherwise(1).alias("deck_count"))


def page_metrics(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if("is_vertical").alias("vertical_line_count")
    )


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """Keep the first of lines with equal text, box and direction.

    A grouping aggregate folds copies on the map side, so many copies of one line stay cheap.
    """
    same = [*PAGE, "text", "x", "y", "width", "height", "is_vertical"]
    rest = [c for c in lines.columns if c not in same and c != "line_id"]
    firsts = lines.groupBy(*same).agg(
        F.min("line_id").alias("line_id"),
        *[F.min_by(c, "line_id").alias(c) for c in rest],
    )
    return firsts.select(*lines.columns)


def run_outcomes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latin_runaway(lines: DataFrame) -> DataFrame:
    """Flag tall lines holding a run of five or more Latin letters."""
    flag = (F.col("height") >= F.col("width") * 2) & F.col("text").rlike("[A-Za-z]{5,}")
    return lines.withColumn("flag", F.coalesce(flag, F.lit(False)))


# --- detector boxes ----------------------------------------------------------------

def filter_detections(dets: DataFrame) -> DataFrame:
    """Blocks from confidence 0.20; lines from 0.15 unless large both ways."""
    line = F.col("class_index").isin(LINE_CLASSES)
    huge = (F.col("x2") - F.col("x1") > 120) & (F.col("y2") - F.col("y1") > 120)
    conf = F.coalesce("confidence", F.lit(1.0))
    return dets.filter((~line & (conf >= 0.20)) | (line & (conf >= 0.15) & ~huge))


def plan_tiles(pages: DataFrame, limit: int = 1600, overlap: float = 0.15) -> DataFrame:
    """Tiles of pages larger than ``limit``: two or four, overlapping by ``overlap``."""
    w, h = F.col("width"), F.col("height")
    ox, oy = F.floor(w * overlap).cast("int"), F.floor(h * overlap).cast("int")
    mx, my = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    zero = F.lit(0)

    def tile(x1, y1, x2, y2):
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    columns = [(zero, mx + ox), (mx - ox, w)]
    rows = [(zero, my + oy), (my - oy, h)]
    four = F.array(*[tile(x1, y1, x2, y2) for y1, y2 in rows for x1, x2 in columns])
    across = F.array(*[tile(x1, zero, x2, h) for x1, x2 in columns])
    down = F.array(*[tile(zero, y1, w, y2) for y1, y2 in rows])
    tiles = F.when((w > limit) & (h > limit), four).when(w > limit, across).when(h > limit, down)
    return pages.select(*PAGE, F.posexplode(tiles).alias("tile_no", "t")).select(
        *PAGE, "tile_no", "t.x1", "t.y1", "t.x2", "t.y2"
    )


def offset_tile_boxes(dets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile-local boxes to page coordinates."""
    origin = tiles.select(*PAGE, "tile_no", F.col("x1").alias("_ox"), F.col("y1").alias("_oy"))
    moved = dets.join(origin, [*PAGE, "tile_no"])
    for c in ("x1", "x2"):
        moved = moved.withColumn(c, F.col(c) + F.col("_ox"))
    for c in ("y1", "y2"):
        moved = moved.withColumn(c, F.col(c) + F.col("_oy"))
    return moved.drop("_ox", "_oy")


def merge_spread_halves(left: DataFrame, right: DataFrame, split: DataFrame) -> DataFrame:
    """Lines of the right half of a spread move right by the page's ``split_x``."""
    moved = right.join(split.select(*PAGE, "split_x"), PAGE).withColumn(
        "x", F.col("x") + F.col("split_x")
    )
    return left.unionByName(moved.drop("split_x"))


def route_lines(lines: DataFrame, cascade: bool = True) -> DataFrame:
    """First recogniser tier of a line (30, 50 or 100) and whether its text, once read, would
    escalate to the next tier."""
    w, h = F.col("width"), F.col("height")
    main, cross = F.greatest(w, h), F.least(w, h)
    direct = (main >= 350) | (main >= cross * 6) | F.lit(not cascade)
    tier = (
        F.when(direct, 100)
        .when((F.col("pred_char_count") == 3) & (main < 250), 30)
        .when((F.col("pred_char_count") == 2) & (main < 350), 50)
        .otherwise(100)
    )
    latin = is_mostly_latin("text")
    escalate = (
        F.when(tier == 30, (F.length("text") >= 20) | latin)
        .when(tier == 50, (F.length("text") >= 38) | latin)
        .otherwise(False)
    )
    return lines.withColumns({"tier": tier, "escalate": escalate})


def transform_boxes_back(lines: DataFrame, transforms: DataFrame) -> DataFrame:
    """Boxes of a straightened page back on the original scan.

    ``transforms``: ``disp_y``/``disp_x`` displacement arrays, ``m_inv`` (six numbers, row
    by row), ``orig_width``, ``orig_height``.  Pages without a transform keep their boxes.
    """
    t = lines.join(transforms, PAGE, "left")

    def has(c: str) -> Column:
        return F.coalesce(F.size(c) > 0, F.lit(False))

    def whole(c: Column) -> Column:
        return F.bround(c, 0).cast("int")

    def clip(c: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(c, top.cast("double")))

    orig_w = F.coalesce("orig_width", F.lit(100000))
    orig_h = F.coalesce("orig_height", F.lit(100000))

    def straight(p: Column) -> Column:
        ix = whole(clip(p["x"], F.size("disp_y") - 1))
        iy = whole(clip(p["y"], F.size("disp_x") - 1))
        nx = F.when(~has("disp_y") & has("disp_x"), p["x"] + F.get("disp_x", iy)).otherwise(p["x"])
        ny = F.when(has("disp_y"), p["y"] + F.get("disp_y", ix)).otherwise(p["y"])
        return F.struct(nx.alias("x"), ny.alias("y"))

    def rotated(p: Column) -> Column:
        m = [F.get("m_inv", F.lit(i)) for i in range(6)]
        rx = F.when(has("m_inv"), m[0] * p["x"] + m[1] * p["y"] + m[2]).otherwise(p["x"])
        ry = F.when(has("m_inv"), m[3] * p["x"] + m[4] * p["y"] + m[5]).otherwise(p["y"])
        return F.struct(whole(clip(rx, orig_w)).alias("x"), whole(clip(ry, orig_h)).alias("y"))

    x1, y1 = F.col("x").cast("double"), F.col("y").cast("double")
    x2, y2 = x1 + F.col("width"), y1 + F.col("height")
    corners = F.array(
        *[F.struct(px.alias("x"), py.alias("y")) for px, py in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    )
    points = F.transform(F.transform(corners, straight), rotated)
    moved = has("disp_y") | has("disp_x") | has("m_inv")
    out = t.withColumn("_p", F.when(moved, points))
    xs, ys = F.col("_p.x"), F.col("_p.y")
    new = {
        "x": F.array_min(xs),
        "y": F.array_min(ys),
        "width": F.greatest(F.lit(1), F.array_max(xs) - F.array_min(xs)),
        "height": F.greatest(F.lit(1), F.array_max(ys) - F.array_min(ys)),
    }
    return out.select(*[F.coalesce(new[c], c).alias(c) if c in new else c for c in lines.columns])


# --- page sets ---------------------------------------------------------------------

def expand_page_ranges(df: DataFrame, expr_col: str, min_page: int, max_page: int) -> DataFrame:
    """Page sets written like ``1-5, 8、10~12``: ranges either way round, clamped, distinct.
    ``df`` keeps its other columns; ``page_no`` is 1-based."""
    keep = [c for c in df.columns if c != expr_col]
    tokens = df.select(*keep, F.explode(F.split(F.col(expr_col), "[,、 ]+")).alias("_t"))
    t = strip("_t")
    sep = F.when(t.contains("-"), "-").when(t.contains("〜"), "〜").otherwise("~")
    parts = F.split(t, F.concat(F.lit("["), sep, F.lit("]")))
    a = F.try_to_number(strip(F.get(parts, F.lit(0))), F.lit("999999999"))
    b = F.try_to_number(strip(F.get(parts, F.lit(1))), F.lit("999999999"))
    single = ~t.rlike("[-〜~]")
    ok = F.when(single, a.isNotNull()).otherwise((F.size(parts) == 2) & a.isNotNull() & b.isNotNull())
    b = F.when(single, a).otherwise(b)
    low = F.greatest(F.lit(min_page), F.least(a, b).cast("int"))
    high = F.least(F.lit(max_page), F.greatest(a, b).cast("int"))
    return (
        tokens.filter(ok)
        .select(*keep, low.alias("_low"), high.alias("_high"))
        .filter("_low <= _high")
        .select(*keep, F.explode(F.sequence("_low", "_high")).alias("page_no"))
        .distinct()
    )


def select_pages(
    pages: DataFrame,
    mode: str,
    *,
    current: int | None = None,
    first: int | None = None,
    last: int | None = None,
    modified: DataFrame | None = None,
    chosen: DataFrame | None = None,
    exclude_current: bool = False,
) -> DataFrame:
    """Pick pages by mode: all, current, from_current, odd, even, batch, modified, custom."""
    p = F.col("page_no")
    if mode == "all":
        out = pages
    elif mode == "current":
        out = pages.filter(p == current)
    elif mode == "from_current":
        out = pages.filter(p > current)
    elif mode == "odd":
        out = pages.filter(p % 2 == 1)
    elif mode == "even":
        out = pages.filter(p % 2 == 0)
    elif mode == "batch":
        low, high = sorted((first, last))
        out = pages.filter(p.between(low, high))
    elif mode == "modified":
        out = pages.join(modified.select(*PAGE).distinct(), PAGE, "left_semi")
    elif mode == "custom":
        out = pages.join(chosen.select("page_no").distinct(), "page_no", "left_semi")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.filter(p != current) if exclude_current else out


def ruling_candidates(segments: DataFrame, pages: DataFrame, mode: str = "canonical") -> DataFrame:
    """Ruling segments long enough for a table edge.  ``strict`` is the older 60 % / 40 % rule."""
    share_h, floor_h, share_v, floor_v = (
        (0.25, 30, 0.15, 20) if mode == "canonical" else (0.60, 0, 0.40, 0)
    )
    sized = segments.join(
        pages.select(*PAGE, F.col("width").alias("_pw"), F.col("height").alias("_ph")), PAGE
    )
    need = F.when(
        F.col("orient") == "h", F.greatest(F.lit(float(floor_h)), F.col("_pw") * share_h)
    ).otherwise(F.greatest(F.lit(float(floor_v)), F.col("_ph") * share_v))
    return sized.filter(F.col("length") >= need).drop("_pw", "_ph")

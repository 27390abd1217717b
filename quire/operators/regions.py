"""Regions of a page: assignment of lines, tables, captions, body text and user overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.geometry import int_center, normalize_region_type, region_display_name
from quire.functions.text import given, is_blank
from quire.operators.bands import BAND, band_anti, band_join, grid_join, prefixed
from quire.operators.ordered import first_per, numbered, span
from quire.operators.staging import per_group, settle


def assign_regions(
    lines: DataFrame,
    regions: DataFrame,
    source: str = "user",
    min_overlap: float = 0.5,
    min_area: int = 100,
    legacy: bool = False,
) -> DataFrame:
    """Give every line the first region that holds its centre or enough of its box.

    Adds ``region_seq`` (null without a region) and ``region_type``.  User regions without a
    usable type fall back to their name.  ``legacy`` looks at the centre only, edges included.
    """
    kind = normalize_region_type("type")
    if source == "user" and not legacy:
        kind = F.when((kind == "") | (kind == "unclassified"), normalize_region_type("name")).otherwise(kind)
    least_size = F.lit(1 if source == "auto" else 0)
    boxes = regions.select(
        *PAGE,
        F.col("region_seq").alias("r_seq"),
        kind.alias("r_type"),
        F.col("x").alias("r_x"),
        F.col("y").alias("r_y"),
        (F.col("x") + F.greatest(least_size, "width")).alias("r_x2"),
        (F.col("y") + F.greatest(least_size, "height")).alias("r_y2"),
    )
    items = lines.select(*PAGE, "line_id", "x", "y", "width", "height")
    x2 = F.col("x") + F.greatest(F.lit(1), "width")
    y2 = F.col("y") + F.greatest(F.lit(1), "height")
    cx, cy = int_center("x", "width"), int_center("y", "height")
    if legacy:
        hit = cx.between(F.col("r_x"), F.col("r_x2")) & cy.between(F.col("r_y"), F.col("r_y2"))
    else:
        iw = F.least(x2, "r_x2") - F.greatest("x", "r_x")
        ih = F.least(y2, "r_y2") - F.greatest("y", "r_y")
        shared = iw.cast("long") * ih
        own = (x2 - F.col("x")).cast("long") * (y2 - F.col("y"))
        hit = (
            (cx >= F.col("r_x")) & (cx < F.col("r_x2")) & (cy >= F.col("r_y")) & (cy < F.col("r_y2"))
        ) | ((iw > 0) & (ih > 0) & ((shared >= own * min_overlap) | (shared >= min_area)))
    pairs = band_join(items, boxes, (F.col("y"), y2), (F.col("r_y"), F.col("r_y2")), hit)
    # min_by folds to one row per line before the shuffle.
    best = pairs.groupBy(*PAGE, "line_id").agg(
        F.min("r_seq").alias("region_seq"), F.min_by("r_type", "r_seq").alias("region_type")
    )
    return lines.join(best, [*PAGE, "line_id"], "left").withColumn(
        "region_type", F.coalesce("region_type", F.lit(""))
    )


def route_lines_by_region(lines: DataFrame, user: DataFrame, auto: DataFrame) -> DataFrame:
    """Text type of each line.  Pages with user regions use those alone; other pages use the
    detected ones; pages without any region are body text.  Image text and unmatched lines go."""
    user_pages = user.select(*PAGE).distinct().withColumn("_user", F.lit(True))
    auto_pages = auto.select(*PAGE).distinct().withColumn("_auto", F.lit(True))
    tagged = lines.join(user_pages, PAGE, "left").join(auto_pages, PAGE, "left")
    by_user = assign_regions(tagged.filter("_user"), user, "user")
    by_auto = assign_regions(tagged.filter("_user IS NULL AND _auto"), auto, "auto")
    free = tagged.filter("_user IS NULL AND _auto IS NULL").withColumns(
        {"region_seq": F.lit(None).cast("int"), "region_type": F.lit("body")}
    )
    routed = by_user.unionByName(by_auto).unionByName(free)
    return routed.filter(~F.col("region_type").isin("", "unclassified", "image")).drop("_user", "_auto")


def assign_lines_to_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Text and line count of every cell.  A line belongs to each cell that holds its centre,
    all edges included, so a line centred on an edge counts twice."""
    boxes = cells.select(
        *PAGE, "region_seq", "row_no", "col_no",
        F.col("x").alias("c_x"), F.col("y").alias("c_y"),
        F.col("width").alias("c_w"), F.col("height").alias("c_h"),
    )
    items = lines.select(
        *PAGE, "line_id", "text", (F.col("x") + F.col("width") / 2).alias("cx"),
        (F.col("y") + F.col("height") / 2).alias("cy"),
    )
    inside = (
        (F.col("cx") >= F.col("c_x")) & (F.col("cx") <= F.col("c_x") + F.col("c_w"))
        & (F.col("cy") >= F.col("c_y")) & (F.col("cy") <= F.col("c_y") + F.col("c_h"))
    )
    key = [*PAGE, "region_seq", "row_no", "col_no"]
    filled = (
        band_join(
            items, boxes, (F.col("cy"), F.col("cy")), (F.col("c_y"), F.col("c_y") + F.col("c_h")), inside
        )
        .groupBy(*key)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"]
                ),
                " ",
            ).alias("text"),
            F.count(F.lit(1)).cast("int").alias("ocr_count"),
        )
    )
    return cells.drop("text", "ocr_count").join(filled, key, "left").fillna({"text": "", "ocr_count": 0})


def lines_in_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of the lines that lie in some cell."""
    boxes = cells.select(
        *PAGE, F.col("x").alias("c_x"), F.col("y").alias("c_y"),
        (F.col("x") + F.col("width")).alias("c_x2"), (F.col("y") + F.col("height")).alias("c_y2"),
    )
    items = lines.select(
        *PAGE, "line_id", (F.col("x") + F.col("width") / 2).alias("cx"),
        (F.col("y") + F.col("height") / 2).alias("cy"),
    )
    inside = F.col("cx").between(F.col("c_x"), F.col("c_x2")) & F.col("cy").between(
        F.col("c_y"), F.col("c_y2")
    )
    pairs = band_join(items, boxes, (F.col("cy"), F.col("cy")), (F.col("c_y"), F.col("c_y2")), inside)
    return pairs.select(*PAGE, "line_id").distinct()


def remove_table_lines(
    lines: DataFrame, assigned: DataFrame, tables: DataFrame, include_box: bool = True
) -> DataFrame:
    """Lines that tables have not used up: neither in a cell nor centred inside a table."""
    rest = lines.join(assigned.select(*PAGE, "line_id"), [*PAGE, "line_id"], "left_anti")
    if not include_box:
        return rest
    boxes = tables.select(
        *PAGE, F.col("x").alias("t_x"), F.col("y").alias("t_y"),
        (F.col("x") + F.col("width")).alias("t_x2"), (F.col("y") + F.col("height")).alias("t_y2"),
    )
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = cx.between(F.col("t_x"), F.col("t_x2")) & cy.between(F.col("t_y"), F.col("t_y2"))
    return band_anti(rest, boxes, cy, (F.col("t_y"), F.col("t_y2")), inside)


def table_captions(
    lines: DataFrame, tables: DataFrame, max_gap: int = 40, min_overlap: float = 0.30
) -> DataFrame:
    """The line right above each table: nearest first, then leftmost."""
    boxes = tables.select(
        *PAGE, F.col("region_seq").alias("table_index"), F.col("x").alias("t_x"),
        F.col("y").alias("t_y"), (F.col("x") + F.col("width")).alias("t_x2"),
    )
    items = lines.select(
        *PAGE, "line_id", F.col("x").alias("l_x"), (F.col("x") + F.col("width")).alias("l_x2"),
        (F.col("y") + F.col("height")).alias("l_y2"),
    )
    gap = F.col("t_y") - F.col("l_y2")
    shared = F.least("l_x2", "t_x2") - F.greatest("l_x", "t_x")
    fits = (
        gap.between(0, max_gap)
        & (shared > 0)
        & (shared / F.greatest(F.lit(1), F.col("l_x2") - F.col("l_x")) >= min_overlap)
    )
    pairs = band_join(
        items, boxes, (F.col("l_y2"), F.col("l_y2")), (F.col("t_y") - max_gap, F.col("t_y")), fits
    ).withColumn("gap", gap)
    best = first_per(pairs, [*PAGE, "table_index"], [F.col("gap"), F.col("l_x"), F.col("line_id")])
    return best.select(*PAGE, "table_index", "line_id")


def without_captions(lines: DataFrame, captions: DataFrame) -> DataFrame:
    return lines.join(captions.select(*PAGE, "line_id"), [*PAGE, "line_id"], "left_anti")


# --- ruling segments -----------------------------------------------------------------

def segments_in_regions(segments: DataFrame, regions: DataFrame, tol: int = 3) -> DataFrame:
    """Segments within ``tol`` px of a region and overlapping it, clipped to the region."""
    x, y = F.col("x"), F.col("y")
    x2, y2 = x + F.col("width"), y + F.col("height")

    def side(orient: str, low: Column, high: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(orient).alias("orient"), (low - tol).alias("r_low"), (high + tol).alias("r_high"),
            start.alias("r_start"), end.alias("r_end"),
        )

    sides = regions.select(
        *PAGE, "region_seq",
        F.explode(F.array(side("h", y, y2, x, x2), side("v", x, x2, y, y2))).alias("s"),
    ).select(*PAGE, "region_seq", "s.*")
    start, end = F.greatest("start", "r_start"), F.least("end", "r_end")
    hit = F.col("pos").between(F.col("r_low"), F.col("r_high")) & (end > start)
    pairs = band_join(
        segments.select(*PAGE, "orient", "pos", "start", "end"), sides,
        (F.col("pos"), F.col("pos")), (F.col("r_low"), F.col("r_high")), hit, keys=[*PAGE, "orient"],
    )
    return pairs.select(
        *PAGE, "region_seq", "orient", "pos", start.alias("start"), end.alias("end"),
        (end - start + 1).alias("length"),
    )


#: Segments of a page, and rectangles of a page, that are looked at within one row; of more, rows are joined.
PAGE_SEGMENTS = 64
PAGE_RECTANGLES = 256


def _by_page_size(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of pages with up to ``most`` rows, and those of the other pages if there are any."""
    counts = df.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n"))
    crowded = settle(counts.filter(F.col("_n") > most).select(*PAGE))
    if crowded.isEmpty():
        return df, None
    return df.join(crowded, PAGE, "left_anti"), df.join(crowded, PAGE, "left_semi")


def _bordered_by_page(
    segments: DataFrame, pages: DataFrame, open_tables: bool, min_size: int, touch: int, overhang: int
) -> DataFrame:
    """``bordered_regions`` of pages with few segments, each page in one row."""
    rule = F.struct("pos", "start", "end", F.col("ord").isNull().alias("no_ord"), "ord")
    grouped = segments.groupBy(*PAGE).agg(
        F.array_sort(F.collect_set(F.when(F.col("orient") == "h", rule))).alias("_all"),
        F.collect_set(F.when(F.col("orient") == "v", F.struct("pos", "start", "end"))).alias("_posts"),
    )
    # Of equal rules the first one stays.
    place = lambda r: F.struct(r["pos"], r["start"], r["end"])
    fresh = F.filter("_all", lambda r, i: (i == 0) | (place(r) != place(F.get("_all", i - 1))))
    grouped = grouped.filter(F.size("_all") > 1).select(*PAGE, F.explode(F.array(fresh)).alias("_rules"), "_posts")
    least = F.greatest(F.lit(float(min_size)), F.col("width") * 0.2).alias("_least")
    if open_tables:
        grouped = grouped.join(pages.select(*PAGE, least), PAGE, "left")

    def box(p: Column) -> Column:
        y1, y2, cx1, cx2 = p["y1"], p["y2"], p["cx1"], p["cx2"]
        crossing = F.filter(
            "_posts", lambda v: v["pos"].between(cx1, cx2) & (v["start"] - touch <= y1) & (y2 <= v["end"] + touch)
        )

        def framed(xs: Column) -> Column:
            vl, vr = F.array_min(xs), F.array_max(xs)
            x1 = F.when(vl - cx1 > overhang, cx1).otherwise(vl)
            x2 = F.when(cx2 - vr > overhang, cx2).otherwise(vr)
            closed = F.when(vl < vr, F.struct(x1.alias("x1"), x2.alias("x2")))
            if not open_tables:
                return closed
            inner = F.exists(
                "_rules", lambda m: (m["pos"] > y1 + 5) & (m["pos"] < y2 - 5) & (F.greatest(m["start"], cx1) < F.least(m["end"], cx2))
            ) | F.exists(
                "_posts", lambda v: v["pos"].between(cx1 - 10, cx2 + 10) & (v["start"] <= y2 + 15) & (v["end"] >= y1 - 15)
            )
            return F.coalesce(closed, F.when((cx2 - cx1 >= F.col("_least")) & inner, F.struct(cx1.alias("x1"), cx2.alias("x2"))))

        sides = given(F.transform(crossing, lambda v: v["pos"]), framed)
        return given(
            sides,
            lambda s: F.struct(
                p["t_ord"].alias("t_ord"), p["b_ord"].alias("b_ord"), s["x1"].alias("x"), y1.alias("y"),
                (s["x2"] - s["x1"]).alias("width"), (y2 - y1).alias("height"),
            ),
        )

    def under(t: Column) -> Column:
        below = F.filter("_rules", lambda b: (b["pos"] - t["pos"] >= min_size) & (t["ord"] < b["ord"]))
        return F.transform(
            below,
            lambda b: given(
                F.struct(
                    t["ord"].alias("t_ord"), b["ord"].alias("b_ord"), t["pos"].alias("y1"), b["pos"].alias("y2"),
                    F.greatest(t["start"], b["start"]).alias("cx1"), F.least(t["end"], b["end"]).alias("cx2"),
                ),
                box,
            ),
        )

    boxes = F.filter(F.flatten(F.transform("_rules", under)), lambda r: (r["width"] >= min_size) & (r["height"] >= min_size))
    found = grouped.select(*PAGE, F.posexplode(F.array_sort(F.array_distinct(boxes))).alias("_i", "_r"))
    return found.select(*PAGE, (F.col("_i") + 1).alias("region_seq"), "_r.x", "_r.y", "_r.width", "_r.height")


def bordered_regions(
    segments: DataFrame,
    pages: DataFrame,
    open_tables: bool = True,
    min_size: int = 30,
    touch: int = 5,
    overhang: int = 40,
) -> DataFrame:
    """Rectangles between two horizontal rules: closed by connecting verticals, or open with
    rules on top and bottom and some inner rule.

    Closed ones are found through the verticals: each meets the rules it crosses, and two rules
    that share two verticals are an answer.  Open ones are pairs of rules that overlap over a
    fifth of the page's width, so only rules of that length are paired; whether a pair has an
    inner rule is asked without making a row for each.  A page with few segments is settled
    within one row.  Equal rules are folded first.  Segments
    with a null in any place are no rules; a page without a known width has no open rectangles.
    """
    used = segments.dropna(subset=[*PAGE, "pos", "start", "end"]).select(*PAGE, "orient", "pos", "start", "end", "ord")
    few, many = _by_page_size(settle(used), PAGE_SEGMENTS)
    out = _bordered_by_page(few, pages, open_tables, min_size, touch, overhang)
    return out if many is None else out.unionByName(_bordered_by_rows(many, pages, open_tables, min_size, touch, overhang))


def _bordered_by_rows(
    segments: DataFrame, pages: DataFrame, open_tables: bool, min_size: int, touch: int, overhang: int
) -> DataFrame:
    rules = segments.filter("orient = 'h'").groupBy(*PAGE, "pos", "start", "end").agg(
        F.min("ord").alias("ord")
    )
    uprights = segments.filter("orient = 'v'").select(
        *PAGE, F.col("pos").alias("v_x"), F.col("start").alias("v_y1"), F.col("end").alias("v_y2")
    ).distinct()
    side = ["ord", "pos", "start", "end"]
    upright = [*PAGE, "v_x", "v_y1", "v_y2"]
    met = settle(
        grid_join(
            uprights, prefixed(rules, "r_"),
            (F.col("v_x"), F.col("v_y1") - touch, F.col("v_x"), F.col("v_y2") + touch),
            (F.col("r_start"), F.col("r_pos"), F.col("r_end"), F.col("r_pos")),
            F.col("v_x").between(F.col("r_start"), F.col("r_end"))
            & F.col("r_pos").between(F.col("v_y1") - touch, F.col("v_y2") + touch),
        )
    )
    top = met.select(*upright, *[F.col(f"r_{c}").alias(f"t_{c}") for c in side])
    bottom = met.select(*upright, *[F.col(f"r_{c}").alias(f"b_{c}") for c in side])
    below = (F.col("b_pos") - F.col("t_pos") >= min_size) & (F.col("t_ord") < F.col("b_ord"))
    cx1, cx2 = F.greatest("t_start", "b_start"), F.least("t_end", "b_end")
    spans = [F.col("t_pos").alias("y1"), F.col("b_pos").alias("y2"), cx1.alias("cx1"), cx2.alias("cx2")]
    key = [*PAGE, "t_ord", "b_ord"]
    closed = (
        top.join(bottom, upright).filter(below).select(*key, *spans, "v_x")
        .groupBy(*key, "y1", "y2", "cx1", "cx2").agg(F.min("v_x").alias("vl"), F.max("v_x").alias("vr"))
        .filter("vl < vr")
    )
    closed = settle(closed) if open_tables else closed
    out = closed.select(
        *key, "y1", "y2",
        F.when(F.col("vl") - F.col("cx1") > overhang, F.col("cx1")).otherwise(F.col("vl")).alias("x1"),
        F.when(F.col("cx2") - F.col("vr") > overhang, F.col("cx2")).otherwise(F.col("vr")).alias("x2"),
    )
    if open_tables:
        widths = pages.select(*PAGE, F.greatest(F.lit(float(min_size)), F.col("width") * 0.2).alias("_least"))
        long = settle(rules.join(widths, PAGE).filter(F.col("end") - F.col("start") >= F.col("_least")))
        wide = (
            prefixed(long, "t_").join(prefixed(long.drop("_least"), "b_"), PAGE)
            .filter(below & (cx2 - cx1 >= F.col("t__least"))).select(*key, *spans)
            .join(closed.select(*key), key, "left_anti")
        )
        same_page = lambda p: (F.col("doc_id") == F.col(f"{p}doc_id")) & (F.col("page_no") == F.col(f"{p}page_no"))
        inner = rules.toDF(*[f"m_{c}" for c in rules.columns])
        has_rule = (
            same_page("m_") & (F.col("m_pos") > F.col("y1") + 5) & (F.col("m_pos") < F.col("y2") - 5)
            & (F.greatest("m_start", "cx1") < F.least("m_end", "cx2"))
        )
        posts = uprights.toDF("p_doc_id", "p_page_no", "v_x", "v_y1", "v_y2")
        has_upright = (
            same_page("p_") & F.col("v_x").between(F.col("cx1") - 10, F.col("cx2") + 10)
            & (F.col("v_y1") <= F.col("y2") + 15) & (F.col("v_y2") >= F.col("y1") - 15)
        )
        wide = settle(wide)
        opened = wide.join(inner, has_rule, "left_semi").unionByName(
            wide.join(inner, has_rule, "left_anti").join(posts, has_upright, "left_semi")
        )
        out = out.unionByName(opened.select(*key, "y1", "y2", F.col("cx1").alias("x1"), F.col("cx2").alias("x2")))
    sized = out.select(
        *key, F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"),
        (F.col("y2") - F.col("y1")).alias("height"),
    ).filter((F.col("width") >= min_size) & (F.col("height") >= min_size))
    order = [F.col("t_ord"), F.col("b_ord")]
    seq = numbered(settle(sized), PAGE, order, span("t_ord", 512), "region_seq")
    return seq.select(*PAGE, "region_seq", "x", "y", "width", "height")


def drop_contained(regions: DataFrame, margin: int = 5, mode: str = "all") -> DataFrame:
    """Drop rectangles that lie inside a larger kept one, give or take ``margin`` px.
    ``largest`` keeps one rectangle per page."""
    area = (F.col("width").cast("long") * F.col("height")).alias("area")
    if mode == "largest":
        return first_per(regions, PAGE, [-area, F.col("region_seq")])
    few, many = _by_page_size(settle(regions), PAGE_RECTANGLES)
    kept = _outermost_by_page(few, margin)
    return kept if many is None else kept.unionByName(_outermost_by_rows(many, margin))


def _outermost_by_page(regions: DataFrame, margin: int) -> DataFrame:
    """``drop_contained`` of pages with few rectangles: from the largest on, each is held against those kept."""
    rest = [c for c in regions.columns if c not in PAGE]
    size = F.struct((-F.col("width").cast("long") * F.col("height")).alias("a"), F.col("region_seq").alias("s"))
    rows = F.collect_list(F.struct(size.alias("k"), F.struct(*rest).alias("r")))
    by_size = lambda p, q: F.when(p["k"] < q["k"], -1).when(p["k"] > q["k"], 1).otherwise(0)

    def holds(o: Column, i: Column) -> Column:
        return (
            (o["x"] <= i["x"] + margin) & (o["y"] <= i["y"] + margin)
            & (o["x"] + o["width"] >= i["x"] + i["width"] - margin) & (o["y"] + o["height"] >= i["y"] + i["height"] - margin)
        )

    def add(kept: Column, row: Column) -> Column:
        return F.when(F.exists(kept, lambda o: F.coalesce(holds(o, row), F.lit(False))), kept).otherwise(F.concat(kept, F.array(row)))

    row = regions.select(F.struct(*rest)).schema[0].dataType.simpleString()
    ordered = F.transform(F.array_sort(rows, by_size), lambda p: p["r"])
    kept = F.aggregate(ordered, F.array().cast(f"array<{row}>"), add)
    return regions.groupBy(*PAGE).agg(F.explode(kept).alias("_r")).select(*PAGE, "_r.*").select(*regions.columns)


def _outermost_by_rows(regions: DataFrame, margin: int) -> DataFrame:
    # Equal rectangles cannot both stay: the first one contains the others.
    ranked = regions.groupBy(*PAGE, "x", "y", "width", "height").agg(F.min("region_seq").alias("region_seq"))
    ranked = settle(ranked.withColumn("area", F.col("width").cast("long") * F.col("height")))
    # The largest rectangle of a page always stays.  What it holds is gone at once, and on
    # most pages that is everything.
    largest = first_per(ranked, PAGE, [-F.col("area"), F.col("region_seq")])
    big = prefixed(largest, "o_")

    def holds(inner: str) -> Column:
        return (
            (F.col("o_x") <= F.col(f"{inner}x") + margin) & (F.col("o_y") <= F.col(f"{inner}y") + margin)
            & (F.col("o_x") + F.col("o_width") >= F.col(f"{inner}x") + F.col(f"{inner}width") - margin)
            & (F.col("o_y") + F.col("o_height") >= F.col(f"{inner}y") + F.col(f"{inner}height") - margin)
        )

    rest = settle(ranked.join(big, PAGE).filter(~holds("")).select(*ranked.columns))
    outer, inner = prefixed(rest, "o_"), prefixed(rest, "i_")
    earlier = (F.col("o_area") > F.col("i_area")) | (
        (F.col("o_area") == F.col("i_area")) & (F.col("o_region_seq") < F.col("i_region_seq"))
    )
    pairs = band_join(
        outer, inner,
        (F.col("o_y") - margin, F.col("o_y") + F.col("o_height") + margin),
        (F.col("i_y"), F.col("i_y") + F.col("i_height")),
        earlier & holds("i_"),
    ).select(*PAGE, F.col("o_region_seq").alias("outer_seq"), F.col("i_region_seq").alias("inner_seq"))
    pairs = settle(pairs)
    held = pairs.select(*PAGE, F.col("inner_seq").alias("region_seq")).distinct()
    sure = rest.join(held, [*PAGE, "region_seq"], "left_anti")
    sure_keys = sure.select(*PAGE, F.col("region_seq").alias("outer_seq"))
    gone = pairs.join(sure_keys, [*PAGE, "outer_seq"], "left_semi").select(
        *PAGE, F.col("inner_seq").alias("region_seq")
    ).distinct()
    # What is left is held only by rectangles that are held themselves: the margin makes
    # containment a chain there, and the pairs of such a page are walked in order.
    open_seq = held.join(gone, [*PAGE, "region_seq"], "left_anti")
    open_pairs = (
        pairs.join(open_seq.withColumnRenamed("region_seq", "inner_seq"), [*PAGE, "inner_seq"], "left_semi")
        .join(rest.select(*PAGE, F.col("region_seq").alias("inner_seq"), -F.col("area")), [*PAGE, "inner_seq"])
        .join(
            gone.select(*PAGE, F.col("region_seq").alias("outer_seq"), F.lit(True).alias("outer_gone")),
            [*PAGE, "outer_seq"], "left",
        )
        .toDF("doc_id", "page_no", "outer_seq", "inner_seq", "neg_area", "outer_gone")
    )

    def walk(rows: list[tuple]) -> list[tuple]:
        dropped = {r[2] for r in rows if r[5]}
        holders: dict[int, list[int]] = {}
        for r in rows:
            holders.setdefault(r[3], []).append(r[2])
        kept = []
        for seq, outers in holders.items():
            if all(o in dropped for o in outers):
                kept.append((rows[0][0], rows[0][1], seq))
            else:
                dropped.add(seq)
        return kept

    chained = per_group(
        open_pairs, PAGE, ["neg_area", "inner_seq"], walk, "doc_id long, page_no int, region_seq int"
    )
    kept = largest.select(*PAGE, "region_seq").unionByName(sure.select(*PAGE, "region_seq")).unionByName(chained)
    return regions.join(kept, [*PAGE, "region_seq"], "left_semi")


# --- positions ---------------------------------------------------------------------

def _position_runs(positions: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Distinct positions of a key in runs with no gap above ``tol``.

    Positions are pixels, so a key has at most one entry per pixel here and its list is short.
    """
    counted = positions.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("_all"))
    every = F.col("_all")

    def opens(i: Column) -> Column:
        return F.coalesce(F.get(every, i)["pos"] - F.get(every, i - 1)["pos"] > tol, F.lit(True))

    def cut(starts: Column) -> Column:
        return F.transform(
            starts, lambda i, k: F.slice(every, i + 1, F.coalesce(F.get(starts, k + 1), F.size(every)) - i)
        )

    starts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), opens)
    return whole.select(*keys, F.explode(given(starts, cut)).alias("_ps"))


def cluster_positions(positions: DataFrame, tol: int, keys: list[str] | None = None) -> DataFrame:
    """Cluster sorted positions: join the last cluster when within ``tol`` of its mean.
    Output is the mean of each cluster, rounded half to even."""
    keys = keys or [c for c in positions.columns if c != "pos"]
    runs = _position_runs(positions, keys, tol)
    start = F.array().cast("array<struct<s:bigint,n:bigint>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        value = F.struct((p["pos"] * p["n"]).cast("long").alias("s"), p["n"].cast("long").alias("n"))
        joined = F.struct(
            (last["s"] + p["pos"] * p["n"]).cast("long").alias("s"), (last["n"] + p["n"]).alias("n")
        )
        fresh = (F.size(acc) == 0) | (F.abs(p["pos"] - last["s"] / last["n"]) > tol)
        return F.when(fresh, F.concat(acc, F.array(value))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        )

    out = runs.select(*keys, F.explode(F.aggregate("_ps", start, add)).alias("c"))
    return out.select(*keys, F.bround(F.col("c.s") / F.col("c.n"), 0).cast("int").alias("pos"))


def merge_positions(positions: DataFrame, tol: int = 8, keys: list[str] | None = None) -> DataFrame:
    """Merge sorted rule positions: a position within ``tol`` of the last kept one moves that
    one to their midpoint, rounded half to even."""
    keys = keys or [c for c in positions.columns if c != "pos"]
    runs = _position_runs(positions, keys, tol)
    # Halving a distance of at most ``tol`` settles after a few steps, so repeats beyond
    # ``tol`` change nothing.
    steps = F.flatten(
        F.transform("_ps", lambda p: F.array_repeat(p["pos"].cast("int"), F.least(p["n"], F.lit(tol + 2)).cast("int")))
    )
    start = F.array().cast("array<int>")

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.abs(p - last) <= tol)
        middle = F.bround((last + p) / 2, 0).cast("int")
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(middle))).otherwise(
            F.concat(acc, F.array(p))
        )

    return runs.select(*keys, F.explode(F.aggregate(steps, start, add)).alias("pos"))


def cells_from_positions(positions: DataFrame) -> DataFrame:
    """Cells between consecutive vertical and horizontal positions of a region.

    Positions are pixels, so the two lists of a region are short and travel in one row; its cells come out of that row.
    """
    key = [*PAGE, "region_seq"]

    def lists(orient: str) -> list[Column]:
        mine = F.col("orient") == orient
        # A position that is null stands first in order and opens no gap, but counts.
        return [
            F.array_sort(F.collect_list(F.when(mine, F.col("pos")))).alias(f"_{orient}"),
            F.count_if(mine & F.col("pos").isNull()).cast("int").alias(f"_{orient}0"),
        ]

    def gaps(orient: str, no: str, at: str, size: str) -> Column:
        def gap(p: Column, i: Column) -> Column:
            return F.struct(
                (i + 1 + F.col(f"_{orient}0")).alias(no), p.alias(at),
                (F.get(F.col(f"_{orient}"), i + 1) - p).alias(size),
            )

        return F.inline(F.filter(F.transform(f"_{orient}", gap), lambda g: g[size] > 0))

    whole = positions.groupBy(*key).agg(*lists("h"), *lists("v"))
    whole = whole.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
    rows = whole.select(*key, "_v", "_v0", gaps("h", "row_no", "y", "height"))
    cells = rows.select(*key, "row_no", "y", "height", gaps("v", "col_no", "x", "width"))
    return cells.select(*key, "row_no", "col_no", "x", "y", "width", "height")


# --- tables --------------------------------------------------------------------------

def order_tables(tables: DataFrame, split_x: int = 1650) -> DataFrame:
    """Adds ``table_seq``: left page or column first, then top to bottom."""
    right = (F.col("x") >= split_x).cast("int")
    order = [right, F.col("y"), F.col("region_seq")]
    return numbered(tables, PAGE, order, F.struct(right.alias("a"), span("y", BAND).alias("b")), "table_seq")


def order_regions(regions: DataFrame, orientation: str = "horizontal") -> DataFrame:
    """Adds ``order_seq``: by coarse column (right to left for vertical text), then ``y``."""
    if orientation == "vertical":
        column = -(F.floor(F.col("x") / 400))
    else:
        column = F.floor(F.col("x") / 500)
    order = [column, F.col("y"), F.col("region_seq")]
    return numbered(regions, PAGE, order, F.struct(column.alias("a"), span("y", BAND).alias("b")), "order_seq")


def table_summary(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Name, row and column counts and inner rule positions of every table."""
    key = [*PAGE, "region_seq"]
    named = order_tables(regions).withColumn("name", F.concat(F.lit("表"), F.col("table_seq")))
    shape = cells.groupBy(*key).agg(
        F.countDistinct("row_no").cast("int").alias("rows"), F.countDistinct("col_no").cast("int").alias("columns")
    )
    edges = cells.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit("h").alias("o"), F.col("y").alias("pos")),
                F.struct(F.lit("h").alias("o"), (F.col("y") + F.col("height")).alias("pos")),
                F.struct(F.lit("v").alias("o"), F.col("x").alias("pos")),
                F.struct(F.lit("v").alias("o"), (F.col("x") + F.col("width")).alias("pos")),
            )
        ).alias("e"),
    ).select(*key, "e.o", "e.pos").distinct()
    extents = regions.select(
        *key, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh")
    )
    low = F.when(F.col("o") == "h", F.col("ry")).otherwise(F.col("rx")) + 2
    high = F.when(F.col("o") == "h", F.col("ry") + F.col("rh")).otherwise(F.col("rx") + F.col("rw")) - 2
    inner = edges.join(extents, key).filter((F.col("pos") > low) & (F.col("pos") < high))
    merged = cluster_positions(inner.select(*key, "o", "pos"), 4, [*key, "o"])
    lists = merged.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("o") == "h", F.col("pos")))).alias("horizontal_lines"),
        F.array_sort(F.collect_list(F.when(F.col("o") == "v", F.col("pos")))).alias("vertical_lines"),
    )
    none = F.array().cast("array<int>")
    return (
        named.select(*key, "name", "x", "y", "width", "height")
        .join(shape, key, "left")
        .join(lists, key, "left")
        .select(
            *key, "name", "x", "y", "width", "height",
            F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"),
            F.coalesce("horizontal_lines", none).alias("horizontal_lines"),
            F.coalesce("vertical_lines", none).alias("vertical_lines"),
        )
    )


def match_table(tables: DataFrame, replacement: DataFrame) -> DataFrame:
    """Which table of the page a re-read table replaces: same name, then the name of its
    region, then its ordinal, then the only table.  ``table_seq`` is null when none fits.

    ``replacement``: page key, ``table_name``, ``region_name``, ``table_index`` (0-based).
    """
    mine = tables.select(*PAGE, F.col("table_seq").alias("t_seq"), F.lower("table_name").alias("t_name"))
    counted = tables.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("t_count"))
    region = F.col("region_name")
    named = ~is_blank(region) & ~region.isin("表", "＋ 表")
    rank = (
        F.when(F.col("t_name") == F.lower("table_name"), 1)
        .when(named & (F.col("t_name") == F.lower(region)), 2)
        .when((F.col("table_index") >= 0) & (F.col("t_seq") == F.col("table_index") + 1), 3)
        .when(F.col("t_count") == 1, 4)
    )
    found = (
        replacement.join(mine, PAGE).join(counted, PAGE)
        .groupBy(*PAGE, "table_name", "region_name", "table_index")
        .agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("t_seq").alias("s")))).alias("m"))
    )
    keys = [*PAGE, "table_name", "region_name", "table_index"]
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return (
        replacement.alias("a").join(found.alias("b"), on, "left")
        .select(*[F.col(f"a.{c}") for c in replacement.columns], F.col("b.m.s").alias("table_seq"))
    )


def borrow_rule_lines(tables: DataFrame, auto_tables: DataFrame, tol: int = 30) -> DataFrame:
    """Tables without vertical (or horizontal) rules take those of the first detected table
    whose corner lies within ``tol`` px.  ``rule_lines`` is ``ARRAY<STRUCT<is_vertical, pos, start, end>>``."""
    key = [*PAGE, "region_seq"]
    mine = tables.select(*key, F.col("x").alias("t_x"), F.col("y").alias("t_y"))
    auto = auto_tables.select(
        *PAGE, F.col("region_seq").alias("a_seq"), F.col("x").alias("a_x"), F.col("y").alias("a_y"),
        F.col("rule_lines").alias("a_rules"),
    )
    near = (F.abs(F.col("a_x") - F.col("t_x")) < tol) & (F.abs(F.col("a_y") - F.col("t_y")) < tol)
    pairs = band_join(
        mine, auto, (F.col("t_y"), F.col("t_y")), (F.col("a_y") - tol, F.col("a_y") + tol), near
    )
    best = first_per(pairs, key, [F.col("a_seq")]).select(*key, "a_rules")
    none = F.array().cast(tables.schema["rule_lines"].dataType)
    own = F.coalesce("rule_lines", none)
    other = F.coalesce("a_rules", none)

    def of(rules: Column, vertical: bool) -> Column:
        return F.filter(rules, lambda r: r["is_vertical"] == vertical)

    def pick(vertical: bool) -> Column:
        mine_ = of(own, vertical)
        return F.when(F.size(mine_) > 0, mine_).otherwise(of(other, vertical))

    joined = tables.join(best, key, "left")
    return joined.withColumn("rule_lines", F.concat(pick(False), pick(True))).drop("a_rules")


# --- body regions --------------------------------------------------------------------

def body_regions(
    lines: DataFrame,
    variant: str = "adaptive",
    orientation: str = "auto",
    doc_type: str = "japanese",
) -> DataFrame:
    """Body text boxes: lines fall into groups at gaps in x (vertical) or y (horizontal).

    Lines are first folded to one row per distinct coordinate, at most one per pixel, so the
    windows over a page stay small however many lines it has.
    """
    if doc_type == "western" or orientation == "horizontal":
        vertical = F.lit(False)
    elif orientation == "vertical":
        vertical = F.lit(True)
    else:
        vertical = F.coalesce("is_vertical", F.lit(False))
    placed = lines.withColumn("_v", vertical)
    if variant == "simple":
        placed = placed.withColumn("part", F.when(F.col("_v"), "本文").otherwise("本文横"))
    else:
        placed = _with_page_sides(placed)
    coord = F.when(F.col("_v"), -F.col("x")).otherwise(F.col("y"))
    size = F.when(F.col("_v"), F.col("width")).otherwise(F.col("height"))
    part = [*PAGE, "part", "_v"]
    full = F.lit(True) if variant == "simple" else ~is_blank("text")

    def bounds(mark: str, keep: Column) -> list[Column]:
        return [
            F.count_if(keep).alias(f"{mark}n"),
            F.min(F.when(keep, F.col("x"))).alias(f"{mark}x1"),
            F.min(F.when(keep, F.col("y"))).alias(f"{mark}y1"),
            F.max(F.when(keep, F.col("x") + F.col("width"))).alias(f"{mark}x2"),
            F.max(F.when(keep, F.col("y") + F.col("height"))).alias(f"{mark}y2"),
        ]

    spots = placed.withColumn("_c", coord).groupBy(*part, "_c").agg(*bounds("f_", full), *bounds("a_", F.lit(True)))
    if variant == "simple":
        spots = spots.withColumn("_limit", F.when(F.col("_v"), 30).otherwise(20))
    else:
        limits = placed.groupBy(*part).agg(F.median(size).alias("_m"))
        limit = F.greatest(F.when(F.col("_v"), 45).otherwise(60), F.floor(F.col("_m") * 2.2))
        spots = spots.join(limits, part).withColumn("_limit", limit)
    w = Window.partitionBy(*part).orderBy("_c")
    new = F.coalesce(F.col("_c") - F.lag("_c").over(w) > F.col("_limit"), F.lit(True)).cast("int")
    groups = spots.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    folded = groups.groupBy(*part, "_g").agg(
        *[F.sum(f"{m}n").alias(f"{m}n") for m in ("f_", "a_")],
        *[F.min(f"{m}{c}").alias(f"{m}{c}") for m in ("f_", "a_") for c in ("x1", "y1")],
        *[F.max(f"{m}{c}").alias(f"{m}{c}") for m in ("f_", "a_") for c in ("x2", "y2")],
    )

    def pick(c: str) -> Column:
        return F.when(F.col("f_n") > 0, F.col(f"f_{c}")).otherwise(F.col(f"a_{c}"))

    boxes = folded.select(*part, "_g", *[pick(c).alias(c) for c in ("n", "x1", "y1", "x2", "y2")])
    if variant == "simple":
        boxes = first_per(boxes, part, [-F.col("n"), F.col("_g")])
        name = F.col("part")
    else:
        many = F.count(F.lit(1)).over(Window.partitionBy(*part)) > 1
        name = F.when(many, F.concat("part", F.lit("_"), F.col("_g").cast("string"))).otherwise(F.col("part"))
    return boxes.select(
        *PAGE, name.alias("name"), F.lit("body").alias("type"),
        F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"),
        (F.col("x2") - F.col("x1")).cast("int").alias("width"),
        (F.col("y2") - F.col("y1")).cast("int").alias("height"),
        F.when(F.col("_v"), "vertical").otherwise("horizontal").alias("orientation"),
        F.col("n").cast("int").alias("ocr_count"),
    )


def _with_page_sides(placed: DataFrame) -> DataFrame:
    """Name the half a horizontal line belongs to when the page has two columns or pages."""
    flat = placed.filter(~F.col("_v"))
    extent = flat.groupBy(*PAGE).agg(
        F.min("x").alias("_x1"), F.max(F.col("x") + F.col("width")).alias("_x2")
    )
    left = F.col("x") + F.col("width") / 2 < F.col("_x1") + (F.col("_x2") - F.col("_x1")) / 2
    halves = (
        flat.join(extent, PAGE)
        .withColumn("_left", left)
        .groupBy(*PAGE)
        .agg(
            F.max("_x1").alias("_x1"),
            F.max("_x2").alias("_x2"),
            F.count_if("_left").alias("_nl"),
            F.count_if(~F.col("_left")).alias("_nr"),
            F.max(F.when(F.col("_left"), F.col("x") + F.col("width"))).alias("_ledge"),
            F.min(F.when(~F.col("_left"), F.col("x"))).alias("_redge"),
        )
        .withColumn("_span", F.col("_x2") - F.col("_x1"))
        .withColumn(
            "_two",
            (F.col("_nl") >= 3) & (F.col("_nr") >= 3)
            & ((F.col("_redge") - F.col("_ledge") >= 15) | (F.col("_span") > 450)),
        )
        .select(*PAGE, "_x1", "_x2", "_two", "_span")
    )
    side = F.when(left, "左").otherwise("右")
    unit = F.when(F.col("_span") > 550, "ページ本文").otherwise("段本文")
    part = (
        F.when(F.col("_v"), "本文")
        .when(F.coalesce("_two", F.lit(False)), F.concat(side, unit))
        .otherwise("本文横")
    )
    return placed.join(halves, PAGE, "left").withColumn("part", part).drop("_x1", "_x2", "_two", "_span")


# --- user and detected regions -------------------------------------------------------

def effective_regions(user: DataFrame, auto: DataFrame) -> DataFrame:
    """User regions replace the detected ones page by page."""
    rest = auto.join(user.select(*PAGE).distinct(), PAGE, "left_anti")
    return user.unionByName(rest, allowMissingColumns=True)


def changed_pages(user: DataFrame, auto: DataFrame) -> DataFrame:
    """Pages whose user regions are not the detected ones, compared region by region."""
    fields = [c for c in ("x", "y", "width", "height", "type", "rule_lines") if c in user.columns and c in auto.columns]
    a = user.select(*PAGE, "region_seq", F.struct(*fields).alias("mine"))
    b = auto.join(user.select(*PAGE).distinct(), PAGE, "left_semi").select(
        *PAGE, "region_seq", F.struct(*fields).alias("theirs")
    )
    both = a.join(b, [*PAGE, "region_seq"], "full")
    return both.filter(~F.col("mine").eqNullSafe(F.col("theirs"))).select(*PAGE).distinct()


def copy_regions(regions: DataFrame, source: DataFrame, targets: DataFrame) -> DataFrame:
    """Put the regions of each document's source page on its target pages.

    ``source``: ``doc_id, page_no``; ``targets``: ``doc_id, page_no``.  The source page is
    skipped, what the targets had is replaced.
    """
    goal = targets.join(source, PAGE, "left_anti").distinct()
    model = regions.join(source, PAGE, "left_semi").drop("page_no")
    kept = regions.join(goal, PAGE, "left_anti")
    return kept.unionByName(goal.join(model, "doc_id").select(*regions.columns))


def to_user_regions(auto: DataFrame) -> DataFrame:
    """Detected regions as user regions: canonical type, default name and orientation, and
    rule lines with ordered ends; a rule without ends spans its region."""
    kind = normalize_region_type("type")
    x, y = F.col("x"), F.col("y")

    def whole(r: Column) -> Column:
        unset = (r["start"] == 0) & (r["end"] == 0)
        start = F.when(r["is_vertical"], y).otherwise(x)
        end = start + F.when(r["is_vertical"], F.col("height")).otherwise(F.col("width"))
        return F.struct(
            r["is_vertical"].alias("is_vertical"),
            r["pos"].alias("pos"),
            F.when(unset, start).otherwise(F.least(r["start"], r["end"])).alias("start"),
            F.when(unset, end).otherwise(F.greatest(r["start"], r["end"])).alias("end"),
        )

    new = {
        "type": kind,
        "name": F.when(F.coalesce("name", F.lit("")) == "", region_display_name(kind)).otherwise(F.col("name")),
        "orientation": F.when(F.coalesce("orientation", F.lit("")) == "", "auto").otherwise(F.col("orientation")),
        "rule_lines": F.transform("rule_lines", whole),
    }
    return auto.select(*[new[c].alias(c) if c in new else c for c in auto.columns])


def union_regions(tables: DataFrame, bodies: DataFrame) -> DataFrame:
    return tables.unionByName(bodies, allowMissingColumns=True)

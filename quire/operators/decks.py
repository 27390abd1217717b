"""Division of body regions into decks (columns or tiers of a page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import PAGE
from quire.operators.ordered import numbered, span

_BOX = ("x", "y", "w", "h")


def _box(x, y, w, h) -> dict[str, Column]:
    return dict(zip(_BOX, (x, y, w, h)))


def _split(box: dict[str, Column], axis: str, parts: int) -> list[dict[str, Column]]:
    """Two pieces of 48.5 % or three of 31.5 % along an axis, the gap between them."""
    start, length = ("y", "h") if axis == "y" else ("x", "w")
    size = box[length]
    piece = F.floor(size * (0.485 if parts == 2 else 0.315)).cast("int")
    if parts == 2:
        gap = size - piece * 2
    else:
        gap = F.greatest(F.lit(2), F.floor((size - piece * 3) / 2).cast("int"))
    return [{**box, start: box[start] + (piece + gap) * i, length: piece} for i in range(parts)]


def _layout(boxes: list[dict[str, Column]], names: list[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), b["x"].cast("int").alias("x"), b["y"].cast("int").alias("y"),
                b["w"].cast("int").alias("width"), b["h"].cast("int").alias("height"),
            )
            for b, n in zip(boxes, names)
        ]
    )


def divide_decks(
    regions: DataFrame, deck_count: int = 0, doc_type: str = "japanese", orientation: str = "auto"
) -> DataFrame:
    """Replace the body regions of a page by its decks; other regions follow unchanged.
    Pages without body regions stay as they are.  ``region_seq`` is renumbered."""
    body = F.col("type") == "body"
    x2, y2 = F.col("x") + F.col("width"), F.col("y") + F.col("height")

    def named(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.col("name").contains(p)
        return out

    page = regions.groupBy(*PAGE).agg(
        F.count_if(body).alias("n_body"),
        F.min(F.when(body, F.col("x"))).alias("min_x"),
        F.max(F.when(body, x2)).alias("max_x"),
        F.min(F.when(body, F.col("y"))).alias("min_y"),
        F.max(F.when(body, y2)).alias("max_y"),
        F.max((F.col("orientation") == "horizontal") | named("横", "左段", "右段")).alias("h_hint"),
        F.max((F.col("orientation") == "vertical") | named("縦")).alias("v_hint"),
        F.max(named("左ページ", "右ページ")).alias("spread_hint"),
        F.max(named("段")).alias("deck_hint"),
        F.min(F.when(body, named("段", "本文"))).alias("plain_names"),
    )
    middle = F.col("min_x") + (F.col("max_x") - F.col("min_x")) / 2
    right = F.col("x") + F.col("width") / 2 >= middle

    def edges(mark: str, side: Column) -> list[Column]:
        return [
            F.count_if(side).alias(f"{mark}n"),
            F.min(F.when(side, F.col("x"))).alias(f"{mark}x1"),
            F.max(F.when(side, x2)).alias(f"{mark}x2"),
            F.min(F.when(side, F.col("y"))).alias(f"{mark}y1"),
            F.max(F.when(side, y2)).alias(f"{mark}y2"),
        ]

    sides = (
        regions.filter(body).join(page.select(*PAGE, "min_x", "max_x"), PAGE)
        .groupBy(*PAGE).agg(*edges("l", ~right), *edges("r", right))
    )
    p = page.join(sides, PAGE, "left").withColumn("mid", F.floor(middle).cast("int"))
    total_w, total_h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")

    def side_box(mark: str, x1: Column, x2_: Column) -> dict[str, Column]:
        left_edge = F.coalesce(f"{mark}x1", x1)
        top = F.coalesce(f"{mark}y1", "min_y")
        return _box(
            left_edge, top,
            F.greatest(F.lit(10), F.coalesce(f"{mark}x2", x2_) - left_edge),
            F.greatest(F.lit(10), F.coalesce(f"{mark}y2", "max_y") - top),
        )

    left_box = side_box("l", F.col("min_x"), F.col("mid") - 5)
    right_box = side_box("r", F.col("mid") + 5, F.col("max_x"))
    whole = _box(F.col("min_x"), F.col("min_y"), total_w, total_h)
    if orientation == "horizontal" or doc_type == "western":
        flat = F.lit(True)
    elif orientation == "vertical":
        flat = F.lit(False)
    else:
        flat = ~F.col("v_hint") & F.col("h_hint")

    tiers = {2: "上下", 3: "上中下"}

    def halves(first: tuple, second: tuple, decks: int) -> Column:
        if decks not in tiers:
            return _layout([first[1], second[1]], [f"{first[0]}ページ本文", f"{second[0]}ページ本文"])
        boxes, names = [], []
        for mark, box in (first, second):
            boxes += _split(box, "y", decks)
            names += [f"{mark}{t}本文" for t in tiers[decks]]
        return _layout(boxes, names)

    left_half, right_half = ("左", left_box), ("右", right_box)
    spread_flat = halves(left_half, right_half, deck_count if deck_count > 0 else 1)
    spread_upright = halves(right_half, left_half, deck_count if deck_count > 0 else 2)

    one = _layout([whole], ["本文"])
    columns = ["左段本文", "右段本文"]
    if deck_count == 2:
        page_flat = F.when(
            (F.col("ln") == 0) | (F.col("rn") == 0), _layout(_split(whole, "x", 2), columns)
        ).otherwise(_layout([left_box, right_box], columns))
    elif deck_count == 3:
        page_flat = _layout(_split(whole, "x", 3), ["左段本文", "中段本文", "右段本文"])
    else:
        keep = (F.col("n_body") > 1) & F.col("plain_names")
        page_flat = F.when(keep, F.lit(None)).otherwise(one)
        if deck_count == 0:
            two = (F.col("ln") > 0) & (F.col("rn") > 0) & F.col("deck_hint")
            page_flat = F.when(two, _layout([left_box, right_box], columns)).otherwise(page_flat)
    if deck_count in tiers:
        page_upright = _layout(
            _split(whole, "y", deck_count), [f"{t}段本文" for t in tiers[deck_count]]
        )
    else:
        page_upright = one

    spread = ((total_w > total_h * 1.15) & (total_w > 250)) | F.col("spread_hint")
    decks = F.when(spread, F.when(flat, spread_flat).otherwise(spread_upright)).otherwise(
        F.when(flat, page_flat).otherwise(page_upright)
    )
    laid = p.filter("n_body > 0").select(*PAGE, flat.alias("flat"), decks.alias("decks"))
    generated = laid.select(*PAGE, "flat", F.posexplode("decks").alias("i", "d")).select(
        *PAGE, F.lit(0).alias("k0"), F.col("i").alias("k1"), F.lit(0).alias("k2"), F.col("d.name").alias("name"),
        F.lit("body").alias("type"), F.when(F.col("flat"), "horizontal").otherwise("vertical").alias("orientation"),
        "d.x", "d.y", "d.width", "d.height",
    )
    box_columns = ["name", "type", "orientation", "x", "y", "width", "height"]
    # Body regions that are kept one by one run from left to right.
    kept = regions.filter(body).join(laid.filter("decks IS NULL").select(*PAGE), PAGE, "left_semi").select(
        *PAGE, F.lit(0).alias("k0"), F.col("x").alias("k1"), F.col("region_seq").alias("k2"),
        "name", "type", F.lit("horizontal").alias("orientation"), "x", "y", "width", "height",
    )
    others = regions.filter(~body).select(
        *PAGE, F.lit(1).alias("k0"), F.col("region_seq").alias("k1"), F.lit(0).alias("k2"), *box_columns
    )
    out = generated.unionByName(kept).unionByName(others)
    order = [F.col("k0"), F.col("k1"), F.col("k2")]
    chunk = F.struct(F.col("k0").alias("a"), span("k1", 4096).alias("b"))
    return numbered(out, PAGE, order, chunk, "region_seq").select(*PAGE, "region_seq", *box_columns)

"""Box arithmetic as column functions.  Python and .NET round half to even: ``bround``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _c, given, strip

# Layout classes whose boxes are text lines.
LINE_CLASSES = [1, 2, 3, 4, 5, 16]


def polygon_to_box(points: Column | str) -> Column:
    """``ARRAY<ARRAY<number>>`` to an integer ``STRUCT<x, y, width, height>``; null when the
    box has no area."""

    def whole(c: Column) -> Column:
        return F.bround(c, 0).cast("int")

    def side(p: Column, i: int) -> Column:
        values = F.transform(p, lambda q: F.get(q, F.lit(i)).cast("double"))
        return given(values, lambda v: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")))

    def sides(p: Column) -> Column:
        return F.struct(side(p, 0).alias("x"), side(p, 1).alias("y"))

    def box(s: Column) -> Column:
        return F.struct(
            whole(s["x"]["low"]).alias("x"),
            whole(s["y"]["low"]).alias("y"),
            whole(s["x"]["high"] - s["x"]["low"]).alias("width"),
            whole(s["y"]["high"] - s["y"]["low"]).alias("height"),
        )

    # The points are read once, not again for every side and test of the box.
    found = given(_c(points), lambda p: given(sides(p), box))
    return given(found, lambda b: F.when((b["width"] > 0) & (b["height"] > 0), b))


def int_center(start: Column | str, size: Column | str) -> Column:
    """Integer centre, truncating as integer division does."""
    return (_c(start) + F.floor(F.abs(_c(size)) / 2) * F.signum(_c(size))).cast("int")


# Names of region types.
REGION_TYPES = {
    "body": ["body", "本文", "text"],
    "heading": ["heading", "見出し", "title", "header"],
    "footnote": ["footnote", "注釈", "注釈文"],
    "table": ["table", "表", "tabular"],
    "image": ["image", "figure", "図", "画像", "イラスト", "写真", "図版"],
}
REGION_DISPLAY = {"body": "本文", "heading": "見出し", "footnote": "注釈文", "table": "表", "image": "図"}


def normalize_region_type(col: Column | str) -> Column:
    low = strip(F.lower(F.coalesce(_c(col), F.lit(""))))
    out = low
    for kind, names in REGION_TYPES.items():
        out = F.when(low.isin(names), kind).otherwise(out)
    return out


def region_display_name(kind: Column | str) -> Column:
    kind = _c(kind)
    out = F.lit("未分類")
    for k, name in REGION_DISPLAY.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def line_bucket(type_col: Column | str) -> Column:
    """Heading, footnote or body bucket of an XML line type; no type means body."""
    t = F.coalesce(_c(type_col), F.lit(""))
    return (
        F.when(t.contains("見出し"), "heading")
        .when(t.contains("注") | t.contains("キャプション"), "footnote")
        .otherwise("body")
    )


def cluster_array(positions: Column, tol: int) -> Column:
    """Cluster a sorted array of positions: a position joins the last cluster when within
    ``tol`` of its mean.  The means, rounded half to even."""
    start = F.array().cast("array<struct<s:bigint,n:bigint>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(p.cast("long").alias("s"), F.lit(1).cast("long").alias("n"))
        more = F.struct((last["s"] + p).cast("long").alias("s"), (last["n"] + 1).cast("long").alias("n"))
        fresh = (F.size(acc) == 0) | (F.abs(p - last["s"] / last["n"]) > tol)
        return F.when(fresh, F.concat(acc, F.array(one))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))
        )

    return F.transform(
        F.aggregate(positions, start, add), lambda c: F.bround(c["s"] / c["n"], 0).cast("int")
    )

"""Joins between boxes of one page.

Both sides are cut into horizontal (or vertical) bands and joined on page key plus
band, so a crowded page spreads over many tasks and far-apart boxes never meet.
A pair seen in several bands is kept only in the first band both sides share, so
no ``distinct`` is needed.  Spark broadcasts a side on its own when its size
estimate is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.operators.ordered import span

BAND = 1024


def _explode_bands(df: DataFrame, low: Column, high: Column, prefix: str, width: int) -> DataFrame:
    return df.withColumn(f"_{prefix}0", span(low, width)).withColumn(
        "_band", F.explode(F.sequence(F.col(f"_{prefix}0"), F.greatest(span(high, width), span(low, width))))
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[Column, Column],
    right_range: tuple[Column, Column],
    condition: Column,
    keys: list[str] = PAGE,
    width: int = BAND,
) -> DataFrame:
    """Inner join of pairs whose ranges touch and that meet ``condition``.  Columns other
    than ``keys`` must have different names on the two sides."""
    a = _explode_bands(left, *left_range, "l", width)
    b = _explode_bands(right, *right_range, "r", width)
    return (
        a.join(b, [*keys, "_band"])
        .filter((F.col("_band") == F.greatest("_l0", "_r0")) & condition)
        .drop("_band", "_l0", "_r0")
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    left_box: tuple[Column, Column, Column, Column],
    right_box: tuple[Column, Column, Column, Column],
    condition: Column,
    keys: list[str] = PAGE,
    cell: int = 256,
) -> DataFrame:
    """Inner join of pairs whose boxes ``(x1, y1, x2, y2)`` touch and that meet ``condition``.

    Both sides are cut into square cells; a pair counts only in the one cell that holds the upper left
    corner of what they share, so a page that is crowded in both directions is spread over its
    cells and no ``distinct`` is needed.  Columns other than ``keys`` must differ in name.
    """

    def cells(df: DataFrame, box: tuple[Column, Column, Column, Column], p: str) -> DataFrame:
        x1, y1, x2, y2 = box
        out = df.withColumns({f"_{p}x": span(x1, cell), f"_{p}y": span(y1, cell)})
        across = F.explode(F.sequence(F.col(f"_{p}x"), F.greatest(span(x2, cell), F.col(f"_{p}x"))))
        down = F.explode(F.sequence(F.col(f"_{p}y"), F.greatest(span(y2, cell), F.col(f"_{p}y"))))
        return out.withColumn("_gx", across).withColumn("_gy", down)

    pairs = cells(left, left_box, "l").join(cells(right, right_box, "r"), [*keys, "_gx", "_gy"])
    own = (F.col("_gx") == F.greatest("_lx", "_rx")) & (F.col("_gy") == F.greatest("_ly", "_ry"))
    return pairs.filter(own & condition).drop("_gx", "_gy", "_lx", "_ly", "_rx", "_ry")


def band_anti(
    left: DataFrame,
    right: DataFrame,
    left_point: Column,
    right_range: tuple[Column, Column],
    condition: Column,
    keys: list[str] = PAGE,
    width: int = BAND,
) -> DataFrame:
    """Rows of ``left`` for which no row of ``right`` meets ``condition``.  The left side
    lies in one band, that of its point."""
    a = left.withColumn("_band", span(left_point, width))
    b = _explode_bands(right, *right_range, "r", width).withColumnRenamed("_band", "_rband")
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.col("_band") == F.col("_rband")
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    return a.join(b, on & condition, "left_anti").drop("_band")


def prefixed(df: DataFrame, prefix: str, keys: list[str] = PAGE) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def box_clusters(
    df: DataFrame,
    x1: Column,
    y1: Column,
    x2: Column,
    y2: Column,
    keys: list[str] = PAGE,
    reach_x: Column | None = None,
    reach_y: Column | None = None,
) -> DataFrame:
    """Split a page into parts no box reaches across, first along y, then along x.

    Adds ``_cy`` and ``_cx``.  Boxes of different parts neither overlap nor come within
    ``reach_*`` of one another, so greedy algorithms can work on each part alone.  The boxes of
    a page are dealt out once and stream out of a sort; those without a place go.
    """
    out = df
    for name, start, end, reach in (("_cy", y1, y2, reach_y), ("_cx", x1, x2, reach_x)):
        within = keys if name == "_cy" else [*keys, "_cy"]
        far = F.greatest(start, end) + (F.lit(0) if reach is None else reach)
        out = out.withColumns({"_start": start, "_far": far})
        w = Window.partitionBy(*within).orderBy("_start")
        # Boxes that start at one place are not apart from one another.
        apart = (F.col("_start") > F.lag("_start").over(w)) & F.coalesce(
            F.col("_start") >= F.max("_far").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)
        )
        out = out.dropna(subset=[*within, "_start"]).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        part = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
        out = out.withColumn(name, part).drop("_start", "_far", "_new")
    return out

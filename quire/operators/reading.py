"""Reading order: rows and columns of a page, decks, spreads and user regions.

Lines are grouped greedily into rows (or columns) whose running mean they lie close to; see
``grouping``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.text import clean_runaway, is_blank
from quire.operators.bands import band_join
from quire.operators.grouping import MOST_ITEMS, group_along
from quire.operators.lines import dedupe_lines, detect_decks, page_direction
from quire.operators.ordered import largest, numbered, running, span
from quire.operators.staging import settle


# --- tiers ---------------------------------------------------------------------------

def without_runaway(lines: DataFrame, mode: str = "app") -> DataFrame:
    """Repeated text removed, blank lines dropped.

    The cleaned text comes out of a generator: a filter on a plain column would be moved before it and clean every line twice.
    """
    cleaned = lines.withColumn("text", F.explode_outer(F.array(clean_runaway("text", mode))))
    return cleaned.filter(~is_blank("text"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Repeated text removed, blank lines dropped, equal lines folded."""
    return dedupe_lines(without_runaway(lines))


def _extents(df: DataFrame, keys: list[str], few: bool) -> DataFrame:
    edges = {
        "_x1": F.min("x"), "_x2": F.max(F.col("x") + F.col("width")),
        "_y1": F.min("y"), "_y2": F.max(F.col("y") + F.col("height")),
    }
    if few:
        sized = df.withColumns({n: e.over(Window.partitionBy(*keys)) for n, e in edges.items()})
    else:
        sized = df.join(df.groupBy(*keys).agg(*[e.alias(n) for n, e in edges.items()]), keys)
    return sized.withColumns(
        {"_w": F.col("_x2") - F.col("_x1"), "_h": F.col("_y2") - F.col("_y1")}
    )


_EXTENT = ["_x1", "_x2", "_y1", "_y2", "_w", "_h"]


def _cx() -> Column:
    return F.col("x") + F.col("width") / 2


def _cy() -> Column:
    return F.col("y") + F.col("height") / 2


def _spread() -> Column:
    return (F.col("_w") > 250) & (F.col("_w") > F.col("_h") * 0.85)


def _deck(vertical: Column, decks: Column) -> Column:
    """Deck number along y for vertical text, along x for horizontal text."""

    def index(center: Column, low: str, size: str) -> Column:
        raw = F.floor((center - F.col(low)) / (F.col(size) / decks)).cast("int")
        return F.when(F.col(size) <= 10, 0).otherwise(F.least(F.greatest(raw, F.lit(0)), decks - 1))

    return F.when(vertical, index(_cy(), "_y1", "_h")).otherwise(index(_cx(), "_x1", "_w")).cast("int")


def _page_facts(
    lines: DataFrame, placed: DataFrame, orientation: str, doc_type: str, deck_count: int, use_decks: bool
) -> DataFrame:
    """``placed`` with the direction ``_v`` of the page that ``lines`` make, and its number of decks ``_decks``."""
    out = placed.join(
        page_direction(lines, orientation=orientation, doc_type=doc_type).withColumnRenamed("is_vertical", "_v"),
        PAGE,
    )
    if not use_decks or deck_count == 1:
        return out.withColumn("_decks", F.lit(1))
    if deck_count in (2, 3):
        return out.withColumn("_decks", F.lit(deck_count))
    found = detect_decks(lines).withColumnRenamed("deck_count", "_found")
    return (
        out.join(found, PAGE)
        .withColumn("_decks", F.when(F.col("_v"), F.col("_found")).otherwise(1))
        .drop("_found")
    )


def _in_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """First region that holds the line's centre, as ``_region``; lines outside are dropped."""
    boxes = regions.select(
        *PAGE, F.col("region_seq").alias("r_seq"), F.col("x").alias("r_x"), F.col("y").alias("r_y"),
        (F.col("x") + F.col("width")).alias("r_x2"), (F.col("y") + F.col("height")).alias("r_y2"),
    )
    cx, cy = F.floor(_cx()), F.floor(_cy())
    points = lines.select(*PAGE, "line_id", cx.alias("_px"), cy.alias("_py"))
    inside = (
        (F.col("_px") >= F.col("r_x")) & (F.col("_px") < F.col("r_x2"))
        & (F.col("_py") >= F.col("r_y")) & (F.col("_py") < F.col("r_y2"))
    )
    pairs = band_join(
        points, boxes, (F.col("_py"), F.col("_py")), (F.col("r_y"), F.col("r_y2")), inside
    )
    best = pairs.groupBy(*PAGE, "line_id").agg(F.min("r_seq").alias("_region"))
    return lines.join(best, [*PAGE, "line_id"])


TIER = [*PAGE, "_region", "_half", "_deckno", "_side"]


def with_tiers(
    lines: DataFrame,
    regions: DataFrame | None,
    orientation: str,
    doc_type: str,
    deck_count: int,
    split_pages: bool,
    few: bool = False,
) -> DataFrame:
    """Add the direction and the tier a line belongs to.  Tiers read one after another.

    ``split_pages`` also divides spreads and wide horizontal pages into left and right.  ``few``: pages are
    small enough for one task each, so that their lines are dealt out by page once.
    """
    zero = F.lit(0)
    placed = lines if regions is None else _in_regions(lines, regions)
    facts = _page_facts(lines, placed, orientation, doc_type, deck_count, use_decks=regions is None)
    if regions is not None:
        out = facts.withColumns({"_half": zero, "_deckno": zero})
    else:
        out = facts.withColumns({"_region": zero, "_half": zero})
        many = F.col("_decks") > 1
        if deck_count == 1:
            out = out.withColumn("_deckno", zero)
        else:
            if split_pages:
                out = _extents(out, PAGE, few)
                many = many & (F.col("_h") > 10)
                right_first = F.lit(doc_type != "western") & F.col("_v")
                right = _cx() >= F.col("_x1") + F.col("_w") / 2
                half = F.when(right == right_first, 0).otherwise(1)
                out = out.withColumns(
                    {"_half": F.when(many & _spread(), half).otherwise(0), "_many": many}
                ).drop(*_EXTENT)
                many = F.col("_many")
            out = _extents(out, [*PAGE, "_half"], few)
            out = out.withColumn("_deckno", F.when(many, _deck(F.col("_v"), F.col("_decks"))).otherwise(0))
            out = out.drop(*_EXTENT, "_many")
    if split_pages:
        out = _extents(out, TIER[:-1], few)
        left = _cx() < F.col("_x1") + F.col("_w") / 2
        side = F.when(~F.col("_v") & _spread() & ~left, 1).otherwise(0)
        out = out.withColumn("_side", side).drop(*_EXTENT)
    else:
        out = out.withColumn("_side", zero)
    return out


def rows_of(tiered: DataFrame, ratio_horizontal: float, carry: list[str], few: bool) -> DataFrame:
    """Rows (horizontal) or columns (vertical) of every tier; see ``group_along``."""
    v = F.col("_v")
    size = F.when(v, F.col("width")).otherwise(F.col("height"))
    ratio = F.when(v, 0.35).otherwise(ratio_horizontal)
    return group_along(
        tiered, TIER, "line_id",
        F.when(v, -(2 * F.col("x") + F.col("width"))).otherwise(2 * F.col("y") + F.col("height")),
        size * ratio * 2,
        F.when(v, F.col("y")).otherwise(F.col("x")),
        F.when(v, F.col("y") + F.col("height")).otherwise(F.col("x") + F.col("width")),
        carry=carry, few=few,
    )


def tier_chunk(mean: str = "mean2") -> Column:
    """Chunk for running computations over the tiers of a page in reading order."""
    return F.struct("_region", "_half", "_deckno", "_side", span(mean, 4096).alias("m"))


def tier_order() -> list[Column]:
    return [F.col(c) for c in ("_region", "_half", "_deckno", "_side", "mean2", "band", "grp")]


def reading_order(
    lines: DataFrame,
    regions: DataFrame | None = None,
    orientation: str = "auto",
    doc_type: str = "japanese",
    deck_count: int = 0,
) -> DataFrame:
    """Position of every line: columns right to left for vertical text, rows top to bottom for
    horizontal text, deck after deck, region after region."""
    cleaned = settle(clean_lines(lines).select(*PAGE, "line_id", "x", "y", "width", "height", "is_vertical"))
    few = largest(cleaned, PAGE) <= MOST_ITEMS
    keep = (lambda df: df) if few else settle
    tiered = with_tiers(cleaned, regions, orientation, doc_type, deck_count, split_pages=True, few=few)
    tiered = keep(tiered.withColumn("_lo", F.when(F.col("_v"), F.col("y")).otherwise(F.col("x"))))
    order = [*tier_order(), F.col("_lo"), F.col("line_id")]
    small = keep(rows_of(tiered, 0.35, ["_lo"], few))
    return numbered(small, PAGE, order, None if few else tier_chunk(), "position").select(*PAGE, "position", "line_id")


# --- simple order of blocks ------------------------------------------------------------

def simple_reading_order(
    blocks: DataFrame, col_tol: int = 60, row_min: int = 20, row_ratio: float = 0.7
) -> DataFrame:
    """Majority direction first, undecided blocks next, minority direction last.

    ``blocks``: page key, ``id``, ``orientation``, ``x1, y1, x2, y2``.
    """
    b = settle(
        blocks.select(
            *PAGE, "id", "orientation", "x1", "y1", "x2", "y2",
            (F.col("x1") + F.col("x2")).alias("cx2"), (F.col("y1") + F.col("y2")).alias("cy2"),
        )
    )
    vote = page_direction(b, mode="strict").withColumnRenamed("is_vertical", "_v")
    upright = F.col("orientation") == "vertical"
    height = F.greatest(F.lit(1), F.col("y2") - F.col("y1"))
    grouped = group_along(
        b.filter("orientation <> 'unknown'"), [*PAGE, "orientation"], "id",
        F.when(upright, -F.col("cx2")).otherwise(F.col("cy2")),
        F.when(upright, F.lit(2.0 * col_tol)).otherwise(F.greatest(F.lit(float(row_min)), height * row_ratio) * 2),
        F.lit(0), F.lit(0), rule="first",
    )
    sided = b.join(grouped, [*PAGE, "orientation", "id"], "left").join(vote, PAGE)
    unknown = F.col("orientation") == "unknown"
    part = F.when(unknown, 1).when(upright == F.col("_v"), 0).otherwise(2)
    lead = (
        F.when(unknown & F.col("_v"), -F.col("cx2")).when(unknown, F.col("cy2")).otherwise(F.col("mean2"))
    ).cast("double")
    inner = (
        F.when(unknown & F.col("_v"), F.col("cy2")).when(unknown, F.col("cx2"))
        .when(upright, F.col("cy2")).otherwise(F.col("cx2"))
    )
    # Equal places keep the order in which blocks entered their group.
    entry = F.when(upright, -F.col("cx2")).otherwise(F.col("cy2"))
    keyed = settle(
        sided.select(
            *PAGE, "id", "orientation", part.alias("part"), lead.alias("lead"),
            F.coalesce("band", F.lit(0)).alias("band"), F.coalesce("grp", F.lit(0)).alias("grp"),
            inner.alias("inner"), entry.alias("entry"),
        )
    )
    order = [F.col(c) for c in ("part", "lead", "band", "grp", "inner", "entry", "id")]
    chunk = F.struct("part", span("lead", 4096).alias("m"))
    return numbered(keyed, PAGE, order, chunk, "position").select(*PAGE, "position", "id", "orientation")


def order_table_lines(lines: DataFrame, tol_min: float = 4.0, tol_ratio: float = 0.8) -> DataFrame:
    """Reorder only the table lines (``is_table``) of a page, column by column; they fill the
    slots table lines had.  Pages with one table line or none keep their order."""
    lines = settle(lines.filter("is_table IS NOT NULL").select(*PAGE, "line_id", "x", "y", "width", "is_table"))
    width = F.greatest(F.lit(1), "width")
    # A table line without a place across joins no column and goes; its slot is taken by others, the last ones stay empty.
    taken = F.col("is_table") & F.col("x").isNotNull() & F.col("width").isNotNull()
    table = lines.filter("is_table")
    # The columns bring along what orders their lines.
    placed = settle(group_along(
        table, PAGE, "line_id", 2 * F.col("x") + F.col("width"),
        width * tol_ratio * 2, F.lit(0), F.lit(0), rule="average", floor=2 * tol_min, carry=["x", "y"],
    ))
    by_column = [F.col(c) for c in ("mean2", "band", "grp", "y", "x", "line_id")]
    ranked = numbered(placed, PAGE, by_column, span("mean2", 4096), "slot").select(*PAGE, "slot", "line_id")
    # One numbering of all lines gives their places and, among the table lines, the slots.
    places = running(
        lines.select(*PAGE, "line_id", "is_table", taken.cast("int").alias("_taken")), PAGE, [F.col("line_id")],
        span("line_id", 4096), sums={"position": F.lit(1), "slot": F.col("is_table").cast("int")}, totals={"_used": F.col("_taken")},
    )
    empty = F.greatest(F.col("slot") - F.col("_used"), F.lit(0))
    places = settle(
        places.select(
            *PAGE, "line_id", "is_table", (F.col("position") - empty).cast("int").alias("position"), F.col("slot").cast("int")
        )
    )
    stay = places.filter("NOT is_table").select(*PAGE, "position", "line_id")
    slots = places.filter("is_table").select(*PAGE, "slot", "position")
    return ranked.join(slots, [*PAGE, "slot"]).select(*PAGE, "position", "line_id").unionByName(stay)


def columns_right_to_left(columns: DataFrame) -> DataFrame:
    """Number cut text columns from the right edge."""
    return numbered(
        columns, PAGE, [-F.col("x"), F.col("id")], span(-F.col("x"), 4096), "column_no"
    )


def reading_positions(ordered: DataFrame, order: list[Column], chunk: Column) -> DataFrame:
    """Final 1..n position of rows already given an order."""
    return numbered(ordered, PAGE, order, chunk, "position")

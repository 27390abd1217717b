"""Editing of table grids: merged cells, splits, shifts, concatenation, catalogue.

``grid_cells`` hold one cell per row: page key, ``table_seq``, ``row_no``, ``col_no`` (both from
1), ``text``.  ``spans`` hold merged rectangles: the same key, ``start_row``, ``start_col``,
``row_span``, ``col_span``, ``merged_text``, ``originals`` (``"col,row"`` to text).
``table_rows`` hold whole rows: page key, ``table_name``, ``row_index``, ``cells``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import PAGE
from quire.functions.text import given, is_blank, join_spaced_alnum, strip
from quire.operators.ordered import numbered, running, span
from quire.operators.staging import settle

GRID = [*PAGE, "table_seq"]
ROW_CHUNK = 4096


def _covered(spans: DataFrame, *extra: str) -> DataFrame:
    """Spans by the rows they cover, so cells meet them on an equal row."""
    return spans.select(
        *GRID, F.explode(F.sequence("start_row", F.col("start_row") + F.col("row_span") - 1)).alias("row_no"),
        F.col("start_col").alias("_c1"), (F.col("start_col") + F.col("col_span") - 1).alias("_c2"), *extra,
    )


def _spans_touching(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Spans that hold one of ``cells``."""
    ids = [*GRID, "start_row", "start_col", "row_span", "col_span"]
    marked = _covered(spans, "start_row", "start_col", "row_span", "col_span")
    picked = cells.select(*GRID, "row_no", F.col("col_no").alias("_at"))
    hit = marked.join(picked, [*GRID, "row_no"]).filter(F.col("_at").between(F.col("_c1"), F.col("_c2")))
    return hit.select(*ids).distinct()


def auto_merge_blanks(grid_cells: DataFrame, spans: DataFrame) -> DataFrame:
    """New spans: a value and the blank cells right of it.  Existing spans end a run."""
    taken = (
        grid_cells.select(*GRID, "row_no", "col_no")
        .join(_covered(spans), [*GRID, "row_no"])
        .filter(F.col("col_no").between(F.col("_c1"), F.col("_c2")))
        .select(*GRID, "row_no", "col_no", F.lit(True).alias("_in"))
        .distinct()
    )
    cells = grid_cells.join(taken, [*GRID, "row_no", "col_no"], "left")
    value = ~is_blank("text")
    stop = value | F.coalesce("_in", F.lit(False))
    w = Window.partitionBy(*GRID, "row_no").orderBy("col_no")
    runs = cells.withColumn("_run", F.sum(stop.cast("int")).over(w)).filter("_run > 0")
    found = runs.groupBy(*GRID, "row_no", "_run").agg(
        F.min("col_no").alias("start_col"),
        F.count(F.lit(1)).cast("int").alias("col_span"),
        F.min_by(strip("text"), "col_no").alias("merged_text"),
        F.min_by(value & F.col("_in").isNull(), "col_no").alias("_ok"),
        F.map_from_entries(
            F.collect_list(F.struct(F.expr("concat_ws(',', col_no, row_no)"), F.coalesce("text", F.lit(""))))
        ).alias("originals"),
    )
    return found.filter("_ok AND col_span > 1").select(
        *GRID, F.col("row_no").alias("start_row"), "start_col", F.lit(1).alias("row_span"), "col_span",
        "merged_text", "originals",
    )


def apply_merges(
    grid_cells: DataFrame, spans: DataFrame, existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge rectangles that do not overlap one another: their texts go to the top left cell,
    row by row, the other cells turn blank.  Existing spans a rectangle touches are dropped."""
    marked = _covered(spans, "start_row", "start_col", "row_span", "col_span")
    pairs = (
        grid_cells.join(marked, [*GRID, "row_no"])
        .filter(F.col("col_no").between(F.col("_c1"), F.col("_c2")))
        .drop("_c1", "_c2")
    )
    ids = [*GRID, "start_row", "start_col", "row_span", "col_span"]
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "col_no", F.coalesce("text", F.lit("")).alias("text")))),
        lambda s: s["text"],
    )
    merged = pairs.groupBy(*ids).agg(
        join_spaced_alnum(ordered).alias("merged_text"),
        F.map_from_entries(
            F.collect_list(F.struct(F.expr("concat_ws(',', col_no, row_no)"), F.coalesce("text", F.lit(""))))
        ).alias("originals"),
    )
    head = (F.col("row_no") == F.col("start_row")) & (F.col("col_no") == F.col("start_col"))
    changed = (
        pairs.select(*ids, "row_no", "col_no")
        .join(merged.select(*ids, "merged_text"), ids)
        .select(*GRID, "row_no", "col_no", F.when(head, F.col("merged_text")).otherwise("").alias("_new"))
    )
    cells = (
        grid_cells.join(changed, [*GRID, "row_no", "col_no"], "left")
        .withColumn("text", F.coalesce("_new", "text"))
        .select(*grid_cells.columns)
    )
    if existing is not None:
        touched = _spans_touching(existing, pairs.select(*GRID, "row_no", "col_no"))
        merged = existing.join(touched, ids, "left_anti").unionByName(merged)
    return cells, merged


def undo_merges(grid_cells: DataFrame, spans: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take back the spans that hold a selected cell; the texts before the merge return."""
    ids = [*GRID, "start_row", "start_col", "row_span", "col_span"]
    undone = _spans_touching(spans, selection)
    before = spans.join(undone, ids, "left_semi").select(*GRID, F.explode("originals").alias("_k", "_old"))
    place = F.split("_k", ",")
    before = before.select(
        *GRID, F.get(place, F.lit(1)).cast("int").alias("row_no"), F.get(place, F.lit(0)).cast("int").alias("col_no"),
        "_old",
    )
    cells = (
        grid_cells.join(before, [*GRID, "row_no", "col_no"], "left")
        .withColumn("text", F.coalesce("_old", "text"))
        .select(*grid_cells.columns)
    )
    return cells, spans.join(undone, ids, "left_anti")


# --- moving text between cells ---------------------------------------------------------

def _upsert(grid_cells: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes``: cell key and ``_new``; cells that do not exist yet are added."""
    cell = [*GRID, "row_no", "col_no"]
    joined = grid_cells.join(writes, cell, "full")
    return joined.withColumn("text", F.coalesce("_new", "text")).select(*grid_cells.columns)


def _beside(grid_cells: DataFrame, edits: DataFrame, step: int) -> DataFrame:
    """Edited cells with their text and the text of the neighbour ``step`` columns on."""
    cell = [*GRID, "row_no", "col_no"]
    mine = grid_cells.join(edits.select(*cell).distinct(), cell, "left_semi").withColumn(
        "_to", F.col("col_no") + step
    )
    other = grid_cells.select(
        *GRID, "row_no", F.col("col_no").alias("_to"), strip(F.coalesce("text", F.lit(""))).alias("_there")
    )
    return mine.join(other, [*GRID, "row_no", "_to"], "left").fillna({"_there": ""})


def _writes(moved: DataFrame, here: Column, there: Column) -> DataFrame:
    both = F.array(
        F.struct(F.col("col_no").alias("c"), here.alias("t")), F.struct(F.col("_to").alias("c"), there.alias("t"))
    )
    return moved.select(*GRID, "row_no", F.explode(both).alias("w")).select(
        *GRID, "row_no", F.col("w.c").alias("col_no"), F.col("w.t").alias("_new")
    )


def _pad(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def _edited(
    grid_cells: DataFrame, writes: DataFrame, spans: DataFrame | None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Written cells; with ``spans``, also those of them that hold no written cell."""
    cells = _upsert(grid_cells, writes)
    if spans is None:
        return cells
    ids = [*GRID, "start_row", "start_col", "row_span", "col_span"]
    return cells, spans.join(_spans_touching(spans, writes.select(*GRID, "row_no", "col_no")), ids, "left_anti")


def shift_cells(
    grid_cells: DataFrame, edits: DataFrame, direction: str = "right", spans: DataFrame | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Move the text of edited cells into the next cell, before or behind what stands there.
    Edits of one call are taken on their own: give no two that share a cell.  With merged
    ``spans`` the result is cells and spans: those that hold a cell written to are gone."""
    step = 1 if direction == "right" else -1
    moved = _beside(grid_cells, edits, step).withColumn("_t", strip("text")).filter("_t <> '' AND _to >= 1")
    there = _pad(F.col("_t"), F.col("_there")) if step == 1 else _pad(F.col("_there"), F.col("_t"))
    return _edited(grid_cells, _writes(moved, F.lit(""), there), spans)


def cell_split_index(text: Column) -> Column:
    """Number of characters left of the best split: behind a closing bracket, where the script
    changes, or nearest to the middle by width; -1 without a usable space."""
    n = F.length(text)
    space, cjk = r"(?U)^[\s　]$", r"^[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}]"

    def at(i: Column) -> Column:
        return F.substring(text, i + 1, F.lit(1))

    def width(k: Column) -> Column:
        part = F.left(text, k)
        return k + F.length(F.regexp_replace(part, r"[\x{00}-\x{7F}]", ""))

    spots = F.filter(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: (i <= n - 2) & at(i).rlike(space) & ~at(i - 1).rlike(space),
    )

    def script_change(i: Column) -> Column:
        rest = F.regexp_replace(F.substring(text, i + 1, n), r"(?U)^[\s　]+", "")
        return (rest != "") & (at(i - 1).rlike(cjk) != rest.rlike(cjk))

    def best(spots: Column) -> Column:
        brackets = F.filter(spots, lambda i: at(i - 1).rlike(r"[)）\]］}｝]"))
        changes = F.filter(spots, script_change)
        near = F.array_min(
            F.transform(spots, lambda i: F.struct(F.abs(width(i + 1) - width(n) / 2).alias("d"), i.alias("i")))
        )["i"]
        return (
            F.when(F.size(spots) == 0, -1)
            .when(F.size(spots) == 1, F.get(spots, F.lit(0)))
            .when(F.size(brackets) > 0, F.element_at(brackets, -1))
            .when(F.size(changes) > 0, F.get(changes, F.lit(0)))
            .otherwise(near)
        )

    return given(spots, best)


def split_cells(
    grid_cells: DataFrame, edits: DataFrame, spans: DataFrame | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Split edited cells at their best space; the right part goes before the text of the next
    cell.  Give no two edits that share a cell.  ``spans`` as in ``shift_cells``."""
    # Out of a generator: as a plain column the search would run again wherever the index is used.
    index = F.explode(F.array(cell_split_index(F.coalesce("text", F.lit("")))))
    at = _beside(grid_cells, edits, 1).withColumn("_at", index)
    left = strip(F.left("text", F.col("_at")))
    right = strip(F.substring("text", F.col("_at") + 1, F.length("text")))
    moved = at.filter("_at > 0").withColumns({"_l": left, "_r": right}).filter("_r <> ''")
    return _edited(grid_cells, _writes(moved, F.col("_l"), _pad(F.col("_r"), F.col("_there"))), spans)


# --- whole rows ------------------------------------------------------------------------

def _last_filled(cells: Column) -> Column:
    """1-based column of the last cell with text, 0 without any."""
    filled = F.filter(F.transform(cells, lambda c, i: F.when(~is_blank(c), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(filled), F.lit(0))


def _padded(cells: Column, n: Column) -> Column:
    blank = F.array_repeat(F.lit(""), F.greatest(n - F.size(cells), F.lit(0)))
    return F.slice(F.concat(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), blank), F.lit(1), n)


TABLE = [*PAGE, "table_name"]


def effective_columns(table_rows: DataFrame) -> DataFrame:
    """Columns in use per table, one at least."""
    used = table_rows.groupBy(*TABLE).agg(F.max(_last_filled(F.col("cells"))).alias("_n"))
    return used.select(*TABLE, F.greatest(F.col("_n"), F.lit(1)).alias("n"))


def table_catalog(grid_rows: DataFrame) -> DataFrame:
    """Runs of consecutive grid rows of one page and table: ``start_row, rows, columns``.

    ``grid_rows``: ``doc_id, grid_row, page_no, table_name, cells``.
    """
    order, chunk = [F.col("grid_row")], span("grid_row", ROW_CHUNK)
    name = F.when(is_blank("table_name"), "表1").otherwise(strip("table_name"))
    rows = grid_rows.select(
        "doc_id", "grid_row", "page_no", name.alias("table_name"), _last_filled(F.col("cells")).alias("_n")
    )
    key = F.struct("page_no", F.lower("table_name"))
    seen = running(settle(rows), ["doc_id"], order, chunk, previous={"_was": key})
    new = ~key.eqNullSafe(F.col("_was"))
    runs = running(settle(seen.withColumn("_new", new.cast("int"))), ["doc_id"], order, chunk, sums={"_run": F.col("_new")})
    return runs.groupBy("doc_id", "page_no", "_run").agg(
        F.min_by("table_name", "grid_row").alias("table_name"),
        F.min("grid_row").cast("int").alias("start_row"),
        F.count(F.lit(1)).cast("int").alias("rows"),
        F.max("_n").cast("int").alias("columns"),
    ).drop("_run")


def is_duplicate_header(first: Column, other: Column) -> Column:
    """At least half of the cells filled in both rows are equal, case aside."""
    both = F.filter(
        F.zip_with(first, other, lambda a, b: F.struct(strip(a).alias("a"), strip(b).alias("b"))),
        lambda p: (F.coalesce(p["a"], F.lit("")) != "") & (F.coalesce(p["b"], F.lit("")) != ""),
    )
    same = F.filter(both, lambda p: F.lower(p["a"]) == F.lower(p["b"]))
    return (F.size(both) > 0) & (F.size(same) * 2 >= F.size(both))


def duplicate_headers(table_rows: DataFrame) -> DataFrame:
    """For every table after the first of its document: does its first row repeat the header?"""
    heads = table_rows.groupBy(*TABLE).agg(F.min_by("cells", "row_index").alias("_head"))
    lead = heads.groupBy("doc_id").agg(
        F.min_by(F.struct("page_no", "table_name", F.col("_head").alias("h")), F.struct("page_no", "table_name")).alias("_l")
    )
    later = heads.join(lead, "doc_id").filter(
        (F.col("page_no") != F.col("_l.page_no")) | (F.col("table_name") != F.col("_l.table_name"))
    )
    return later.select(*TABLE, is_duplicate_header(F.col("_l.h"), F.col("_head")).alias("is_duplicate"))


def concat_tables(
    table_rows: DataFrame,
    spec: DataFrame,
    direction: str = "vertical",
    skip_duplicate_header: bool = True,
    spans: DataFrame | None = None,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Concatenate tables below or beside one another.

    ``spec``: ``doc_id, group_no, member_no, page_no, table_name, new_name``; members are taken
    in order.  Returns ``doc_id, group_no, page_no, table_name, row_index, cells``; with ``spans``
    (``doc_id, page_no, table_name, start_row, ...``, rows and columns from 1) also the moved ones.
    """
    named = spec.withColumn("_t", F.lower("table_name")).drop("table_name")
    used = effective_columns(table_rows).withColumn("_t", F.lower("table_name")).drop("table_name")
    sizes = table_rows.groupBy(*TABLE).agg(
        F.count(F.lit(1)).cast("int").alias("_rows"), F.min_by("cells", "row_index").alias("_head")
    )
    sizes = sizes.withColumn("_t", F.lower("table_name")).drop("table_name")
    members = settle(named.join(used, [*PAGE, "_t"]).join(sizes, [*PAGE, "_t"]))
    group = ["doc_id", "group_no"]
    first = members.groupBy(*group).agg(
        F.min_by(F.struct("page_no", "new_name", F.col("_head").alias("h")), "member_no").alias("_f"),
        F.min("member_no").alias("_m1"), F.max("n").alias("_wide"), F.sum("n").cast("int").alias("_total"),
    )
    w = Window.partitionBy(*group).orderBy("member_no").rowsBetween(Window.unboundedPreceding, -1)
    dup = (
        F.lit(skip_duplicate_header) & (F.col("member_no") > F.col("_m1")) & (F.col("_rows") > 1)
        & is_duplicate_header(F.col("_f.h"), F.col("_head"))
    )
    laid = members.join(first, group).withColumn("_skip", dup.cast("int"))
    # Members of a group are few: a list of tables picked by hand.
    laid = settle(
        laid.withColumns(
            {
                "_row0": F.coalesce(F.sum(F.col("_rows") - F.col("_skip")).over(w), F.lit(0)),
                "_col0": F.coalesce(F.sum("n").over(w), F.lit(0)),
            }
        )
    )
    rows = table_rows.withColumn("_t", F.lower("table_name")).drop("table_name").join(
        laid.drop("_head", "new_name"), [*PAGE, "_t"]
    )
    ranked = numbered(
        settle(rows), [*group, "member_no"], [F.col("row_index")], span("row_index", ROW_CHUNK), "_r"
    )
    new_name = F.col("_f.new_name")
    if direction == "vertical":
        out = ranked.filter("_r > _skip").select(
            *group, "page_no", new_name.alias("table_name"),
            (F.col("_row0") + F.col("_r") - F.col("_skip")).cast("int").alias("row_index"),
            _padded(F.col("cells"), F.col("_wide")).alias("cells"),
        )
        moved_row, moved_col = F.col("_row0") + F.col("start_row") - F.col("_skip"), F.col("start_col")
    else:
        parts = ranked.filter("cells IS NOT NULL").select(
            *group, F.col("_f.page_no").alias("page_no"), new_name.alias("table_name"), "_total",
            F.col("_r").alias("row_index"),
            F.struct(F.col("_col0").cast("int").alias("at"), _padded(F.col("cells"), F.col("n")).alias("cells")).alias("_part"),
        )
        out = parts.groupBy(*group, "page_no", "table_name", "row_index", "_total").agg(
            F.array_sort(F.collect_list("_part")).alias("_parts")
        )

        def beside(row: Column, part: Column) -> Column:
            return F.concat(row, F.array_repeat(F.lit(""), part["at"] - F.size(row)), part["cells"])

        # Members without the row leave blanks.
        laid_out = F.aggregate("_parts", F.array().cast("array<string>"), beside)
        out = out.select(
            *group, "page_no", "table_name", "row_index",
            given(laid_out, lambda row: _padded(row, F.col("_total"))).alias("cells"),
        )
        moved_row, moved_col = F.col("start_row"), F.col("_col0") + F.col("start_col")
    if spans is None:
        return out
    kept = spans.withColumn("_t", F.lower("table_name")).drop("table_name").join(laid, [*PAGE, "_t"])
    if direction == "vertical":
        kept = kept.filter("NOT (_skip = 1 AND start_row = 1)")
    moved = kept.select(
        *group, new_name.alias("table_name"), moved_row.cast("int").alias("start_row"),
        moved_col.cast("int").alias("start_col"), "row_span", "col_span", "merged_text",
    )
    return out, moved


def grid_to_tables(grid_rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat grid rows to tables by page and name, with spans relative to their table and
    clipped to it.  ``spans``: ``doc_id, start_row`` (grid row), ``start_col`` from 1, extents."""
    name = F.when(is_blank("table_name"), "表1").otherwise(strip("table_name"))
    rows = grid_rows.withColumn("table_name", name)
    filled = _last_filled(F.col("cells"))
    ranked = numbered(rows, TABLE, [F.col("grid_row")], span("grid_row", ROW_CHUNK), "row_index", most={"_n": filled})
    tables = ranked.select(
        *TABLE, "row_index", _padded(F.col("cells"), F.greatest(F.col("_n"), F.lit(1))).alias("cells")
    )
    facts = rows.groupBy(*TABLE).agg(
        F.greatest(F.max(filled), F.lit(1)).alias("_n"), F.min("grid_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # A span starts on a row of its table's stretch of the grid.
    cover = facts.select(
        "doc_id", "page_no", "table_name", "_n", "_first", "_rows",
        F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_rows") - 1)).alias("start_row"),
    )
    here = spans.join(cover, ["doc_id", "start_row"]).filter("start_col <= _n")
    row = F.col("start_row") - F.col("_first") + 1
    moved = here.select(
        *TABLE, row.cast("int").alias("start_row"), "start_col",
        F.least(F.col("row_span"), F.col("_rows") - row + 1).cast("int").alias("row_span"),
        F.least(F.col("col_span"), F.col("_n") - F.col("start_col") + 1).cast("int").alias("col_span"), "merged_text",
    )
    return tables, moved


def tables_to_grid(table_rows: DataFrame, spans: DataFrame | None = None):
    """Tables of a document as one flat grid: ``grid_row, page_no, table_name, row_index`` and
    cells padded to the widest table.  Spans move to grid rows."""
    order = [F.col("page_no"), F.col("table_name"), F.col("row_index")]
    ranked = settle(
        numbered(table_rows, ["doc_id"], order, span("page_no", 64), "grid_row", most={"_n": F.size("cells")})
    )
    grid = ranked.select(
        "doc_id", "grid_row", "page_no", "table_name", "row_index", _padded(F.col("cells"), F.greatest(F.col("_n"), F.lit(1))).alias("cells")
    )
    if spans is None:
        return grid
    base = ranked.groupBy(*TABLE).agg(F.min("grid_row").alias("_base"))
    moved = spans.join(base, TABLE).select(
        "doc_id", (F.col("_base") + F.col("start_row") - 1).cast("int").alias("start_row"), "start_col",
        "row_span", "col_span", "merged_text",
    )
    return grid, moved


def edit_grid(table_rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Add or delete last rows and columns: ``edits`` has table key, ``add_rows, delete_rows,
    add_columns, delete_columns``.  Ragged rows are padded; one row and column always stay."""
    shape = table_rows.groupBy(*TABLE).agg(
        F.count(F.lit(1)).cast("int").alias("_rows"), F.max(F.size("cells")).alias("_n")
    )
    goal = shape.join(edits, TABLE, "left").fillna(0, ["add_rows", "delete_rows", "add_columns", "delete_columns"])
    goal = goal.select(
        *TABLE, "_rows",
        F.greatest(F.lit(1), F.col("_rows") + F.col("add_rows") - F.col("delete_rows")).alias("_rows2"),
        F.greatest(F.lit(1), F.greatest(F.col("_n"), F.lit(1)) + F.col("add_columns") - F.col("delete_columns")).alias("_n2"),
    )
    goal = settle(goal)
    ranked = numbered(table_rows, TABLE, [F.col("row_index")], span("row_index", ROW_CHUNK), "row_index")
    kept = ranked.join(goal, TABLE).filter("row_index <= _rows2").select(
        *TABLE, "row_index", _padded(F.col("cells"), F.col("_n2")).alias("cells")
    )
    fresh = goal.filter("_rows2 > _rows").select(
        *TABLE, F.explode(F.sequence(F.col("_rows") + 1, F.col("_rows2"))).alias("row_index"),
        F.array_repeat(F.lit(""), F.col("_n2")).alias("cells"),
    )
    return kept.unionByName(fresh)


# --- export ----------------------------------------------------------------------------

def export_tables(table_rows: DataFrame, spans: DataFrame | None = None, fmt: str = "tsv") -> DataFrame:
    """One text line per table row: ``tsv``, ``csv`` or ``html`` (``<tr>`` with colspan and rowspan).

    Cells covered by a span are blank; the head of a span shows its text.
    """
    rows = table_rows.select(*TABLE, "row_index", F.posexplode("cells").alias("_i", "text"))
    cells = rows.withColumn("col_no", F.col("_i") + 1).withColumn("text", F.coalesce("text", F.lit("")))
    if spans is not None:
        cover = spans.select(
            *TABLE, F.explode(F.sequence("start_row", F.col("start_row") + F.col("row_span") - 1)).alias("row_index"),
            F.col("start_row").alias("_r1"), F.col("start_col").alias("_c1"),
            (F.col("start_col") + F.col("col_span") - 1).alias("_c2"), "row_span", "col_span", "merged_text",
        )
        on = [cells[k] == cover[k] for k in [*TABLE, "row_index"]]
        on.append(cells["col_no"].between(cover["_c1"], cover["_c2"]))
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        cells = cells.join(cover, cond, "left").select(
            *[cells[c] for c in [*TABLE, "row_index", "col_no", "text"]],
            "_r1", "_c1", "row_span", "col_span", "merged_text",
        )
    else:
        none = F.lit(None).cast("int")
        cells = cells.withColumns({c: none for c in ("_r1", "_c1", "row_span", "col_span")}).withColumn(
            "merged_text", F.lit("")
        )
    inside = F.col("_r1").isNotNull()
    head = inside & (F.col("_r1") == F.col("row_index")) & (F.col("_c1") == F.col("col_no"))
    shown = F.when(inside & ~head, "").when(
        head & is_blank("text"), F.coalesce("merged_text", F.lit(""))
    ).otherwise(F.col("text"))
    cells = cells.withColumn("_shown", shown)
    if fmt == "html":
        safe = F.col("_shown")
        for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n", "<br>")):
            safe = F.replace(safe, F.lit(raw), F.lit(code))
        attr = F.concat(
            F.when(head & (F.col("col_span") > 1), F.concat(F.lit(' colspan="'), "col_span", F.lit('"'))).otherwise(""),
            F.when(head & (F.col("row_span") > 1), F.concat(F.lit(' rowspan="'), "row_span", F.lit('"'))).otherwise(""),
        )
        piece = F.when(inside & ~head, "").otherwise(F.concat(F.lit("<td"), attr, F.lit(">"), safe, F.lit("</td>")))
        glue, wrap = "", lambda c: F.concat(F.lit("<tr>"), c, F.lit("</tr>"))
    elif fmt == "csv":
        quoted = F.concat(F.lit('"'), F.replace("_shown", F.lit('"'), F.lit('""')), F.lit('"'))
        piece = F.when(F.col("_shown").rlike('[",\r\n]'), quoted).otherwise(F.col("_shown"))
        glue, wrap = ",", lambda c: c
    elif fmt == "tsv":
        piece = F.regexp_replace(F.regexp_replace("_shown", "\r", ""), "\n", " ")
        glue, wrap = "\t", lambda c: c
    else:
        raise ValueError(f"unknown format {fmt!r}")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("col_no", piece.alias("p")))), lambda s: s["p"])
    return cells.groupBy(*TABLE, "row_index").agg(wrap(F.array_join(parts, glue)).alias("line"))

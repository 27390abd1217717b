"""Steps whose work must not grow faster than their input."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import grouping, reading, tables


def _analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_joining_trims_a_line_once(spark):
    df = spark.createDataFrame([(["a-", " ", "b", "1 ", "2"],)], "l array<string>")
    for join, text in ((T.join_western, "ab 1 2"), (T.join_spaced_alnum, "a-b 1 2")):
        out = df.select(join(F.col("l")).alias("t"))
        # Named in the lambda of every element, all lines were trimmed again for each of them.
        assert _analyzed(out).count("btrim") + _analyzed(out).count("trim(both") <= 1
        assert out.collect()[0].t == text


def test_a_band_meets_its_items_in_one_join(spark, monkeypatch):
    stored = []
    for module in (grouping, tables):
        monkeypatch.setattr(module, "settle", lambda df, keep=module.settle: stored.append(df) or keep(df))
    rows = [(1, 1, 10 * i + j, f"{i}{j}", 100 * j, 40 * i, 20) for i in range(3) for j in range(3)] + [(2, 1, 1, " x ", 0, 0, 20)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_id int, text string, x int, y int, height int")
    out = tables.join_cell_text(lines, ["doc_id", "page_no"])
    # The counts, the lines of crowded cells and the lines with their bands.
    assert len(stored) == 3
    assert {r.doc_id: r.text for r in out.collect()} == {1: "00 01 02 10 11 12 20 21 22", 2: "x"}


def test_runaway_texts_are_cleaned_once(spark):
    rows = [
        "aaaaa tail", "  x ok x  ", "no no no no end", "(a b) (a b) (a b) (a b)z", "1999l. and 2001a1.", "ab\nababababab",
        "ababababab\nab", "　\u00a0", "", None, "cut 漢漢漢漢漢", "é é é é ", "haha haha",
    ]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_id int, text string")
    out = reading.without_runaway(lines)
    # A filter on the cleaned text had every expression of it twice in the plan.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\\d{4}[a-z]?)l") == 1
    assert {r.line_id: r.text for r in out.collect()} == {
        1: "x ok x", 3: "(a b) (a b) (a b) (a b)z", 4: "1999]. and 2001a].", 5: "ab", 6: "ababababab\nab", 10: "cut", 11: "é é é é", 12: "haha haha",
    }


def test_branches_of_a_page_build_run_at_the_same_time(spark, monkeypatch):
    from threading import Barrier

    from quire.plans import document

    met = Barrier(5)

    class Met(Exception):
        pass

    def meet(*_, **__):
        met.wait(60)
        raise Met

    for step in ("format_paragraphs", "reading_order", "extract_tables"):
        monkeypatch.setattr(document, step, meet)
    lines = spark.createDataFrame([(1, 1, 1, "a", 0, 0, 10, 10, False)], "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, is_vertical boolean")
    regions = spark.createDataFrame([], "doc_id long, page_no int, region_seq int, name string, type string, orientation string, x int, y int, width int, height int, rule_lines array<struct<is_vertical: boolean, pos: int, start: int, end: int>>")
    with pytest.raises(Met):
        document.build_pages(lines, regions, regions)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parse", ["parse_ocr_lines", "parse_display_lines"])
def test_a_json_line_is_read_once(spark, parse):
    from quire.sources import pages

    item = '{"text": "%s", "confidence": 0.9, "boundingBox": [[1, 2], [1, 42], [51, 2], [51, 42]]}'
    raws = ['{"contents": [[%s]]}' % (item % "ab"), '{"results": [%s]}' % (item % '[{ \\\\\\" cd'), "{", "", "[]"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(raws)], "doc_id long, page_no int, raw string")
    out = getattr(pages, parse)(df)
    # Every side of the box and every test on a line read its fields anew.
    assert _optimized(out).count("boundingBox") == 1
    got = {tuple(r) for r in out.select("page_no", "text", "x", "y", "width", "height").collect()}
    assert got == {(0, "ab", 1, 2, 50, 40), (1, '[{ \\" cd', 1, 2, 50, 40)}


def test_nesting_counts_every_level(spark):
    from quire.sources.pages import _nesting

    texts = ["", "1", "[]", "{}", '[{"a": [[1], [2, {"b": "[[["}]]}]', "[" * 40 + "]" * 40, '{"a": [], "b": {"c": {}}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(_nesting(F.col("t")).alias("n")).collect()] == [0, 0, 1, 1, 5, 40, 3]


def test_a_cell_looks_for_its_split_once(spark):
    from quire.operators import grid

    cells = spark.createDataFrame(
        [(1, 1, 1, 1, 1, "12a b"), (1, 1, 1, 1, 2, "c"), (1, 1, 1, 2, 1, "(x) y z")],
        "doc_id long, page_no int, table_seq int, row_no int, col_no int, text string",
    )
    out = grid.split_cells(cells, cells.filter("col_no = 1"))
    assert _optimized(out).count("3400") <= 4
    assert {(r.row_no, r.col_no): r.text for r in out.collect()} == {(1, 1): "12a", (1, 2): "b c", (2, 1): "(x)", (2, 2): "y z"}


def test_small_pages_are_settled_within_one_row(spark, monkeypatch):
    import random

    from quire.operators import regions as R

    rng = random.Random(3)
    rows = []
    for page in range(1, 31):
        for ord_ in range(rng.randint(0, 16)):
            start = rng.randrange(0, 150, 50)
            rows.append((1, page, rng.choice("hv"), rng.randrange(0, 400, 20), start, start + rng.randrange(100, 500, 50), ord_))
    rows += [(1, 1, "h", None, 0, 9, 90), (1, 2, "h", 5, 0, 500, None), (None, 3, "h", 5, 0, 500, 91), (1, 4, None, 5, 0, 500, 92)]
    segments = spark.createDataFrame(rows, "doc_id long, page_no int, orient string, pos int, start int, end int, ord int")
    pages = spark.createDataFrame([(1, p, None if p == 5 else 800, 600) for p in range(1, 28)], "doc_id long, page_no int, width int, height int")
    stored, found = [], {}
    monkeypatch.setattr(R, "settle", lambda df, keep=R.settle: stored.append(df) or keep(df))
    for most in (64, 0):
        monkeypatch.setattr(R, "PAGE_SEGMENTS", most)
        monkeypatch.setattr(R, "PAGE_RECTANGLES", most)
        for open_tables in (True, False):
            boxes = R.bordered_regions(segments, pages, open_tables)
            found[most, open_tables] = sorted(tuple(r) for r in boxes.collect())
            for margin in (5, 60):
                kept = R.drop_contained(boxes, margin).select("doc_id", "page_no", "x", "y", "width", "height")
                found[most, open_tables, margin] = sorted(tuple(r) for r in kept.collect())
        if most:
            # Joined by rows, each of the six calls stored four frames or more.
            assert len(stored) == 2 * 6
    assert len(found[64, True, 60]) < len(found[64, True, 5]) < len(found[64, True]) > len(found[64, False]) > 20
    assert {k[1:]: v for k, v in found.items() if k[0] == 64} == {k[1:]: v for k, v in found.items() if k[0] == 0}


def test_tangled_rows_are_walked_once(spark, sf):
    from quire.catalog import QUERIES

    assert "MapInPandas" not in _optimized(QUERIES["group_rows_crowded"](spark, sf))


TABLE_ROWS = "doc_id long, page_no int, table_name string, row_index int, cells array<string>"


def test_grid_rows_meet_their_numbers_and_width_in_one_join(spark, sf):
    from quire.catalog.tables import book_rows
    from quire.operators import grid

    # The header came from a second reading and numbering of the lines.
    assert _optimized(book_rows(spark, sf)).count("Relation") == 1
    rows = [(1, 1, "a", 1, ["x", "y", " "]), (1, 1, "a", 2, ["z"]), (1, 2, " b ", 1, None), (1, 2, "b", 2, ["q", None, "r", ""]), (2, 1, "", 1, [])]
    flat = grid.tables_to_grid(spark.createDataFrame(rows, TABLE_ROWS))
    assert "Join" not in _optimized(flat)
    none = spark.createDataFrame([], "doc_id long, start_row int, start_col int, row_span int, col_span int, merged_text string")
    out = grid.grid_to_tables(flat, none)[0]
    assert _optimized(out).count("Join") == 1
    got = {(r.doc_id, r.page_no, r.table_name, r.row_index): r.cells for r in out.collect()}
    assert got == {
        (1, 1, "a", 1): ["x", "y"], (1, 1, "a", 2): ["z", ""], (1, 2, "b", 1): None, (1, 2, "b", 2): ["q", "", "r"], (2, 1, "表1", 1): [""],
    }


def test_tables_are_laid_beside_one_another_by_whole_rows(spark):
    from quire.operators import grid

    rows = [(1, 1, "a", 1, ["1", "2"]), (1, 1, "a", 2, ["3"]), (1, 2, "b", 1, None), (1, 2, "b", 5, ["x", None, "y"]), (1, 3, "C", 1, ["p"]), (1, 3, "C", 2, ["q"]), (1, 3, "C", 3, ["r"])]
    spec = [(1, 7, 3, 3, "c", "n"), (1, 7, 1, 1, "a", "n"), (1, 7, 2, 2, "b", "n")]
    out = grid.concat_tables(
        spark.createDataFrame(rows, TABLE_ROWS),
        spark.createDataFrame(spec, "doc_id long, group_no int, member_no int, page_no int, table_name string, new_name string"),
        direction="horizontal",
    )
    # Every cell was a row of its own in the shuffle.
    assert "Generate" not in _optimized(out)
    assert {r.row_index: r.cells for r in out.collect()} == {
        1: ["1", "2", "", "", "", "p"], 2: ["3", "", "x", "", "y", "q"], 3: ["", "", "", "", "", "r"],
    }


def test_table_lines_take_their_slots_in_few_stored_steps(spark, monkeypatch):
    stored = []
    for module in (grouping, reading):
        monkeypatch.setattr(module, "settle", lambda df, keep=module.settle: stored.append(df) or keep(df))
    # Two columns read row by row, crowded ones on page 2, a line without a place (9) on page 1.
    rows = [(1, 1, 1, 0, 0, 50, False), (1, 1, 2, 0, 10, 50, True), (1, 1, 3, 100, 10, 50, True), (1, 1, 4, 0, 0, 50, None), (1, 1, 5, 0, 20, 50, True)]
    rows += [(1, 1, 6, 0, 0, 50, False), (1, 1, 7, 100, 20, 50, True), (1, 1, 8, 0, 0, 50, False), (1, 1, 9, None, 5, 50, True), (1, 1, 10, 0, 0, 9, False)]
    rows += [(1, 2, i, 13 * i % 70, i, 10, True) for i in range(1, 30)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_id int, x int, y int, width int, is_table boolean")
    ordered = reading.order_table_lines(lines)
    # Lines were numbered three times and joined with their columns on the way.
    assert len(stored) == 4 and sum(_optimized(d).count("Join ") for d in [*stored, ordered]) <= 4
    out = ordered.collect()
    assert [r.line_id for r in sorted(out, key=lambda r: r.position) if r.page_no == 1] == [1, 2, 5, 3, 6, 7, 8, 10]
    assert sorted(r.position for r in out) == sorted([*range(1, 9), *range(1, 30)])


def test_cells_come_out_of_one_row_a_region(spark):
    from quire.operators import regions as R

    rows = [(1, 1, 1, "h", p) for p in (40, 10, 40, 25)] + [(1, 1, 1, "v", p) for p in (5, None, 9)] + [(1, 1, 2, "h", 3), (1, 1, 2, "v", 3), (1, 1, None, "h", 1)]
    positions = spark.createDataFrame(rows, "doc_id long, page_no int, region_seq int, orient string, pos int")
    out = R.cells_from_positions(positions)
    # All gaps of all regions were sorted twice and joined.
    assert "Join" not in _optimized(out) and "Window" not in _optimized(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1, 1, 2, 5, 10, 4, 15), (1, 1, 1, 2, 2, 5, 25, 4, 15)]


def test_positions_are_cut_into_runs_within_their_list(spark):
    from quire.operators import regions as R

    rows = [(1, p) for p in (30, 10, 14, 14, 18, 40, 41, 90)] + [(2, 7)]
    positions = spark.createDataFrame(rows, "doc_id long, pos int")
    runs = R._position_runs(positions, ["doc_id"], 8)
    assert "Window" not in _optimized(runs)
    got = sorted((r.doc_id, [tuple(p) for p in r["_ps"]]) for r in runs.collect())
    assert got == [(1, [(10, 1), (14, 2), (18, 1)]), (1, [(30, 1)]), (1, [(40, 1), (41, 1)]), (1, [(90, 1)]), (2, [(7, 1)])]

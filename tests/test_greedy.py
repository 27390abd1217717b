"""Greedy operators against direct loops over small crowded pages."""

import random

from pyspark.sql import functions as F

from quire import PAGE
from quire.operators import bands as B
from quire.operators import detections as N
from quire.operators import grouping as G
from quire.operators import reading as O
from quire.operators import regions as R
from quire.operators import tables as T

LINE = "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, confidence double, is_vertical boolean"


def crowded(spark, pages=12, lines=25, seed=5):
    rnd = random.Random(seed)
    data = []
    for page in range(pages):
        for i in range(lines):
            data.append(
                (1, page, i, "w" * rnd.randrange(1, 12), rnd.randrange(0, 400), rnd.randrange(0, 260), rnd.randrange(8, 90),
                 rnd.randrange(8, 30), rnd.randrange(0, 100) / 100, rnd.random() < 0.3)
            )
    return spark.createDataFrame(data, LINE)


def loop_groups(items, ratio):
    """Row of each item: nearest row mean within the reach, not overlapping."""
    groups = []
    for it in sorted(items, key=lambda r: (2 * r.y + r.height, r.line_id)):
        c, best, dist = it.y + it.height / 2, None, 1e9
        for g in groups:
            d = abs(c - sum(m.y + m.height / 2 for m in g) / len(g))
            if d < min(it.height, min(m.height for m in g)) * ratio and d < dist:
                if not any(max(it.x, m.x) < min(it.x + it.width, m.x + m.width) for m in g):
                    best, dist = g, d
        if best is None:
            best = []
            groups.append(best)
        best.append(it)
    return {frozenset(m.line_id for m in g) for g in groups}


def test_rows_match_loop(spark):
    df = crowded(spark)
    got = G.group_along(
        df, PAGE, "line_id", 2 * F.col("y") + F.col("height"), F.col("height") * 0.55 * 2, F.col("x"), F.col("x") + F.col("width")
    )
    sets = {}
    for r in got.groupBy(*PAGE, "band", "grp").agg(F.collect_list("line_id").alias("ids")).collect():
        sets.setdefault(r.page_no, set()).add(frozenset(r.ids))
    for page in sets:
        items = df.filter(F.col("page_no") == page).collect()
        assert sets[page] == loop_groups(items, 0.55)


def loop_duplicates(items):
    conf = {r.line_id: r.confidence for r in items}
    gone = set()
    for i, a in enumerate(items):
        if a.line_id in gone:
            continue
        for b in items[i + 1 :]:
            if b.line_id in gone:
                continue
            v = max(0, min(a.y + a.height, b.y + b.height) - max(a.y, b.y)) / max(a.height, b.height)
            h = max(0, min(a.x + a.width, b.x + b.width) - max(a.x, b.x)) / max(a.width, b.width)
            main, side = (v, h) if a.is_vertical or b.is_vertical else (h, v)
            if not (side > 0.4 and main > 0.5):
                continue
            top = max(conf[a.line_id], conf[b.line_id])
            longer = len(b.text) > len(a.text) + 3
            shorter = len(a.text) > len(b.text) + 3
            if longer or (not shorter and conf[b.line_id] > conf[a.line_id] and conf[b.line_id] > 0):
                conf[b.line_id] = top
                gone.add(a.line_id)
                break
            conf[a.line_id] = top
            gone.add(b.line_id)
    return {(k, v) for k, v in conf.items() if k not in gone}


def test_duplicates_match_loop(spark):
    df = crowded(spark, lines=40, seed=9)
    got = {}
    for r in N.resolve_duplicate_lines(df).collect():
        got.setdefault(r.page_no, set()).add((r.line_id, r.confidence))
    for page in got:
        items = df.filter(F.col("page_no") == page).orderBy("line_id").collect()
        assert got[page] == loop_duplicates(items)


def test_contained_chain(spark):
    # Each rectangle is held by the one before within the margin, but not by the first.
    data = [(1, 1, i + 1, 10 - 4 * i, 10, 100 + i - 8 * i, 100 - i) for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, page_no int, region_seq int, x int, y int, width int, height int")
    kept, rects = [], sorted(data, key=lambda r: (-r[5] * r[6], r[2]))
    for r in rects:
        if not any(
            k[3] <= r[3] + 5 and k[4] <= r[4] + 5 and k[3] + k[5] >= r[3] + r[5] - 5 and k[4] + k[6] >= r[4] + r[6] - 5 for k in kept
        ):
            kept.append(r)
    assert {r.region_seq for r in R.drop_contained(df).collect()} == {k[2] for k in kept}


def test_split_lines(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "left right", 0, 0, 100, 10, [50]), (1, 1, 2, "abcdefgh", 0, 0, 80, 10, [20, 60]), (1, 1, 3, "short", 0, 0, 20, 10, [15])],
        "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, rules array<int>",
    )
    got = [(r.line_id, r.piece_no, r.text, r.x, r.width) for r in T.split_lines_at_rules(df).orderBy("line_id", "piece_no").collect()]
    assert got == [
        (1, 0, "left", 0, 50), (1, 1, "right", 50, 50),
        (2, 0, "ab", 0, 20), (2, 1, "cdef", 20, 40), (2, 2, "gh", 60, 20),
        (3, 0, "short", 0, 20),
    ]


def test_wrapped_lines_cover_all(spark):
    schema = "doc_id long, page_no int, det_id int, x1 int, y1 int, x2 int, y2 int, confidence double, class_index int"
    lines = spark.createDataFrame([(1, 1, i, 10, 36 * i, 300, 36 * i + 24, 0.9 - i / 100, 1) for i in range(6)], schema)
    blocks = spark.createDataFrame([(1, 1, 50, 12, 2, 200, 22, 0.5, 0), (1, 1, 51, 600, 600, 900, 900, 0.5, 0)], schema)
    pages = spark.createDataFrame([(1, 1, 1000, 1000)], "doc_id long, page_no int, width int, height int")
    out = N.reconcile_blocks(blocks, lines, pages).collect()
    made = sorted(r.y1 for r in out if r.det_id is None)
    # Block 50 is a piece of the first line; every second line gets a block of its own.
    assert not [r for r in out if r.det_id == 50] and made == [0, 62, 134]


def test_order_is_free_of_input_order_and_shift(spark):
    df = crowded(spark, pages=3).withColumn("is_vertical", F.lit(False))
    base = {tuple(r) for r in O.reading_order(df).collect()}
    moved = df.withColumns({"x": F.col("x") + 37, "y": F.col("y") + 11}).orderBy(F.rand(1))
    assert {tuple(r) for r in O.reading_order(moved).collect()} == base


# --- crowded pages --------------------------------------------------------------------


def loop_sweep(items, rule, floor):
    """Every group is held against every item."""
    groups, chosen = [], []
    for c, r, lo, hi in items:
        best, nearest = None, float("inf")
        for i, (own, reaches, boxes) in enumerate(groups):
            d = abs(c - sum(own) / len(own))
            if rule == "first":
                if best is None and d < r:
                    best = i
                continue
            within = d <= max(floor, sum(reaches) / len(own)) if rule == "average" else d < min(r, *reaches)
            if within and d < nearest and not (rule == "nearest_free" and any(max(lo, a) < min(hi, b) for a, b in boxes)):
                best, nearest = i, d
        if best is None:
            best = len(groups)
            groups.append(([], [], []))
        for part, value in zip(groups[best], (c, r, (lo, hi))):
            part.append(value)
        chosen.append(best)
    return chosen, [sum(own) / len(own) for own, _, _ in groups]


def test_sweep_equals_loop():
    rnd = random.Random(1)
    for trial in range(600):
        items = []
        for _ in range(rnd.randrange(1, 60)):
            lo = rnd.randrange(100)
            items.append((rnd.randrange(rnd.choice([5, 60, 300])), float(rnd.choice([0, 2, 5, 16.5, 30])), lo, lo + rnd.choice([0, 1, 7, 40, 90])))
        if trial % 2:
            items += [rnd.choice(items) for _ in range(20)]
        items.sort()
        for rule in ("nearest_free", "nearest", "first", "average"):
            floor = rnd.choice([0.0, 8.0])
            assert G.sweep(items, rule, floor) == loop_sweep(items, rule, floor)


def test_one_page_with_thousands_of_overlapping_lines(spark):
    # 20,000 lines in 15 rows of two columns; every line overlaps all others of its column and row.
    df = spark.range(20_000).selectExpr(
        "1L AS doc_id", "1 AS page_no", "id AS line_id", "cast(60 + 420 * (id % 2) AS int) AS x", "cast(40 * (id % 15) + id % 3 AS int) AS y",
        "cast(100 + id % 50 AS int) AS width", "20 AS height",
    )
    rows = G.group_along(
        df, PAGE, "line_id", 2 * F.col("y") + F.col("height"), F.col("height") * 0.7, F.col("x"), F.col("x") + F.col("width")
    ).join(df, [*PAGE, "line_id"])
    sizes = rows.groupBy("band", "grp").agg(F.count("*").alias("n"), F.countDistinct("x").alias("columns")).toPandas()
    assert sizes.n.sum() == 20_000 and (sizes.n == sizes["columns"]).all() and (sizes.n == 2).mean() > 0.9


def test_merging_through_the_grid_equals_all_boxes(spark):
    rnd = random.Random(7)
    schema = "doc_id long, page_no int, det_id int, x1 int, y1 int, x2 int, y2 int, confidence double, class_index int"
    data = []
    for page in range(6):
        for i in range(60):
            x, y = rnd.randrange(-20, 500), rnd.randrange(-20, 200)
            w, h = rnd.choice([(rnd.randrange(200), rnd.randrange(10, 30)), (rnd.randrange(10, 30), rnd.randrange(20, 200)), (rnd.randrange(1, 300),) * 2])
            data.append((1, page, i, x, y, x + w, y + h, rnd.randrange(100) / 100, rnd.choice([0, 1, 1, 2, 13, 16])))
    got = {tuple(r) for r in N.merge_detections(spark.createDataFrame(data, schema)).collect()}
    columns = [part.split()[0] for part in schema.split(", ")]
    want = set()
    for page in range(6):
        kept = []
        for row in sorted((r for r in data if r[1] == page), key=lambda r: (-r[7], -(r[5] - r[3]) * (r[6] - r[4]), r[2])):
            box = dict(zip(columns, row))
            if N._taker(box, kept, 0.5, 0.8, 0.85, 80)[0] is None:
                kept.append(box)
        want |= {tuple(k[c] for c in columns) for k in kept}
    assert got == want


def test_many_copies_of_one_line(spark):
    df = spark.range(3000).selectExpr(
        "1L AS doc_id", "1 AS page_no", "cast(id AS int) AS line_id", "'same' AS text", "10 AS x", "10 AS y", "80 AS width", "20 AS height",
        "id / 3000.0D AS confidence", "false AS is_vertical",
    )
    kept = N.resolve_duplicate_lines(df).collect()
    assert [(r.line_id, r.confidence) for r in kept] == [(2999, 2999 / 3000)]


def test_grid_join_counts_each_pair_once(spark):
    rnd = random.Random(3)
    boxes = [(1, 1, i, x := rnd.randrange(-300, 900), y := rnd.randrange(-300, 900), x + rnd.randrange(400), y + rnd.randrange(400)) for i in range(80)]
    schema = "doc_id long, page_no int, {p}id int, {p}x1 int, {p}y1 int, {p}x2 int, {p}y2 int"
    a, b = (spark.createDataFrame(boxes, schema.format(p=p)) for p in "ab")
    corners = lambda p: tuple(F.col(p + e) for e in ("x1", "y1", "x2", "y2"))
    meet = (F.least("ax2", "bx2") >= F.greatest("ax1", "bx1")) & (F.least("ay2", "by2") >= F.greatest("ay1", "by1"))
    got = sorted((r.aid, r.bid) for r in B.grid_join(a, b, corners("a"), corners("b"), meet, cell=64).collect())
    want = sorted(
        (p[2], q[2]) for p in boxes for q in boxes
        if min(p[5], q[5]) >= max(p[3], q[3]) and min(p[6], q[6]) >= max(p[4], q[4])
    )
    assert got == want


def test_long_table_in_proportion(spark):
    """A table of 3,000 ruled rows with a line in each cell, some cells with two lines one above the other."""
    n = 3000
    lines = spark.range(n).selectExpr(
        "1L AS doc_id", "1 AS page_no", "explode(array(0, 1, 2)) AS c", "id AS r"
    ).selectExpr(
        "doc_id", "page_no", "cast(r * 3 + c AS int) AS line_id", "concat(r, ':', c) AS text", "cast(10 + 100 * (c % 2) AS int) AS x",
        "cast(60 * r + 5 + 26 * cast(c = 2 AS int) AS int) AS y", "50 AS width", "20 AS height", "false AS is_vertical",
    ).filter("c < 2 OR r % 2 = 0")
    ruled = "array_union(array(named_struct('is_vertical', true, 'pos', 100, 'start', 0, 'end', 1)), transform(sequence(1, {0}), k -> named_struct('is_vertical', false, 'pos', 60 * k, 'start', 0, 'end', 200)))"
    regions = spark.range(1).selectExpr(
        "1L AS doc_id", "1 AS page_no", "1 AS region_seq", "'t' AS name", "'table' AS type", "0 AS x", "0 AS y", "200 AS width",
        f"{60 * n} AS height", f"{ruled.format(n - 1)} AS rule_lines",
    )
    out = T.extract_tables(lines, regions).orderBy("row_index").collect()
    want = []
    for r in range(n):
        want.append([f"{r}:0", f"{r}:1"])
        if r % 2 == 0:
            want.append([f"{r}:2", ""])
    assert [list(r.cells) for r in out] == want

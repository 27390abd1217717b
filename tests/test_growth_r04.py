"""Steps that deal their rows out no more often than they must."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import grouping, tables

LINE = "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, is_vertical boolean"
REGION = (
    "doc_id long, page_no int, region_seq int, name string, type string, orientation string, x int, y int, width int, height int, "
    "rule_lines array<struct<is_vertical: boolean, pos: int, start: int, end: int>>"
)


def _recorded(monkeypatch, *modules):
    stored = []
    for module in modules:
        monkeypatch.setattr(module, "settle", lambda df, keep=module.settle: stored.append(df) or keep(df))
    return stored


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


@pytest.mark.parametrize("rule", ["nearest_free", "nearest", "average"])
def test_items_are_dealt_out_once_to_be_grouped(spark, monkeypatch, rule):
    rng = random.Random(5)
    items = [
        (d, i, rng.choice([None, *range(0, 300, 7)]) if d else 40 * (i % 9) + i % 3, rng.choice([10, 20, 35]), x := rng.randrange(200), x + rng.choice([0, 5, 60]), i)
        for d in (0, 1, 2, 3, None) for i in range(70)
    ]
    df = spark.createDataFrame(items, "doc_id long, id int, c2 int, reach int, lo int, hi int, mark int")
    args = (df, ["doc_id"], "id", F.col("c2"), F.col("reach"), F.col("lo"), F.col("hi"), rule, 4.0)
    stored = _recorded(monkeypatch, grouping)
    once = sorted(map(tuple, grouping.group_along(*args, carry=["mark"]).collect()))
    # Centres, bands and items used to be grouped, joined and stored one after another.
    assert len(stored) == 1 and _exchanges(stored[0]) == 1
    monkeypatch.setattr(grouping, "MOST_ITEMS", 0)
    assert once and once == sorted(map(tuple, grouping.group_along(*args, carry=["mark"]).collect()))


def test_a_line_finds_its_places_in_the_lists_of_its_table(spark, monkeypatch):
    rng = random.Random(2)
    lines, regions = [], []
    for doc in range(6):
        rules = [(True, rng.randrange(0, 600), 0, 0) for _ in range(doc)] + [(False, rng.randrange(0, 900), 0, 0) for _ in range(5 * doc)]
        regions.append((doc, 1, 1, "", "table", "auto", 0, 0, 600, 900, rules))
        lines += [
            (doc, 1, i, rng.choice(["a b", "12 34", "東京 大阪", "x"]), rng.randrange(500), rng.randrange(880), rng.choice([8, 40, 200]), 20, False)
            for i in range(60)
        ]
    args = spark.createDataFrame(lines, LINE), spark.createDataFrame(regions, REGION)
    stored = _recorded(monkeypatch, tables)
    out = sorted(map(tuple, tables.extract_tables(*args).collect()))
    # The lines of the tables, with their places, those cut by rules, the cells, and cells of several lines; places were counted in five more.
    texts = [d for d in stored if "text" in d.columns or "_l" in d.columns]
    assert len(texts) == 5 and len([d for d in stored if "line_id" in d.columns and d not in texts]) == 0
    assert sum(len("".join(c.split())) for r in out for c in r[5]) == sum(len("".join(l[3].split())) for l in lines)
    monkeypatch.setattr(tables, "FEW", 0)
    assert out == sorted(map(tuple, tables.extract_tables(*args).collect()))


def _pages(spark):
    rng = random.Random(11)
    words = ["a b", "東京 大阪", "alpha beta", "結論。", "Section 3", "「引用」", "長い文字列です続く", "end.", "第一節 方法"]
    rows = [
        (doc, page, i, rng.choice(words), rng.randrange(0, 900), 25 * rng.randrange(0, 30) + rng.randrange(4), rng.choice([20, 80, 300]), rng.choice([20, 24, 90]), rng.random() < doc / 3)
        for doc in range(4) for page in (1, 2) for i in range(rng.choice([1, 12, 40]))
    ]
    return spark.createDataFrame(rows, LINE)


def test_pages_are_dealt_out_once_for_their_paragraphs(spark, monkeypatch):
    from quire.operators import paragraphs, reading

    lines = _pages(spark)
    stored = _recorded(monkeypatch, grouping, paragraphs)

    def run():
        return sorted(map(tuple, paragraphs.format_paragraphs(lines, subheadings=True).collect()))

    few = run()
    # The cleaned lines, and those with their rows; every step behind them was stored, too.
    assert len(stored) == 2 and len(few) > 8
    for module in (paragraphs, reading):
        monkeypatch.setattr(module, "MOST_ITEMS", 0)
    assert run() == few


@pytest.mark.parametrize("rest", [{}, {"deck_count": 3}, {"doc_type": "western"}, {"regions": True}])
def test_pages_are_dealt_out_once_for_their_order(spark, monkeypatch, rest):
    from quire.operators import reading

    lines = _pages(spark)
    if "regions" in rest:
        rest = {"regions": lines.select("doc_id", "page_no").distinct().selectExpr(
            "*", "inline(array(struct(1 AS region_seq, 0 AS x, 300 AS y, 700 AS width, 500 AS height), struct(2 AS region_seq, 0 AS x, 60 AS y, 1300 AS width, 840 AS height)))"
        )}
    stored = _recorded(monkeypatch, grouping, reading)
    few = sorted(map(tuple, reading.reading_order(lines, **rest).collect()))
    assert len(stored) == 2 and few
    monkeypatch.setattr(reading, "MOST_ITEMS", 0)
    assert few == sorted(map(tuple, reading.reading_order(lines, **rest).collect()))


def _headings(spark, n=300):
    rng = random.Random(4)
    words = ["第一章 始め", "第一章 始", "第一節 方法", "Results", "results", "Results of it", "Re", "a", "A", "ab", "結論", "結論。", None, "ẞa", "1.2 実装", "", " "]
    rows = [
        (rng.choice([1, 2, None]), rng.choice([1, 2, None]), i, rng.choice(["heading", "subheading", "removed", "body", None]), rng.choice(words))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id long, page_no int, seq int, kind string, text string")


@pytest.mark.parametrize("step", ["clean_headings", "reclassify_headings", "drop_prefix_fragments"])
def test_headings_are_dealt_out_once(spark, monkeypatch, step):
    from quire.operators import headings as H

    items, fragments = _headings(spark), step == "drop_prefix_fragments"
    stored = _recorded(monkeypatch, H)
    step = (lambda df: H.reclassify_headings(H.clean_headings(df))) if step == "reclassify_headings" else getattr(H, step)

    out = step(items)
    # Once to be cleaned, with one copy of what is kept, and once to be moved.
    assert [_exchanges(d) for d in stored] == ([] if fragments else [1]) and _exchanges(out) <= 1
    few = sorted(map(repr, out.collect()))
    monkeypatch.setattr(H, "PAGE_TEXTS", 0)
    assert few and sorted(map(repr, step(items).collect())) == few


def test_a_heading_line_travels_with_a_number_of_its_key(spark):
    from quire.operators import headings as H

    items = _headings(spark).filter("text IS NOT NULL")
    lines = items.filter("kind = 'body'").selectExpr("doc_id", "page_no", "seq", "0 AS line_index", "text")
    titles = items.filter("kind IN ('heading', 'subheading')")
    out = H.mark_heading_lines(lines, titles)
    keys = re.findall(r"Join.*?\n", out._jdf.queryExecution().sparkPlan().toString())
    # The key of every line, as long as its text, was dealt out beside it.
    assert "_h#" in keys[0] and not re.search(r"_k#\d+\]", keys[0].split("LeftOuter")[0])
    seen = {(r.doc_id, r.page_no, H_key(r.text)) for r in titles.collect() if H_key(r.text) and r.doc_id and r.page_no}
    for r in out.collect():
        assert r.is_heading == ("。" not in r.text and (r.doc_id, r.page_no, H_key(r.text)) in seen), r


def H_key(text):
    return re.sub(r"[\W_]", "", text).lower()


def test_boxes_are_dealt_out_once_for_their_parts(spark):
    from quire.operators.bands import box_clusters

    rng = random.Random(8)
    rows = [(d, 1, i, x := rng.choice([None, *range(0, 900, 30)]), y := rng.randrange(0, 3000, 45), (x or 0) + rng.choice([0, 20, 30, 90]), y + 40) for d in range(3) for i in range(40)]
    boxes = spark.createDataFrame(rows, "doc_id long, page_no int, i int, x1 int, y1 int, x2 int, y2 int")
    out = box_clusters(boxes, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    assert _exchanges(out) == 1
    got = out.collect()
    assert {(r.doc_id, r.i) for r in got} == {(r[0], r[2]) for r in rows if r[3] is not None}
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, {}).setdefault((r._cy, r._cx), []).append((r.x1, r.y1, r.x2, r.y2))
    for own in parts.values():
        assert len(own) > 3
        flat = [(k, b) for k, bs in own.items() for b in bs]
        for k, a in flat:
            for m, b in flat:
                meet = max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
                assert k == m or not meet


def test_lines_of_a_paragraph_meet_in_one_row(spark, monkeypatch):
    from quire.plans import document

    rows = [(1, 1, "body", 1, "始め\r\n第一節 方法\n終わり。\n結論"), (1, 1, "subheading", 9, "第一節 方法"), (1, 2, "body", 1, "結論\n\n a b"), (1, 2, "heading", 2, "a b")]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, kind string, seq int, text string")
    tables = spark.createDataFrame([], "doc_id long, page_no int, table_seq int, table_name string, row_index int, cells array<string>")
    figures = spark.createDataFrame([], "doc_id long, page_no int, seq int, name string")
    stored = _recorded(monkeypatch, document)
    out = document.document_stream(items, tables, figures)
    # The items, the headings of their own and the whole stream; the marked and the counted lines were stored, too.
    assert len(stored) == 3
    assert [(r.page_no, r.kind, r.text) for r in out.orderBy("ord").collect()] == [
        (1, "body", "始め"), (1, "subheading", "第一節 方法"), (1, "body", "終わり。結論"), (2, "body", "結論"), (2, "subheading", "a b"),
    ]

"""Heading tests look at a text once, and build input in one pass over the lines."""

import pytest
from pyspark.sql import functions as F

from quire.catalog.notes import heading_items
from quire.catalog.text import dressed
from quire.functions import headings as H
from quire.functions import text as T


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("test", [H.chapter_key, H.is_subheading, H.is_major_heading, H.is_noise_heading])
def test_text_is_trimmed_a_few_times_only(spark, test):
    df = spark.createDataFrame([("x",)], "text string").select(test("text").alias("out"))
    plan = _plan(df)
    assert plan.count("trim(") + plan.count("regexp_replace(") < 40
    assert plan.count("RLIKE") < 80


@pytest.mark.parametrize("source", [dressed, heading_items])
def test_lines_are_cut_once(spark, sf, source):
    assert _plan(source(spark, sf)).count("regexp_extract_all") == 1


def test_strip_takes_every_unicode_space(spark):
    rows = [chr(c) for c in (*range(0x3001), 0x3000, 0xFEFF) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c}{c}a{c}b{c}",) for c in rows] + [(f"{c}\n",) for c in rows], "text string")
    want = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    assert df.filter(T.strip("text") != want).count() == 0


def test_title_case_gate_keeps_the_verdict(spark):
    rows = {
        "Political and Economic Landscape": True, "The Fall of the House": True, "anti War Movements": True,
        "connected Histories Abroad": True, "a Long Road Home": True, "b": False, "no Title Here": False,
        "After the reorganisation Came War": False, "A Tale of Two’s Company": True, "c'est La Vie Now": False,
        "'s Own Country Again": True, "War throughout": False, "What Is about Others": True,
    }
    df = spark.createDataFrame(list(rows), "string").select("value", H._title_case(F.col("value")).alias("out"))
    got = dict(df.collect())
    assert {k: v for k, v in got.items() if v != rows[k]} == {}


def test_cleaning_writes_each_heading_once(spark, sf, monkeypatch):
    from quire.operators import headings as HD

    written = []
    settle = HD.settle
    monkeypatch.setattr(HD, "settle", lambda df: written.append(df.columns) or settle(df))
    HD.clean_headings(heading_items(spark, sf)).count()
    assert sum("text" in c or "_u" in c for c in written) == 1


def test_crowded_pages_lose_the_same_fragments(spark, monkeypatch):
    from quire.operators import headings as HD

    rows = [(1, p, "heading", i, t) for p in (1, 2) for i, t in enumerate(["Ab", "abc", "b", "Abc d", "c", "cd", "x"][: 7 - 3 * (p - 1)])]
    rows.append((1, 1, "removed", 90, "X"))
    rows.append((1, 2, "removed", 91, "x"))
    items = spark.createDataFrame(rows, "doc_id long, page_no int, kind string, seq int, text string")
    want = {(1, 1, "b"), (1, 1, "Abc d"), (1, 1, "cd"), (1, 2, "b"), (1, 2, "Abc d")}
    for limit in (20_000, 5):
        monkeypatch.setattr(HD, "PAGE_TEXTS", limit)
        got = {tuple(r) for r in HD.clean_headings(items).select("doc_id", "page_no", "text").collect()}
        assert got == want


def test_sync_judges_a_text_once(spark):
    from quire.operators import headings as HD

    rows = [(1, 1, "heading", 1, "（1） 項目"), (1, 1, "body", 2, "[P1] 第2節 方法\nまとめ\n 概要 \n・・・・\n本文。"), (1, 1, "removed", 3, "まとめ"), (1, 1, "heading", 4, None)]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, kind string, seq int, text string")
    out = HD.sync_headings(items, auto_detect=True)
    # Filters on the verdicts moved before them, so each noise test stood there several times.
    assert _plan(out).count("これに対して") <= 2
    assert {(r.kind, r.text) for r in out.collect()} == {
        ("subheading", "（1） 項目"), ("subheading", "第2節 方法"), ("subheading", "概要"), ("removed", "まとめ"),
    }
    plain = HD.sync_headings(items, auto_detect=False)
    assert {(r.kind, r.text) for r in plain.collect()} == {("subheading", "（1） 項目"), ("subheading", "第2節 方法"), ("removed", "まとめ")}

from pyspark.sql import functions as F

from quire.operators import headings as H
from quire.plans import document as D

ITEM = "doc_id long, page_no int, kind string, seq int, text string"


def test_document_stream(spark):
    items = spark.createDataFrame(
        [
            (1, 1, "heading", 1, "第1章 始まり"), (1, 1, "heading", 2, "Only Here"), (1, 2, "heading", 1, "only here"),
            (1, 1, "subheading", 3, "小節"), (1, 1, "body", 4, "第1章 始まり\n本文一\n本文二\n小節\n続き\n【注1】 脚注"),
            (1, 1, "footnote", 5, "[P1-01] 【注2】 別の注"),
        ],
        ITEM,
    )
    rows = spark.createDataFrame(
        [(1, 1, "表1", 1, 1, ["a", "b"])], "doc_id long, page_no int, table_name string, table_seq int, row_index int, cells array<string>"
    )
    figures = spark.createDataFrame([(1, 2, 1, "図1")], "doc_id long, page_no int, seq int, name string")
    out = [(r.kind, r.text) for r in D.document_stream(items, rows, figures).orderBy("ord").collect()]
    assert out == [
        ("heading", "Only Here"), ("subheading", "第1章 始まり"), ("body", "本文一本文二"), ("subheading", "小節"), ("body", "続き"),
        ("table", "◆ 表1"), ("table_row", "a\tb"), ("footnote", "【注釈文2】 別の注"), ("footnote", "【注釈文1】 脚注"), ("figure", "図1"),
    ]


def test_sync_headings(spark):
    items = spark.createDataFrame(
        [
            (1, 1, "heading", 1, "第1章 全体"), (1, 1, "heading", 2, "第1章"), (1, 1, "heading", 3, "（1） 項目"), (1, 1, "subheading", 4, "・・・"),
            (1, 1, "body", 5, "第2節 方法\n本文が続く。\nまとめ\n概要"), (1, 1, "removed", 6, "第2節 方法"), (1, 1, "removed", 7, "まとめ"),
        ],
        ITEM,
    )
    out = {(r.kind, r.text) for r in H.sync_headings(items, auto_detect=True).collect()}
    assert out == {
        ("heading", "第1章 全体"), ("subheading", "（1） 項目"), ("subheading", "第2節 方法"), ("subheading", "概要"), ("removed", "まとめ"),
    }


def test_build_pages(spark):
    line = "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, is_vertical boolean"
    lines = spark.createDataFrame(
        [
            (1, 1, 1, "第1章 題", 10, 10, 100, 20, False), (1, 1, 2, "本文です。", 10, 60, 100, 20, False), (1, 1, 3, "　次の段落", 30, 90, 100, 20, False),
            (1, 1, 4, "3) 注の文", 10, 300, 100, 20, False), (1, 2, 1, "続く注", 10, 300, 100, 20, False), (1, 3, 1, "枠なし", 10, 10, 100, 20, False),
        ],
        line,
    )
    rules = F.expr("CAST(array() AS ARRAY<STRUCT<is_vertical: BOOLEAN, pos: INT, start: INT, `end`: INT>>)")
    region = "doc_id long, page_no int, region_seq int, name string, type string, orientation string, x int, y int, width int, height int"
    boxes = [(1, "見出し", "heading", "auto", 0, 0, 500, 40), (2, "本文", "body", "auto", 0, 40, 500, 200), (3, "注", "footnote", "auto", 0, 250, 500, 200)]
    user = spark.createDataFrame([(1, p, *b) for p in (1, 2) for b in boxes], region).withColumn("rule_lines", rules)
    items, tables = D.build_pages(lines, user, user.limit(0))
    got = {(r.page_no, r.kind, r.text) for r in items.collect()}
    assert got == {
        (1, "heading", "第1章 題"), (1, "body", "本文です。"), (1, "body", "次の段落"), (1, "footnote", "【注釈文3】 3) 注の文"),
        (2, "footnote", "【注釈文3】 続く注"), (3, "body", "枠なし"),
    }
    assert tables.count() == 0

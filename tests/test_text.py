"""Curated lines for the Japanese and Western branches of the text functions."""

import pytest
from pyspark.sql import functions as F

from quire.functions import headings as H
from quire.functions import text as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("第1節　研究概要", True), ("３．結論", True), ("一　研究背景", True), ("（一） 対象者", True), ("① 概要", True),
        ("1.2.3 実装", True), ("【小見出し】", True), ("■ 結論", True), ("はじめに", True), ("Phase 1: Initial Deployment", True),
        ("Secret Services", True), ("Political and Economic Landscape", True), ("Chapter 2.", True), ("A.", False),
        ("　字下げの段落", False), ("文である。", False), ("2014年の出来事", False), ("(Medvedev 2020, 218)", False),
        ("the plan was according to law", False), ("Why Is It So?", False), ("研究における方法", False), ("【注釈文3】 本文", False),
        ("彼は言った」", False), ("", False), ("・・・目次", False), ("したがって", False),
    ],
)
def test_subheading(spark, text, want):
    assert value(spark, H.is_subheading(F.lit(text))) is want


@pytest.mark.parametrize(
    "text,want",
    [
        ("第１２章　終わり", "第12章"), ("第十章", "第10章"), ("第十一章", "第十1章"), ("序章 始まり", "序章"), ("Part IV: War", "chapter_iv"),
        ("2 War in Ukraine", "heading_num_2"), ("（1） 概要", None), ("This is first", "thisisfirst"), ("終わった。", None),
    ],
)
def test_chapter_key(spark, text, want):
    assert value(spark, H.chapter_key(F.lit(text))) == want


def test_runaway_modes(spark):
    def run(text, mode):
        return value(spark, T.clean_runaway(F.lit(text), mode))

    assert run("abc 00000 tail", "app") == "abc"
    assert run("go the the the the end", "app") == "go"
    assert run("(1995al. and 2005l.", "app") == "(1995a]. and 2005]."
    assert run("サササササ", "recognizer") == "サ" and run("abababab", "recognizer") == "ab"
    assert run("12 00000", "recognizer") == "12" and run("aaaab", "region") == "aaaab" and run("aaaaab", "region") == ""


def test_joins_and_wrapping(spark):
    assert value(spark, T.join_western(F.array(*map(F.lit, ["sustain-", "able", " ", "growth"])))) == "sustainable growth"
    assert value(spark, T.join_spaced_alnum(F.array(*map(F.lit, ["表A", "1号", "B", "2"])))) == "表A 1号B 2"
    assert value(spark, T.wrap_paragraph(F.lit("あいう。えおかきく"), 3)) == "あいう。\nえおか\nきく"


def test_spaces_and_prefix(spark):
    assert value(spark, T.strip(F.lit("　 a　"))) == "a"
    assert value(spark, T.strip_page_prefix(F.lit(" [P1] [p2-03]　x"))) == "x"
    assert value(spark, T.ends_sentence(F.lit("終わった。」［")) ) is False
    assert value(spark, T.ends_sentence(F.lit('He left."[12]'))) is True

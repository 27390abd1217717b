"""Work at page breaks and on duplicate lines stays with what can matter."""

from pyspark.sql import functions as F

from quire.operators import detections, page_breaks


def test_only_pieces_that_may_make_a_title_are_joined(spark):
    pieces = [("概要",), ("x" * 60,), ("1.2",), ("b",)]
    df = spark.createDataFrame([([("z" * 30,)] * 50 + pieces, "c")], "before array<struct<t:string>>, text string")
    got = df.select(page_breaks._joined_titles(F.col("text"), F.col("before")).alias("o")).first()["o"]
    # 'b\nc', '1.2\nb\nc', with the 60 characters, with the title word, and one more of 30 characters.
    assert len(got) == 5
    df = spark.createDataFrame([([("a",), (None,), ("Results",)], "x"), ([], "x")], "before array<struct<t:string>>, text string")
    rows = [r["o"] for r in df.select(page_breaks._joined_titles(F.col("text"), F.col("before")).alias("o")).collect()]
    assert [len(r) for r in rows] == [1, 0]


def test_texts_are_not_stored_while_duplicates_are_sought(spark, monkeypatch):
    written = []
    settle = detections.settle
    monkeypatch.setattr(detections, "settle", lambda df: written.append(df.columns) or settle(df))
    rows = [(1, 1, i, t, 10 + i, 10, 100, 20, c, False) for i, (t, c) in enumerate([("abcdefgh", 0.5), ("ab", 0.9)])]
    rows.append((1, 1, 7, "far", 900, 900, 50, 20, None, False))
    lines = spark.createDataFrame(
        rows, "doc_id long, page_no int, line_id int, text string, x int, y int, width int, height int, confidence double, is_vertical boolean"
    )
    got = {r["line_id"]: (r["text"], r["confidence"]) for r in detections.resolve_duplicate_lines(lines).collect()}
    assert got == {0: ("abcdefgh", 0.9), 7: ("far", None)}
    assert written and not any("text" in c for c in written)

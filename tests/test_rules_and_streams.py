import json
import os

from quire.operators import rules as R
from quire.streaming import ingest as I

SCHEMA = "original string, replacement string, is_regex boolean, enabled boolean, ord int, builtin boolean"


def test_rules_in_blocks_equal_one_block(spark):
    rows = [(f"k{i}", f"v{i % 7}", False, i % 5 != 0, i, i % 2 == 0) for i in range(40)]
    rows += [(r"v(\d)", r"<\1$>", True, True, 50, True), ("((", "x", True, True, 51, False), ("<", "k3", False, True, 60, False)]
    rules = spark.createDataFrame(rows, SCHEMA)
    df = spark.createDataFrame([(i, f"a k{i} k{i + 1}x <") for i in range(40)], "id int, text string")
    for order in ("engine", "insertion"):
        few = {tuple(r) for r in R.apply_rules(df, rules, "text", order).collect()}
        many = {tuple(r) for r in R.apply_rules(df, rules, "text", order, block_chars=40).collect()}
        assert few == many


def test_stream_takes_new_rules_and_repeats_safely(spark, tmp_path):
    schema = "doc_id long, page_no int, arrived long, text string"
    inbox, target, rules = (str(tmp_path / n) for n in ("inbox", "target", "rules.json"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)

    def run():
        stream = spark.readStream.schema(schema).json(inbox)
        I.ingest_pages(stream, target, str(tmp_path / "offsets"), ["arrived"], rules_path=rules).awaitTermination()

    with open(rules, "w") as f:
        json.dump({"exact_replacements": {"cat": "dog"}}, f)
    arrive([(1, 1, 1, "cat"), (1, 2, 1, "cat"), (1, 1, 2, "cat 2")])
    run()
    with open(rules, "w") as f:
        json.dump({"exact_replacements": {"cat": "fox"}}, f)
    arrive([(1, 1, 3, "cat 3"), (1, 2, 0, "late cat")])
    run()
    got = {(r.page_no, r.text) for r in I.read_pages(spark, target, ["arrived"]).collect()}
    assert got == {(1, "fox 3"), (2, "dog")}
    I.upsert_pages(spark.createDataFrame([(1, 1, 3, "fox 3")], schema), target, ["arrived"])
    assert {(r.page_no, r.text) for r in I.read_pages(spark, target, ["arrived"]).collect()} == got


def test_progress_counts_pages_once_and_tells_changes_only(spark, tmp_path):
    inbox, out, offsets = (str(tmp_path / n) for n in ("inbox", "out", "offsets"))
    schema = "doc_id long, page_no int"
    told = []
    for rows in ([(1, 1), (1, 1), (1, 2), (1, 21), (None, 1), (2, None)], [(1, 2), (1, 3), (2, 6)], [(1, 1), (2, 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)
        frame = I.batch_progress(spark.readStream.schema(schema).json(inbox))
        own = []
        I.drain(frame, lambda df, _: own.extend(map(tuple, df.collect())), offsets)
        told.append(sorted(own))
    assert told == [[(1, 1, 2), (1, 2, 1)], [(1, 1, 3), (2, 1, 1)], []]


def test_progress_forgets_idle_batches(spark, tmp_path):
    inbox, offsets = str(tmp_path / "inbox"), str(tmp_path / "offsets")
    schema = "doc_id long, page_no int, at timestamp"
    told = []
    # The state of document 1 goes while document 2 moves the time on; a late page is left out.
    for row in ((1, 1, "2024-01-01"), (2, 1, "2024-02-01"), (2, 2, "2024-02-02"), (1, 2, "2024-01-02"), (1, 3, "2024-03-01")):
        spark.createDataFrame([row], "doc_id long, page_no int, at string").coalesce(1).write.mode("append").json(inbox)
        frame = I.batch_progress(spark.readStream.schema(schema).json(inbox), time_col="at")
        I.drain(frame, lambda df, _: told.extend(map(tuple, df.collect())), offsets)
    assert told == [(1, 1, 1), (2, 1, 1), (2, 1, 2), (1, 1, 1)]


def test_line_xml(spark, tmp_path):
    from quire.sources import pages as P

    folder = tmp_path / "12" / "page_0003"
    os.makedirs(folder)
    (folder / "page.xml").write_text(
        '<OCRDATASET><PAGE><LINE TYPE="大見出し" STRING="題"/><LINE TYPE="本文" STRING="文"/><LINE TYPE="頭注" STRING="注"/>'
        '<FIGURE X="1" Y="2" WIDTH="30" HEIGHT="40"/></PAGE></OCRDATASET>', encoding="utf-8"
    )
    rows = P.read_line_xml(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [(r.doc_id, r.page_no, r.kind, r.text) for r in rows] == [(12, 3, "heading", "題"), (12, 3, "body", "文"), (12, 3, "footnote", "注")]
    assert P.read_figure_xml(spark, str(tmp_path)).select("x", "width").first() == (1, 30)


def test_page_files(spark, tmp_path):
    from quire.sources import pages as P

    folder = tmp_path / "7" / "page_0002"
    os.makedirs(folder)
    item = {"boundingBox": [[0, 0], [0, 20], [100, 0], [100, 20]], "text": "hello", "confidence": 0.9, "isVertical": "false"}
    (folder / "page.json").write_text(json.dumps({"contents": [[item, {"text": "no box"}]]}))
    (folder / "auto_layout.json").write_text(json.dumps({"regions": []}))
    (folder / "figure_01.png").write_bytes(b"x" * 2048)
    rows = P.read_ocr_lines(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.page_no, r.text, r.width) for r in rows] == [(7, 2, "hello", 100)]
    fig = P.read_figures(spark, str(tmp_path)).select("doc_id", "page_no", "size_kb", "over_limit").first()
    assert fig == (7, 2, 2.0, False)
    assert P.read_display_lines(spark, str(tmp_path)).count() == 2


def test_writers_round_trip(spark, tmp_path):
    from quire.operators import grid as G
    from quire.sources import pages as P

    rows = spark.createDataFrame(
        [(1, 1, "t", 2, ["c", "d,e"]), (1, 1, "t", 1, ["a", None])],
        "doc_id long, page_no int, table_name string, row_index int, cells array<string>",
    )
    out = str(tmp_path / "csv")
    P.write_tables(G.export_tables(rows, fmt="csv"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["a,", 'c,"d,e"']

    rules = spark.createDataFrame(
        [("a", "x", False, "", 0), ("a", "y", False, "", 1), ("b+", "z", True, "why", 2), ("", "q", False, "", 3)],
        "original string, replacement string, is_regex boolean, description string, ord int",
    )
    P.write_rules(rules, str(tmp_path / "rules"))
    back = {(r.original, r.replacement, r.is_regex, r.description) for r in P.read_rules(spark, str(tmp_path / "rules" / "*.txt")).collect()}
    assert back == {("a", "y", False, ""), ("b+", "z", True, "why")}

    paras = spark.createDataFrame([(1, 1, 2, "two"), (1, 1, 1, "one")], "doc_id long, page_no int, para_no int, text string")
    P.write_reading_order(paras, str(tmp_path / "order"))
    assert spark.read.json(str(tmp_path / "order")).first().text == "one\n\ntwo"

    folder = tmp_path / "layouts" / "5"
    os.makedirs(folder)
    (folder / "page_layout.json").write_text(
        json.dumps({"template": {"name": "t", "regions": []}, "pages": {"1": {"use_template": True, "regions": [{"x": 3, "type": "body"}]}, "b": {"regions": []}}})
    )
    assert [(r.doc_id, r.page_no, r.region_seq, r.x) for r in P.read_layout_template(spark, str(tmp_path / "layouts")).collect()] == [(5, 1, 1, 3)]

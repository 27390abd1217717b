"""Stored tables, rule order and boxes without a confidence."""

import pytest

from quire.operators.detections import merge_detections
from quire.operators.staging import stored_table
from quire.sources import page_store
from quire.sources.pages import parse_rules, read_stored_pages, write_page_data
from quire.streaming.ingest import read_pages, upsert_pages


def test_a_failing_read_leaves_stored_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert stored_table(spark, path) is None
    items = spark.createDataFrame([("a", i, "body", 0, f"t{i}") for i in range(40)], "doc_id string, page_no int, kind string, seq int, text string")
    write_page_data(items, path)
    files = sorted(tmp_path.rglob("*.parquet"))
    for f in files:
        f.write_bytes(b"damaged")
    # A write reads nothing, so it goes through; a read tells.
    write_page_data(items.limit(1), path)
    with pytest.raises(Exception):
        read_stored_pages(spark, path).collect()
    assert all(f.exists() and f.read_bytes() == b"damaged" for f in files)


ITEM = "doc_id long, page_no int, kind string, seq int, text string"


def test_a_write_adds_its_own_pages_only(spark, tmp_path):
    path = str(tmp_path / "pages")
    page = lambda n, text: [(1, n, "body", i, f"{text} {n} {i}") for i in range(3)]
    write_page_data(spark.createDataFrame([r for n in range(500) for r in page(n, "old")], ITEM), path)
    before = set(tmp_path.rglob("*.parquet"))
    write_page_data(spark.createDataFrame([r for n in range(10) for r in page(n, "new")[:2]], ITEM), path)
    added = [str(f) for f in set(tmp_path.rglob("*.parquet")) - before]
    assert before <= set(tmp_path.rglob("*.parquet")) and spark.read.parquet(*added).count() == 20
    want = {r for n in range(500) for r in (page(n, "new")[:2] if n < 10 else page(n, "old"))}
    assert {tuple(r) for r in read_stored_pages(spark, path).collect()} == want
    page_store.compact(spark, path)
    page_store.drop_old(spark, path)
    assert {tuple(r) for r in read_stored_pages(spark, path).collect()} == want
    assert page_store.versions(spark, path).count() == len(want) and page_store.generation(spark, path) == 1
    write_page_data(spark.createDataFrame(page(3, "third"), ITEM), path)
    assert {r.text for r in read_stored_pages(spark, path).where("page_no = 3").collect()} == {r[4] for r in page(3, "third")}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "pages")
    arrivals = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, "b")], "doc_id long, page_no int, at long, text string")
    for _ in range(2):
        upsert_pages(arrivals, path, ["at"], "stream", 0)
    upsert_pages(arrivals.selectExpr("doc_id", "page_no", "at - page_no AS at", "'late' AS text"), path, ["at"], "stream", 1)
    assert page_store.versions(spark, path).count() == 4
    assert {r.text for r in read_pages(spark, path, ["at"]).collect()} == {"a", "b"}
    page_store.compact(spark, path, ["at"])
    assert {r.text for r in read_pages(spark, path, ["at"]).collect()} == {"a", "b"}
    # A generation that was never finished does not count.
    (tmp_path / "pages" / "gen=2").mkdir()
    assert page_store.generation(spark, path) == 1
    with pytest.raises(FileNotFoundError):
        read_pages(spark, str(tmp_path / "none"), ["at"])


def test_rules_keep_file_order(spark):
    raw = spark.createDataFrame([('{"exact_replacements": {"zz": "1", "aa": "2", "mm": "3"}}',), ('{"y": "1", "_comment": "c", "b": "2"}',)], "raw string")
    rows = parse_rules(raw).collect()
    assert [r.original for r in sorted(rows[:3], key=lambda r: r.ord)] == ["zz", "aa", "mm"]
    assert [r.original for r in sorted(rows[3:], key=lambda r: r.ord)] == ["y", "b"]


def test_a_box_without_confidence_does_not_win(spark):
    boxes = spark.createDataFrame(
        [(7, 1, 1, 0, 0, 100, 40, None, 1), (7, 1, 2, 1, 0, 100, 40, 0.9, 1)],
        "doc_id long, page_no int, det_id int, x1 int, y1 int, x2 int, y2 int, confidence double, class_index int",
    )
    (left,) = merge_detections(boxes).collect()
    assert left.det_id == 2 and left.confidence == 0.9

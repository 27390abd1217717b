"""Registered queries against their SQL.  QUIRE_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SOME = [
    "ocr_lines", "classify_blocks", "dedupe_lines", "assign_regions", "assign_lines_to_cells", "body_regions",
    "cluster_positions", "drop_contained", "merge_detections", "reading_order_decks", "format_paragraphs", "is_subheading",
    "renumber_notes_by_chapter", "clean_headings", "extract_tables", "concat_tables_vertical", "proofread_candidates",
    "search_pages", "merge_cross_page", "batch_dashboard", "read_ocr_lines", "ingest_pages",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("QUIRE_ALL") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = canonical(entry.queries()[name](spark, sf).toPandas())
    want = canonical(duck.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "page_no", "para_no", "text"]

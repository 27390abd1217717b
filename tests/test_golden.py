"""A scanned page with known results: 19 blocks, their classes and their reading order."""

from quire.operators import lines as L
from quire.operators import reading as O

# id, text, x1, y1, x2, y2; long texts stand in for lines of that length.
BLOCKS = [
    (1, "7", 2, 40, 12, 50), (2, "x" * 7, 33, 35, 110, 48), (3, "x" * 45, 11, 61, 40, 670),
    (4, "x" * 45, 35, 61, 65, 669), (5, "x" * 45, 61, 61, 88, 665), (6, "x" * 46, 85, 61, 112, 675),
    (7, "x" * 44, 110, 63, 134, 669), (8, "x" * 45, 132, 60, 157, 668), (9, "x" * 43, 156, 60, 181, 672),
    (10, "x" * 45, 180, 58, 206, 668), (11, "x" * 45, 203, 57, 230, 667), (12, "x" * 44, 227, 68, 253, 668),
    (13, "x" * 7, 278, 81, 296, 174), (14, "x" * 47, 291, 79, 321, 668), (15, "x" * 48, 313, 79, 342, 668),
    (16, "x" * 48, 335, 78, 366, 665), (17, "x" * 48, 355, 77, 390, 666), (18, "x" * 48, 377, 77, 414, 666),
    (19, "x" * 47, 401, 76, 430, 665),
]
ORDER = [19, 18, 17, 16, 15, 13, 12, 14, 11, 10, 8, 9, 7, 5, 4, 3, 6, 1, 2]


def page(spark):
    return spark.createDataFrame(
        [(1, 1, *b) for b in BLOCKS], "doc_id long, page_no int, id int, text string, x1 int, y1 int, x2 int, y2 int"
    )


def test_page_size_and_classes(spark):
    assert L.page_sizes(page(spark)).first()[2:] == (430, 675)
    got = {r.id: r.category for r in L.classify_blocks(page(spark)).collect()}
    want = {b[0]: "footer_candidate" for b in BLOCKS}
    want |= {1: "page_number", 2: "header_candidate", 13: "body_vertical_candidate"}
    assert got == want


def test_reading_order(spark):
    rows = O.simple_reading_order(L.with_orientation(page(spark))).orderBy("position").collect()
    assert [r.id for r in rows] == ORDER


def test_columns_from_the_right(spark):
    lefts = [38, 147, 257, 373, 489, 599, 705, 821, 934, 1047, 1160, 1273, 1382, 1502, 1615, 1731, 1844, 1957]
    df = spark.createDataFrame(
        [(1, 1, i + 1, x) for i, x in enumerate(lefts)], "doc_id long, page_no int, id int, x int"
    )
    rows = O.columns_right_to_left(df).orderBy("column_no").collect()
    assert [r.x for r in rows] == sorted(lefts, reverse=True)

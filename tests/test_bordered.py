"""Rectangles between rules, held against every pair of rules and every rule between them."""

import random

import pytest

from quire.operators.regions import bordered_regions

SEGMENT = "doc_id long, page_no int, orient string, pos int, start int, end int, ord int"
WIDTH = 600


def frames(spark, segments):
    pages = sorted({s[:2] for s in segments})
    return (
        spark.createDataFrame(segments, SEGMENT),
        spark.createDataFrame([(*p, WIDTH, 800) for p in pages], "doc_id long, page_no int, width int, height int"),
    )


def every_pair(segments, open_tables):
    found = []
    for page in {s[:2] for s in segments}:
        own = [s[2:] for s in segments if s[:2] == page]
        first = {}
        for orient, pos, a, b, n in own:
            if orient == "h":
                first[pos, a, b] = min(n, first.get((pos, a, b), n))
        h = [(*k, n) for k, n in first.items()]
        v = {s[1:4] for s in own if s[0] == "v"}
        for y1, a1, b1, n1 in h:
            for y2, a2, b2, n2 in h:
                left, right = max(a1, a2), min(b1, b2)
                if y2 - y1 < 30 or n1 >= n2 or right <= left:
                    continue
                xs = [x for x, a, b in v if left <= x <= right and a <= y1 + 5 and b >= y2 - 5]
                if xs and min(xs) < max(xs):
                    x1 = left if min(xs) - left > 40 else min(xs)
                    x2 = right if right - max(xs) > 40 else max(xs)
                elif open_tables and right - left >= max(30, 0.2 * WIDTH) and (
                    any(left - 10 <= x <= right + 10 and a <= y2 + 15 and b >= y1 - 15 for x, a, b in v)
                    or any(y1 + 5 < y < y2 - 5 and max(a, left) < min(b, right) for y, a, b, _ in h)
                ):
                    x1, x2 = left, right
                else:
                    continue
                if x2 - x1 >= 30:
                    found.append((*page, x1, y1, x2 - x1, y2 - y1))
    return sorted(found)


def rows(df):
    return sorted((r.doc_id, r.page_no, r.x, r.y, r.width, r.height) for r in df.collect())


@pytest.mark.parametrize("open_tables", [True, False])
def test_random_pages(spark, open_tables):
    rnd, segments = random.Random(5), []
    for page in range(1, 13):
        for n in range(36):
            # Positions on a coarse raster, so that ends touch, tie and repeat.
            flat = rnd.random() < (0.2 + 0.06 * page)
            a, b = sorted((rnd.randrange(0, 120) * 5, rnd.randrange(0, 120) * 5))
            segments.append((1, page, "h" if flat else "v", rnd.randrange(0, 60) * 10, a, b, n))
    segments += [(*s[:6], s[6] + 100) for s in segments if s[1] % 3 == 0]
    want = every_pair(segments, open_tables)
    assert len(want) > 30
    found = bordered_regions(*frames(spark, segments), open_tables=open_tables)
    assert rows(found) == want
    numbers = {}
    for r in found.collect():
        numbers.setdefault(r.page_no, []).append(r.region_seq)
    assert all(sorted(own) == list(range(1, len(own) + 1)) for own in numbers.values())


def test_a_page_of_ten_thousand_rules(spark):
    """5,000 small frames on one page: only their own rules make pairs."""
    segments, n = [], 0
    for i in range(5000):
        x, y = i % 50 * 60, i // 50 * 60
        for s in (("h", y, x, x + 40), ("v", x, y, y + 40), ("v", x + 40, y, y + 40), ("h", y + 40, x, x + 40)):
            segments.append((1, 1, *s, n))
            n += 1
    found = rows(bordered_regions(*frames(spark, segments)))
    assert found == sorted((1, 1, i % 50 * 60, i // 50 * 60, 40, 40) for i in range(5000))


def test_nothing_to_find(spark):
    assert rows(bordered_regions(*frames(spark, [(1, 1, "h", 10, 0, None, 1), (1, 1, "h", None, 0, 500, 2)]))) == []
    empty = spark.createDataFrame([], SEGMENT), spark.createDataFrame([], "doc_id long, page_no int, width int, height int")
    assert rows(bordered_regions(*empty)) == []

"""Prefixes of other texts are found across the ranges that a crowded page is cut into."""

import random

import pytest

from quire.operators.headings import drop_prefix_fragments

SCHEMA = "doc_id long, page_no int, kind string, seq int, text string"


def kept(spark, rows):
    return sorted(tuple(r) for r in drop_prefix_fragments(spark.createDataFrame(rows, SCHEMA)).collect())


def plain(rows):
    texts = {}
    for d, p, k, _, t in rows:
        texts.setdefault((d, p, k), set()).add(t.lower())
    return sorted(
        r for r in rows
        if not any(t != r[4].lower() and t.startswith(r[4].lower()) for t in texts[r[:3]])
    )


@pytest.mark.parametrize("parts", [3, 64])
def test_random_prefixes(spark, parts):
    rnd = random.Random(parts)
    rows = [
        (1, n % 3 and 1 or n, "heading" if n % 5 else "subheading", n, "".join(rnd.choice("aAbß章𠮷") for _ in range(rnd.randrange(7))))
        for n in range(400)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = kept(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows) and len(got) < len(rows)


def test_one_page_of_many_headings(spark):
    """A hundred thousand headings that begin alike; each tenth is the start of the next."""
    rows = [(1, 1, "heading", n, f"Chapter {n // 10:06d}" + ("" if n % 10 == 0 else f" part {n % 10}")) for n in range(100_000)]
    assert kept(spark, rows) == sorted(r for r in rows if r[3] % 10)


def test_null_texts_and_no_rows(spark):
    rows = [(1, 1, "heading", 1, "ab"), (1, 1, "heading", 2, "abc")]
    out = drop_prefix_fragments(spark.createDataFrame([*rows, (1, 1, "heading", 3, None)], SCHEMA))
    assert {r.seq for r in out.collect()} == {2, 3}
    assert kept(spark, []) == []

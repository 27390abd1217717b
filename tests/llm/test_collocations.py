"""Collocations against a count of every phrase in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from quire.llm.collocations import DoubleArray, mine, split_words


def brute(rows, minimum, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    frequent = {p: c for p, c in counts.items() if c >= minimum and len(p) > 2}
    out = []
    for (lang, *words), a in frequent.items():
        if any(
            c >= a and len(p) - 1 > len(words) and any(list(p[i : i + len(words)]) == words for i in range(1, len(p)))
            for p, c in frequent.items() if p[0] == lang
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, *words[:k]], counts[lang, *words[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), l, r, totals[lang]))
    out.sort()
    ranks = Counter()
    result = []
    for lang, score, a, phrase, l, r, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, l, r, n, -score))
    return result


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = np.array(["The", "the", "of", "Éa", "éa", "x\x00y", "naïve", "日本", "a-b", "(c)", "d", "e"])
    out = []
    for i in range(120):
        own = rng.choice(words, size=int(rng.integers(0, 60)), p=np.arange(12, 0, -1) / 78)
        glue = rng.choice([" ", "  ", "\t", ", ", ".\n", "\x0b", "\x1c", " "], size=len(own), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.03, 0.03, 0.04])
        out.append((["en", "fr", None][i % 3], "".join(a + b for a, b in zip(own, glue)) + " over and over again ; " * (i % 4)))
    return out + [("en", None), (None, None), ("de", ""), ("de", " ?! "), ("fr", "z z z z z z z z z z z z"), ("fr", "z z z z z z z z z z z z")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "clash") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, rank int, shard string")


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_equals_plain_count(spark, rows, most):
    """With room for three edges only, all levels are counted by groups."""
    got = mine(frame(spark, rows).repartition(3), minimum=6, top=40, most=most).collect()
    want = brute(rows, 6, 40)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


def test_empty_and_rare(spark, rows):
    none = mine(frame(spark, []))
    assert none.count() == 0 and none.columns[:3] == ["lang", "rank", "phrase"]
    assert mine(frame(spark, rows), minimum=10**6).count() == 0
    # Frequent words, but no frequent phrase.
    assert mine(frame(spark, [("en", "a. " * 50)]), minimum=10).count() == 0


def test_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    big = "decimal(38,0)"
    a, n, l, r = 987_654_321_012, 9_876_543_210_123, 999_999_999_989, 999_999_999_961
    row = spark.range(1).select(
        F.call_function("div", F.lit(1000).cast(big) * F.lit(a).cast(big) * F.lit(n).cast(big), F.lit(l).cast(big) * F.lit(r).cast(big))
    ).first()
    assert row[0] == 1000 * a * n // (l * r)


def test_double_array_holds_its_edges_only():
    rng = np.random.default_rng(12)
    pairs = np.unique(rng.integers(0, 400, (3000, 2)) * [1, 3], axis=0)
    pairs = np.concatenate([pairs, [[400, s] for s in range(0, 900)]])
    trie = DoubleArray(pairs[:, 0], pairs[:, 1], 402)
    number = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    grid = np.stack(np.meshgrid(np.arange(402), np.arange(-1, 1300)), axis=-1).reshape(-1, 2)
    got = trie.step(grid[:, 0], grid[:, 1])
    assert got.tolist() == [number.get(tuple(p), -1) for p in grid.tolist()]


def test_words_and_pieces():
    assert split_words("A b\tÀ, c\x1cd\x0b!e".encode()) == [b"a", b"b", "À".encode(), b"\xff", b"c\x1cd", b"\xff", b"\xff", b"e"]

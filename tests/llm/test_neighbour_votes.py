"""Voting: histograms against a plain count, votes against a loop, held-out accuracy."""

import zlib

import numpy as np
import pytest

from quire.llm import neighbour_votes as nv

CLEAN = ["The house stands by the river, and the garden is large.", "She was reading about the old bridge when it rained."]
BAD = ["BUY!! NOW!! BEST!! PRICE!!", "spam spam spam spam spam spam", "a### of%%% the&&& we$$$ in***"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join(rng.choice(CLEAN if good else BAD, size=6)) if good else " ".join([str(rng.choice(BAD))] * 6)
        rows.append((i, text + f" {i}", i, "clash"))
        labels.append((i, int(good), 0))
    rows += [(900, None, 1, None), (901, "", 1, "x"), (902, " \n\t\0", 1, "x"), (None, CLEAN[0], 1, "x"), (3, CLEAN[0], 1, "x")]
    labels += [(None, 1, None), (7, None, 0), (5000, 0, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, score int, _label string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    model = nv.fit(docs.where(~docs.doc_id.isin(held)), labels.where(~labels.doc_id.isin(held)))
    got = nv.with_votes(docs, model)
    assert got.columns == ["doc_id", "text", "_label", "score", "nearest"]
    out = got.toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and not out.score.isna().any()
    own = out[out.doc_id.isin(held) & (out.nearest > 0)].drop_duplicates("doc_id")
    assert ((own.score >= 0.3) == (own.doc_id % 4 != 0)).mean() > 0.97
    blank = out[out.doc_id.isin([900, 901, 902])]
    assert np.allclose(blank.score, model.prior) and (blank.nearest == 0).all()


def test_given_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
    model = nv.fit(docs.where(f"NOT {held}"), labels.where(f"NOT {held}"))
    out = nv.with_votes(docs, model).join(labels, "doc_id").where(held).toPandas()
    assert ((out.score >= 0.3) == (out.quality == 1)).mean() >= 0.95


def test_few_or_no_labels(spark, tables, hard, empty):
    docs, labels = tables
    none = nv.fit(docs, labels.limit(0))
    assert nv.with_votes(docs, none).where("score <> 0.5 OR nearest <> 0").count() == 0
    ones = nv.fit(docs, labels.where("quality = 1"))
    assert nv.with_votes(docs, ones).where("abs(score - 1) > 1e-9").count() == 0
    assert nv.with_votes(empty, ones).count() == 0
    small = nv.fit(docs, labels, most_docs=5)
    assert len(small.labels) == 10 and np.isclose((small.balance / 2).sum(), 1)
    got = nv.with_votes(hard, small).toPandas()
    assert len(got) == hard.count() and got.score.between(0, 1).all()
    assert nv.fit(empty, labels).prior == 0.5


def test_votes_follow_the_loop(tables):
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, asked = unit(rng.normal(size=(40, 6))), unit(rng.normal(size=(9, 6)))
    labels = rng.integers(0, 2, 40).astype(float)
    model = nv.Model(None, None, known.astype(np.float32), labels, np.array([0.4, 1.6]), 7, 0.5)
    score, nearest = nv.vote(model, asked)
    for i, v in enumerate(asked):
        cosines = known @ v
        best = np.argsort(-cosines)[:7]
        votes = [((1 - cosines[j] + 0.02) ** -2) * (1.6 if labels[j] else 0.4) for j in best]
        assert np.isclose(score[i], sum(w for w, j in zip(votes, best) if labels[j]) / sum(votes), atol=1e-4)
        assert np.isclose(nearest[i], cosines.max(), atol=1e-5)


def test_histogram_counts_whole_texts(monkeypatch):
    texts = [b"the The thee, the the", b"", None, b"b b c b  c b\nc c", "日本 日本".encode()]
    counts = nv.histograms(texts)
    assert counts[:, -1].tolist() == [5, 0, 0, 8, 2]
    # Words equal to the one three, two and one before them.
    assert counts[0, -4:-1].tolist() == [2, 1, 2] and counts[4, -2] == 1
    assert counts[:, : nv.WORD_BUCKETS].sum(axis=1).tolist() == [5, 0, 0, 8, 2]
    long = [b" ".join(b"word%d" % (i % 70) for i in range(3000))]
    whole = nv.histograms(long)
    monkeypatch.setattr(nv, "PART_BYTES", 500)
    assert np.array_equal(nv.histograms(long)[:, : nv.WORD_BUCKETS], whole[:, : nv.WORD_BUCKETS])

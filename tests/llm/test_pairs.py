"""N-gram join, repeated strings, neighbours, components and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import neighbours, ngram_join, suffixes
from quire.llm.components import components
from quire.llm.queries import QUERIES


def union(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union(260, pairs)
    assert all(root == want[node] for node, root in got.items()) and len(got) == len({x for a, b in pairs if a != b for x in (a, b)})


def grams(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def by_brute_force(texts):
    sets = [grams(t) for t in texts]
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    return sets, union(len(texts), pairs)


@pytest.fixture(scope="module")
def crowd():
    """A base with many edited copies, chains of edits, exact copies and a shared passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage = text(150), text(30)
    out = [text(rng.randrange(1, 200)) + (passage if i % 3 else []) for i in range(60)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(150)] = rng.choice(words)
        out.append(copy)
    chain = text(80)
    for _ in range(20):
        chain = chain[: rng.randrange(60, 80)] + text(3)
        out.append(list(chain))
    out += [list(base)] * 30
    rng.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("most,block", [(24, 512), (3, 16)])
def test_join_equals_brute_force(spark, crowd, most, block, monkeypatch):
    monkeypatch.setattr(ngram_join._crossing, "__defaults__", (block,))
    docs = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs, most=most, load=500).collect()}
    sets, want = by_brute_force(crowd)
    assert [got[i].n_shingles for i in range(len(crowd))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(crowd))] == want
    kept = ngram_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_join_hard_rows(hard, empty):
    got = ngram_join.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    component = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert component[1] == component[2] == component[3] == 1 and component[9] == component[10] == 9
    assert component[4] == 4 and component[5] == 5
    assert sorted((r.component_id is None, r.n_shingles > 0) for r in got if r.doc_id is None) == [(False, True), (True, False)]
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    left = ngram_join.one_of_each(hard)
    assert left.columns == hard.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 5, 7, 8, 9, 11, 12, 13]


def without_repeats(rows):
    """Bytes left of each row by a direct search."""
    out = []
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 49):
            if any((j is not None and (i is None or j < i)) and text[s : s + 50] in other for j, other in rows):
                gone[s : s + 50] = True
        out.append((i, len(text), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(text, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_direct_search(spark):
    rng = random.Random(7)
    alphabet = "abé "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared, rows = [text(n) for n in (30, 49, 50, 60, 120)], []
    for i in range(40):
        rows.append((i // 2 if i % 7 else None, text(rng.randrange(60)) + rng.choice(shared) + text(rng.randrange(60)) + rng.choice(shared)))
    rows += [(50, "a" * 300), (51, "a" * 49), (52, "a" * 70 + "b"), (53, rows[0][1]), (53, rows[0][1]), (54, None), (55, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(docs, load=200).collect()), key=str)
    assert got == without_repeats([(i, (t or "").encode()) for i, t in rows])


def test_repeats_hard_rows(hard, empty):
    got = suffixes.remove_repeats(hard).collect()
    assert len(got) == hard.count() and suffixes.remove_repeats(empty).count() == 0
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in got}
    assert gone[2][0] == gone[2][1] > 0 and gone[1][1] == 0 and gone[12] == (5000, 0)


def test_suffix_order_by_cover():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.tile(rng.integers(97, 99, 62), 30).astype(np.uint8), np.zeros(120, np.uint8)])
    places = np.arange(5, 1700, suffixes.PERIOD)
    order = suffixes.sort_suffixes(text, places, np.zeros(len(places), np.int64))
    cut = [text[p : p + 50].tobytes() for p in places[order]]
    assert cut == sorted(cut)
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 16))
    data = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 16))
    data[100:140] = data[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), rows[20], (2080, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0, block=400, query_block=30).toPandas()
    hits = total = 0
    for q in range(0, 1500, 20):
        scores = (data * data[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, scores[own.vec_id])
        assert (np.diff(own.score) <= 0).all() and own.vec_id.is_unique
        hits += len(set(best) & set(own.vec_id))
        total += 20
    assert hits / total >= 0.9
    assert set(got.query_id) == set(range(0, 1500, 20))
    for _, own in got.sort_values("rank").groupby("query_id"):
        ids, scores = own.vec_id.to_numpy(), own.score.to_numpy()
        assert (ids[1:] > ids[:-1])[scores[1:] == scores[:-1]].all()
    assert neighbours.search(vectors.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark, sf, hard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0 and docs.agg(F.count_distinct("sequence_id")).first()[0] > 0
    rows = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, sf).columns == rows.columns


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_take_clashing_columns(spark, sf, hard):
    """Columns with the names that operators use themselves come through as they are."""
    names = ["hex", "assign", "access", "markov", "secret_spans", "_node", "_no", "_rest", "_runs"]
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(n).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() > 5
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(names)}
        assert stage(spark, docs.limit(0), sf).count() == 0

"""Whitening against a dense eigendecomposition in plain numpy."""

import numpy as np
import pytest

from quire.llm.whitening import deviations, orthogonal_factor, solve_rows, triangle, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash") for i, v in enumerate(vectors)]


def brute(vectors):
    x = np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values[order] / values.sum()


def check(spark, vectors, components=4):
    got = whiten(spark.createDataFrame(rows_of(vectors), SCHEMA), components).toPandas().sort_values(["component", "vec_id"])
    n, away, white, explained = brute(vectors)
    for k, own in got.groupby("component"):
        assert list(own.vec_id) == list(range(len(vectors)))
        assert set(own.n) == {n} and list(own.deviation) == list(away)
        mine, right = own.whitened.to_numpy(), white[:, k - 1]
        assert np.allclose(mine, right, atol=1e-6) or np.allclose(mine, -right, atol=1e-6)
        assert np.allclose(own.explained, explained[k - 1], rtol=1e-6)
    assert len(got) and got.identity_error.max() < 1e-6
    return got


def test_matches_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(400, 12)) * np.geomspace(3, 0.05, 12)
    vectors = np.vstack([mixed, mixed[:50], mixed[:1].repeat(200, axis=0)])
    assert check(spark, vectors).component.nunique() == 4
    assert check(spark, vectors, 12).component.nunique() == 12


def test_nearly_dependent_columns(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 5))
    # Column 5 differs from column 0 by one unit of the grid in few rows; the Gram matrix is ill-conditioned.
    wide = np.hstack([base * 4000, base[:, :1] * 4000])
    wide[:3, 5] += 1 / 256
    got = check(spark, wide.astype(np.float32).astype(float), 5)
    assert got.component.nunique() == 5


def test_rank_deficient_rows(spark):
    rng = np.random.default_rng(7)
    flat = np.round(rng.normal(size=(60, 2)) * 100) @ np.array([[1, 0, 2, 0, 1], [0, 1, 1, 0, -1]])
    got = check(spark, flat.astype(float))
    assert got.component.nunique() == 2
    few = check(spark, np.diag([1.0, 2, 4, 0, 0, 0])[:3])
    assert few.component.nunique() == 2


def test_left_out_and_empty(spark):
    good = [[1, 2, 3], [4, 1, 0], [0, 0, 9], [0, 0, 9]]
    odd = [None, [1, None, 2], [float("nan"), 1, 1], [float("inf"), 0, 0], [1, 2], []]
    rows = rows_of(good + odd) + [(None, [2.0, 2.0, 2.0], None, None)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got.vec_id.dropna()) == {0, 1, 2, 3} and got.vec_id.isna().sum() == 3 and set(got.n) == {4}
    same = got[got.vec_id == 2].whitened.to_numpy() == got[got.vec_id == 3].whitened.to_numpy()
    assert same.all()
    schema = whiten(spark.createDataFrame(rows, SCHEMA)).schema
    for none in ([], rows_of(odd[:4]), rows_of([[1, 1]] * 3), rows_of([[]])):
        out = whiten(spark.createDataFrame(none, SCHEMA))
        assert out.schema == schema and out.count() == 0


def test_large_numbers_stay_exact(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [5e6, 3.0]]
    got = whiten(spark.createDataFrame(rows_of(vectors), SCHEMA)).toPandas()
    assert got.deviation.isna().sum() == 2 * got.component.nunique() or got.deviation.isna().all()
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    want = [sum((7 * int(v) - s) ** 2 for v, s in zip(row, [11, 2])) for row in x]
    assert deviations(x, [11, 2], 7) == [w if w < 1 << 63 else None for w in want]


def test_triangular_steps():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 6))
    upper = triangle(a.T @ a, 0.0)
    assert np.allclose(upper, np.triu(upper)) and np.allclose(upper.T @ upper, a.T @ a)
    q = solve_rows(a, upper)
    assert np.allclose(q @ upper, a) and np.allclose(q.T @ q, np.eye(6))


def test_factor_reproduces_gram(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-500, 500, size=(200, 8))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    r = orthogonal_factor(fit, 8, x.sum(axis=0).tolist(), len(x))
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12, atol=1e-6)

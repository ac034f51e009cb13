"""Whitening against plain eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from chronolake.llm import whitening


def brute(vectors, k=16):
    """n, deviations by vector, whitened by vector, explained: from the covariance of the distinct vectors."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    rows = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vecs = np.linalg.eigh(rows.T @ rows / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    own = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x], own @ vecs / np.sqrt(values), values / (rows**2).sum() * n


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


@pytest.mark.parametrize("flat", [True, False])
def test_rows_equal_plain_eigenvectors(spark, flat):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 40)) * (1 if flat else 40 * 0.8 ** np.arange(40)) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]).astype(np.float32).astype(float).tolist()
    vectors += vectors[:7]
    df = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string")
    n, deviations, want, explained = brute(vectors)
    got = held(whitening.whiten(df))
    assert len(got) == 407 and {len(x) for x in got.values()} == {16}
    there = np.array([[got[k][c]["whitened"] for c in range(1, 17)] for k in range(407)])
    signs = np.sign((there * want).sum(axis=0))
    assert np.abs(there * signs - want).max() < 1e-7
    assert [got[k][1]["deviation"] for k in range(407)] == deviations and {r["n"] for x in got.values() for r in x.values()} == {n} and n == 400
    assert np.allclose([got[0][c]["explained"] for c in range(1, 17)], explained, rtol=1e-9)
    assert got[0][1]["identity_error"] < 1e-9


def test_a_steep_spectrum_needs_no_full_dimension(spark, monkeypatch):
    """Residuals are small after a few passes: every basis has the columns asked for and the oversampled ones only."""
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 60)) * np.concatenate([1000 * 0.8 ** np.arange(16), np.full(44, 0.0)]) + 0.01).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    seen = []
    plain = whitening.ritz
    monkeypatch.setattr(whitening, "ritz", lambda basis, product, k: seen.append(basis.shape) or plain(basis, product, k))
    got = whitening.fit(df)[60]
    assert set(seen) == {(60, 24)} and got.identity_error < 1e-9
    _, _, want, explained = brute(vectors)
    assert np.allclose(got.explained, explained, rtol=1e-8)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [0.0, 0.0]), (None, [3.0, -1.0]), (8, [3.0, -1.0]), (8, [3.0, -1.0]), (9, [5.0]), (10, [1e30, -1e30, 0.0]), (11, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 2), (7, 1), (7, 2), (8, 1), (8, 1), (8, 2), (8, 2), (9, 1), *[(10, c) for c in (1, 2, 3)], *[(11, c) for c in (1, 2, 3)]]
    assert {r["n"] for r in got if r["vec_id"] == 1} == {3}
    assert [(r["whitened"], r["explained"], r["deviation"], r["n"]) for r in got if r["vec_id"] == 9] == [(0.0, 0.0, 0, 1)]
    assert all(r["deviation"] is None for r in got if r["vec_id"] == 10)
    assert whitening.whiten(df.limit(0)).count() == 0

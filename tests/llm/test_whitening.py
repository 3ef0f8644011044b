"""Embedding whitening against a plain eigen-decomposition."""

import math

import numpy as np
import pytest

from conftest import SF0001
from lethe.llm import whitening as W


def brute(rows, most):
    """{row number: (deviation, whitened)}, n, explained, with numpy's solver."""
    good = {k: v for k, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    dims = max((len(v) for v in good.values()), default=0)
    xs = {k: [math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for k, v in good.items()}
    fit = sorted(set(map(tuple, xs.values())))
    if not fit:
        return {}, 0, []
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    keep = e > 1e-12 * np.trace(v)
    e, u = e[keep], u[:, keep]
    out = {k: (sum((n * a - b) ** 2 for a, b in zip(x, s)),
               np.array([(n * a - b) / n for a, b in zip(x, s)]) @ u / np.sqrt(e)) for k, x in xs.items()}
    return out, n, e / np.trace(v)


def check(spark, rows, most=4):
    df = spark.createDataFrame([(k, v, [1], "x") for k, v in enumerate(rows)],
                               "vec_id long, embedding array<double>, whitened array<int>, id string").repartition(3)
    got = {r.vec_id: r for r in W.whiten(df, most).collect()}
    want, n, share = brute(rows, most)
    assert set(got) == set(want)
    sign = None
    for k, (deviation, white) in want.items():
        r = got[k]
        assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
        assert np.allclose(r.explained, share, rtol=1e-9) and r.identity_error <= 1e-9
        if sign is None and len(white) and np.abs(white).min() > 1e-3:
            sign = np.sign(white) * np.sign(r.whitened)
    for k, (_, white) in want.items():
        assert np.allclose(np.array(got[k].whitened) * (1 if sign is None else sign), white, atol=1e-7)
    return got


def test_brute_force(spark):
    r = np.random.default_rng(1)
    rows = (r.standard_normal((300, 7)) * [3, 1, 2, 0.5, 0.1, 4, 1]).tolist()
    rows += [rows[0]] * 150 + [None, [None] * 7, [1.0] * 6 + [float("nan")], [float("inf")] + [0.0] * 6, [], [-0.0, 2.0]]
    check(spark, rows)


def test_fewer_components_and_constant_tables(spark):
    r = np.random.default_rng(2)
    line = [[float(a), 2.0 * a, 0.0] for a in r.integers(-9, 9, 50).tolist()]
    got = check(spark, line)
    assert all(len(x.whitened) == 1 for x in got.values())
    assert all(list(x.whitened) == [] and x.n == 1 for x in check(spark, [[1.0, 2.0]] * 5).values())
    assert check(spark, [None, [None]]) == {}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(df).collect() == []


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(3)
    check(spark, (r.standard_normal((40, 3)) * 1e9).tolist(), 2)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 1, 0], [3, 3 - 1e-9, 3 - 2e-9, 3 - 3e-9, 1], [1, 1, 1, 1, 1],
                                    [9, 0, 0, 0, 0], [1e12, 1e6, 1, 1e-6, 1e-12], [1e-200] * 5])
def test_eigenpairs(values):
    """Distinct, repeated and close eigenvalues."""
    r = np.random.default_rng(4)
    for size in (5, 40):
        v = np.concatenate([values, np.zeros(size - 5)])
        q, _ = np.linalg.qr(r.standard_normal((size, size)))
        a = q * v @ q.T
        a = (a + a.T) / 2
        e, u = W.leading_eigenpairs(a, 4)
        norm = max(map(abs, values))
        assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:4], atol=1e-13 * norm)
        assert np.allclose(u.T @ u, np.eye(4), atol=1e-12)
        assert np.abs(a @ u - u * e).max() <= 1e-12 * norm


def test_small_and_diagonal_matrices():
    for a in (np.zeros((3, 3)), np.eye(3), np.array([[2.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]), np.diag([1.0, 5.0, 3.0])):
        e, u = W.leading_eigenpairs(a, 4)
        assert np.allclose(a @ u, u * e, atol=1e-13) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-13)
        assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13)
    assert len(W.leading_eigenpairs(np.zeros((0, 0)), 4)[0]) == 0


def test_query(spark):
    """The registered query's rows against the brute force over the whole table."""
    from lethe.llm.queries import QUERIES
    table = spark.read.parquet(f"{SF0001}/embeddings.parquet").select("vec_id", "embedding").collect()
    want, n, share = brute([r.embedding for r in table], 4)
    rows = QUERIES["op12_whitening"](spark, SF0001).collect()
    assert len(rows) == 4 * len(want)
    at = {r.vec_id: k for k, r in enumerate(table)}
    ratio = {}
    for r in rows:
        deviation, white = want[at[r.vec_id]]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(white[c])) < 1e-8
        if abs(white[c]) > 1e-3:
            ratio.setdefault(c, set()).add(np.sign(r.whitened) == np.sign(white[c]))
    assert all(len(s) == 1 for s in ratio.values())

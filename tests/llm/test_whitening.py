"""Whitening against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecohort.llm import whitening as W
from wavecohort.llm.queries import QUERIES


def brute(rows, k=4):
    """{(row number, component): (n, deviation, |whitened|, explained)} from rows (id, vector)."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    xs = [tuple(min(2 ** 31 - 1, max(-2 ** 31, math.floor(256 * c))) for c in v) + (0,) * (d - len(v)) for _, v in good]
    fit = sorted(set(xs))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(s) / n
    cov = a.T @ a / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    out = []
    for (i, _), x in zip(good, xs):
        dev = sum((n * p - q) ** 2 for p, q in zip(x, s))
        y = (np.array(x) - np.array(s) / n) @ c / np.sqrt(e)
        out += [(i, j + 1, n, dev, abs(y[j]), e[j] / np.trace(cov)) for j in range(min(k, d))]
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        assert abs(abs(g[4]) - w[4]) < 1e-6 * max(1, w[4]) and abs(g[5] - w[5]) < 1e-9 and g[6] < 1e-9


@pytest.mark.parametrize("d", ["sf0.001", "sf0.1"])
def test_registered_query(spark, d):
    path = f"/root/testdata/{d}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"][0](spark, path).collect()
    check(got, brute(rows))
    # one sign for all rows: projections of a component agree with its own direction
    assert len({(r.n, r.identity_error) for r in got}) == 1


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (100, None), (101, [1.0, None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6),
             (104, []), (105, [0.5, -0.25]), (106, [-0.0] * 6), (107, [0.001] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("?"), "id": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    check(W.report(df).collect(), brute(rows))
    assert W.report(df.limit(0)).count() == 0 and W.report(df.filter("vec_id = 104")).count() == 0
    one = W.report(df.filter("vec_id in (0, 100)")).collect()
    assert len(one) == 12 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    # one direction only: it is whitened, the others are null
    line = W.report(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0, 1.0, 1.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in line)
    assert abs(sum(r.explained for r in line) - 9) < 1e-12
    far = W.report(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation is None for r in far if r.vec_id < 3} == {True} and len(far) == 6


def test_large_sums_stay_exact(spark):
    rows = [(i, [4e6 * (-1) ** i + i, 123456.5 * i]) for i in range(50)]
    got = W.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {(r[0], r[1]): r[3] for r in brute(rows)}
    assert {(r.vec_id, r.component): r.deviation for r in got} == {k: v if v < 2 ** 63 else None for k, v in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10 ** 6), st.sampled_from(["full", "low rank", "equal", "blocks", "scaled", "integer"]))
def test_eigenpairs_against_numpy(d, seed, kind):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(d, d))
    if kind == "low rank":
        b[1:] = 0
    if kind == "scaled":
        b *= 10.0 ** rng.integers(-8, 8, d)[:, None]
    a = b @ b.T
    if kind == "equal":
        q = np.linalg.qr(b)[0]
        a = q @ np.diag(np.repeat([5.0, 2.0, 2.0, 2.0, 1.0], 3)[:d]) @ q.T
    if kind == "blocks":
        a = np.diag(rng.integers(1, 3, d).astype(float))
    if kind == "integer":
        a = np.round(a * 3)
    a = (a + a.T) / 2
    e, v = W.eigenpairs(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    size = max(1e-300, np.abs(a).max())
    assert np.allclose(e, want, rtol=0, atol=1e-13 * size * d)
    assert np.abs(a @ v - v * e).max() <= 1e-12 * size * d
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-10


def test_sturm_counts():
    a = np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]])
    e = np.linalg.eigvalsh(a)
    at = np.array([e[0] - 1e-9, e[0] + 1e-9, 2.5, e[2] + 1e-9])
    assert W.sturm_counts(np.diagonal(a), np.diagonal(a, 1), at).tolist() == [0, 1, 2, 3]

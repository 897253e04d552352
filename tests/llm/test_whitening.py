"""Whitening: inertia counts and eigenvectors against a dense solver, exact columns, odd tables."""

import math

import numpy as np
import pytest

from clickloom.llm import spectrum_whitening as sw
from tests.conftest import SMALL


def dense(values, rng):
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20):
        a = rng.normal(size=(n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in [*(e[:-1] + e[1:]) / 2, e[0] - 1, e[-1] + 1, 0.0]:
            assert sw.above(a, shift) == (e > shift).sum()
    zero_pivots = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert sw.above(zero_pivots, 0.0) == 1 and sw.above(zero_pivots, -0.5) == 2


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 5, 3, 1, 0.5],
        [7.0, 7, 7, 2, 2, 1],
        [1e9, 1.0, 1.0 + 1e-9, 1e-3, 0],
        [4.0],
        list(np.geomspace(1, 1e6, 64)),
        [3.0] * 8,
        [0.0, 0, 0],
        [1 + 1e-13 * i for i in range(6)],
    ],
)
def test_leading_eigenvalues(values):
    a = dense(np.array(values), np.random.default_rng(2))
    a = (a + a.T) / 2
    got, vectors = sw.leading(a, len(values))
    scale = max(map(abs, values)) or 1
    assert np.allclose(got, np.sort(values)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * got).max() <= 1e-13 * scale


def brute(rows, components=32):
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    cov = np.cov(x.astype(float).T, bias=True).reshape(len(s), len(s))
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    white = (x.astype(float) - s.astype(float) / n) @ q / np.sqrt(e)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    return {(k, j + 1): (n, int(deviation[i]), abs(white[i, j]), e[j] / np.trace(cov)) for i, (k, _) in enumerate(good) for j in range(len(e))}


def compare(out, want):
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert set(got) == set(want)
    for k, (n, deviation, white, share) in want.items():
        r = got[k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["whitened"] == pytest.approx(white, abs=1e-8) or -r["whitened"] == pytest.approx(white, abs=1e-8)
        assert r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-9


def test_small_table_against_dense_solver(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    out = sw.whiten(df.repartition(7).withColumnRenamed("label", "n"))
    compare(out, brute(rows))
    white = np.zeros((len(rows), 32))
    place = {k: i for i, (k, _) in enumerate(rows)}
    for r in out.collect():
        white[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(white.T @ white / len(rows) - np.eye(32)).max() < 1e-9  # one sign per component for all rows


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3) * (1, 40, 3000)]) for i in range(50)]
    rows += [(7, rows[7][1]), (None, [1.0, 2.0, 3.0]), (60, None), (61, [1.0, None, 2.0]), (62, [1.0, math.nan, 2.0]), (63, [math.inf, 0.0, 0.0]), (64, []), (65, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS component", "2 AS _v", "'x' AS whitened")
    out = sw.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    good = rows[:52]
    want = brute(good)
    assert out.count() == 52 * 3
    compare(out.filter("vec_id <> 7 OR vec_id IS NULL"), {k: v for k, v in want.items() if k[0] != 7})


def test_constant_and_repeated_columns(spark):
    rows = [(i, [float(i), float(i), 5.0]) for i in range(10)]
    out = sw.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert [r["component"] for r in out.collect()] == [1] * 10
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    assert sw.whiten(same).count() == 0 and sw.whiten(same.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [1e30 * i, 1.0 * i]) for i in range(3)], "vec_id bigint, embedding array<double>")
    assert sw.whiten(huge).filter("deviation IS NULL").count() > 0

"""Covariances against fractions, whole results against numpy, odd vectors."""

from fractions import Fraction

import numpy as np
import pytest

from docpipe.llm.whitening import DIGIT_NAMES, digits, fit_whitening, integer_vectors, number, op12_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string, component int"


@pytest.fixture
def vectors(spark):
    def make(values, ids=None):
        return spark.createDataFrame([(i, v, 1, 2, "n", 3) for i, v in zip(ids or range(len(values)), values, strict=True)], SCHEMA).repartition(3)

    return make


def random_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d))).astype(np.float32)


def plain(x):
    """n, S, covariance by fractions, of the distinct rows of x."""
    fit = sorted({tuple(int(c) for c in row) for row in x})
    n, d = len(fit), len(fit[0])
    total = [sum(v[i] for v in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in total]
    return n, total, np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(d)] for i in range(d)])


@pytest.mark.parametrize("value", [0, 1, -1, 1 << 39, -(1 << 40), 12345678901234567890, -(1 << 150) + 7, (1 << 200) + 3])
def test_digits(value):
    assert number(dict(zip(DIGIT_NAMES, digits(value), strict=True))) == value


@pytest.mark.parametrize("scale", [1, 1000, 2**33, 2**50])
def test_fit(spark, vectors, scale):
    """Sums stay exact whatever the size of the entries, also beyond 64 bits."""
    data = random_vectors(60, 5)
    rows = integer_vectors(vectors(data.tolist()), scale=scale)
    fitted = fit_whitening(rows.select("x").distinct(), 5)
    x = np.floor(data.astype(float) * scale).astype(np.int64)
    n, total, covariance = plain(x)
    assert fitted.n == n and list(fitted.total) == total
    values, _ = np.linalg.eigh(covariance)
    assert np.allclose(fitted.eigenvalues, values[::-1], rtol=1e-9)
    assert np.allclose(covariance @ fitted.components, fitted.components * fitted.eigenvalues, rtol=0, atol=1e-9 * values.max())
    assert fitted.trace == pytest.approx(np.trace(covariance), rel=1e-14)


def test_result(vectors):
    data = random_vectors(80, 6, 1)
    data = np.concatenate((data, data[:20], data[:1].repeat(50, axis=0)))
    got = whiten(vectors(data.tolist())).collect()
    x = np.floor(data.astype(float) * 256).astype(np.int64)
    n, total, covariance = plain(x)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    white = (x - np.array(total) / n) @ basis / np.sqrt(values)
    deviation = ((n * x - np.array(total)) ** 2).sum(axis=1)
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, c) for i in range(len(data)) for c in (1, 2, 3, 4)]
    signs = {}
    for r in got:
        k, expected = r["component"] - 1, white[r["vec_id"], r["component"] - 1]
        signs.setdefault(k, np.sign(expected * r["whitened"]))
        assert r["whitened"] * signs[k] == pytest.approx(expected, abs=1e-9)
        assert r["n"] == n == 80 and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_odd(vectors):
    """Null vectors, null and non-finite entries, other lengths and empty vectors go; null ids stay."""
    good = random_vectors(10, 3, 2).tolist()
    odd = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 1.0], [float("-inf"), 0.0, 1.0], [], [1.0, 2.0]]
    got = whiten(vectors([*good, *odd, good[0]], [*range(10), *range(100, 107), None])).collect()
    assert sorted({r["vec_id"] for r in got}, key=lambda v: (v is None, v)) == [*range(10), None]
    assert len(got) == 33 and {r["n"] for r in got} == {10}


def test_without_variance(vectors):
    got = whiten(vectors([[1.0, 2.0], [1.0, 2.0]])).collect()
    assert len(got) == 4
    assert all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, 0.0) for r in got)
    line = whiten(vectors([[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)


def test_large_entries(vectors):
    got = whiten(vectors([[3e38, 0.0], [-3e38, 1.0], [0.5, 2.0]])).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 0} == {None}


def test_empty(vectors):
    none = vectors([[1.0]]).filter("vec_id < 0")
    assert whiten(none).collect() == []
    assert whiten(vectors([None, [None]])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark):
    got = op12_whitening(spark, "/root/testdata/sf0.001").toPandas().sort_values(["vec_id", "component"])
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.array(data["embedding"].tolist(), float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    white = ((x - total / n) @ basis[:, ::-1][:, :4]) / np.sqrt(values[::-1][:4])
    assert (got["deviation"].to_numpy().reshape(-1, 4)[:, 0] == ((n * x - total) ** 2).sum(axis=1)).all()
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 4)), np.abs(white), atol=1e-8)
    assert set(got["n"]) == {n} and got["identity_error"].max() < 1e-4

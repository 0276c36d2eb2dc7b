"""Whitening against a dense eigendecomposition, exact integers and matrices with known spectra."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lanczos_whitening as lw


def brute(vectors, k=4):
    """Rows of (vec_id, embedding) to {(vec_id, component): (n, deviation, |whitened|, explained)}."""
    sound = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit.astype(float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, x in sound:
        w = (np.array(x, float) - np.array([s / n for s in sums])) @ basis / np.sqrt(values)
        for c in range(min(k, len(x))):
            out[i, c + 1] = n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), abs(w[c]), values[c] / values.sum()
    return out


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("dim", [2, 3, 7, 30])
def test_equals_dense_eigenvectors(spark, dim):
    rng = np.random.default_rng(dim)
    data = rng.standard_normal((200, dim)) * np.linspace(3, 0.5, dim) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    vectors = [(k, v.tolist()) for k, v in enumerate(data)]
    vectors += [(1000, data[0].tolist()), (1001, None), (1002, [None, *data[1][1:].tolist()]), (1003, [float("nan"), *data[2][1:].tolist()]), (1004, [float("inf"), *data[2][1:].tolist()])]
    rows = lw.lanczos_whitening(frame(spark, vectors)).collect()
    want = brute(vectors)
    assert len(rows) == len(want) == 201 * min(4, dim)
    for r in rows:
        n, deviation, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and n == 200
        assert abs(abs(r["whitened"]) - w) < 1e-9 and abs(r["explained"] / share - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_same_sign_in_all_rows(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((80, 5)) * [9, 5, 3, 2, 1]
    rows = lw.lanczos_whitening(frame(spark, [(k, v.tolist()) for k, v in enumerate(data)]).repartition(7)).collect()
    x = np.floor(256 * data)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    for c in range(4):
        got = np.array([r["whitened"] for r in sorted(rows, key=lambda r: r["vec_id"]) if r["component"] == c + 1])
        want = (x - x.mean(axis=0)) @ basis[:, -1 - c] / np.sqrt(values[-1 - c])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9


def test_lanczos_on_known_spectra():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for spectrum in ([5.0] * 4 + [1.0] * 56, [1.0] * 60, [7.0, 7.0, 7.0, 2.0] + [0.0] * 56, list(np.geomspace(1, 1e-9, 60)), [0.0] * 60):
        v = q * np.array(spectrum) @ q.T
        values, vectors, left, passes = lw.block_lanczos(lambda b, v=v: v @ b, 60, 4)
        assert np.allclose(values, sorted(spectrum)[::-1][:4], rtol=1e-12, atol=1e-13)
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
        assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-12 * max(spectrum[0], 1)
    assert passes == 1  # of the matrix of zeros: broken down, and converged, at once


def test_lanczos_stops_before_it_spans_a_large_space():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((600, 600)))[0]
    v = q * np.r_[[100.0, 80.0, 60.0, 50.0], np.linspace(10, 0, 596)] @ q.T
    values, _, _, passes = lw.block_lanczos(lambda b: v @ b, 600, 4)
    assert np.allclose(values, [100, 80, 60, 50], rtol=1e-12) and passes < 40


def test_exact_deviations_of_large_entries(spark):
    vectors = [(0, [1e15, 2.0]), (1, [-3e15, 1.5]), (2, [2e10, -7.25]), (3, [1e12, 0.0]), (4, [1e15, 2.0])]
    want = brute(vectors)
    rows = lw.lanczos_whitening(frame(spark, vectors)).collect()
    assert {(r["vec_id"], r["component"]): r["deviation"] for r in rows} == {k: Decimal(int(v[1])) for k, v in want.items()}


def test_components_without_variance(spark):
    rows = lw.lanczos_whitening(frame(spark, [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])])).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["n"] == 2 and r["deviation"] == 256 * 256 and r["identity_error"] < 1e-12
        assert (r["whitened"] is not None) == (r["component"] == 1) and r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0)
    rows = lw.lanczos_whitening(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in rows)


def test_lengths_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, [(0, [1.0, 0.5]), (1, [0.0, 1.5]), (2, [3.0]), (3, [5.0]), (4, []), (5, [-0.0, -1e-9])]).withColumns({"x": F.lit("a"), "n": F.lit(1)})
    rows = lw.lanczos_whitening(docs).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in rows) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 2), (3, 1, 2), (5, 1, 3), (5, 2, 3)]
    assert {abs(r["whitened"]) for r in rows if r["n"] == 2} == {1.0}
    none = lw.lanczos_whitening(docs.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query(spark):
    out = lw.op11_lanczos_whitening(spark, "/root/testdata/sf0.001")
    want = brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()])
    rows = out.collect()
    assert len(rows) == len(want) and dict(out.dtypes)["deviation"] == "bigint"
    assert all((r["n"], r["deviation"]) == want[r["vec_id"], r["component"]][:2] and abs(abs(r["whitened"]) - want[r["vec_id"], r["component"]][2]) < 1e-8 for r in rows)

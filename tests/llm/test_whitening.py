"""Whitening against exact fractions, numpy's eigenvectors, and matrices whose roots are known."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def floors(rows):
    return [[math.floor(64 * float(np.float32(c))) for c in v] for v in rows]


def brute(vectors):
    """n, deviations by vector, covariance: in exact fractions, over the distinct cells."""
    own = sorted({tuple(c + 1_000_000 for c in v) for v in floors(vectors)})
    n, d = len(own), len(own[0])
    sums = [sum(v[j] for v in own) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in own) / n) for j in range(d)] for i in range(d)]
    return n, sums, np.array(cov)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = np.random.default_rng(3)
    fine = (rnd.normal(size=(60, 6)) @ np.diag([2, 1.5, 1, 0.7, 0.5, 0.3])).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(fine)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[1][1]), (101, rows[2][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [NAN] * 6), (204, [INF] + [0.0] * 5), (205, [1.0])]
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, x int, whitening string")
    frame.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitened(spark, str(tmp_path)).collect()
    n, sums, cov = brute([v for _, v in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 6 * len(rows) and {r.n for r in got} == {n}
    want = {}
    for i, v in rows:
        x = [c + 1_000_000 for c in floors([v])[0]]
        w = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values)
        want[i] = (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), w)
    signs = np.array([np.sign(vectors[np.abs(vectors[:, k]).argmax(), k]) for k in range(6)])
    for r in got:
        deviation, w = want[r.vec_id]
        assert r.deviation == deviation
        assert abs(r.whitened - w[r.component - 1] * signs[r.component - 1]) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
        assert r.identity_error < 1e-9


def test_whole_table(spark):
    got = queries.op11_whitened(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert got.count() == 16 * n and got.agg(F.max("identity_error")).first()[0] < 1e-9
    first = got.where("component = 1").agg(F.avg("whitened"), F.var_pop("whitened")).first()
    assert abs(first[0]) < 1e-9 and abs(first[1] - 1) < 1e-9


def test_empty_equal_and_flat(spark):
    def whitened(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        model = whitening.fit(df)
        return model, whitening.whiten(df, model).collect()

    assert whitened([])[1] == []
    model, rows = whitened([(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert model.n == 1 and not len(model.variances) and [(r.whitening.deviation, r.whitening["values"]) for r in rows] == [(0, []), (0, [])]
    model, rows = whitened([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])
    assert len(model.variances) == 1 and abs(np.var([r.whitening["values"][0] for r in rows]) - 1) < 1e-12


def test_entries_far_out(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    found = {r.vec_id: r.whitening for r in whitening.whiten(df, model).collect()}
    assert found[1].deviation is None and found[3].deviation == (3 * 64 - 64) ** 2
    assert model.identity_error < 1e-6


def test_polynomial_and_roots_of_known_matrices(spark):
    rnd = np.random.default_rng(5)
    a = rnd.integers(-9, 10, (12, 5)).astype(object)
    m = a @ a.T  # rank 5
    poly = whitening.characteristic_polynomial(spark, m)
    assert poly[:7] == [0] * 7 and poly[12] == 1 and poly[11] == -sum(m[i, i] for i in range(12))
    for t in (1, 7, 100):  # against the determinant in fractions
        rows = [[Fraction(t * (i == j) - int(m[i, j])) for j in range(12)] for i in range(12)]
        det = Fraction(1)
        for k in range(12):
            p = next((i for i in range(k, 12) if rows[i][k]), None)
            if p is None:
                det = Fraction(0)
                break
            if p != k:
                rows[k], rows[p], det = rows[p], rows[k], -det
            det *= rows[k][k]
            for i in range(k + 1, 12):
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
        assert sum(c * t**i for i, c in enumerate(poly)) == det
    found = whitening.largest_roots(poly, 16)
    assert [t for _, _, t in found] == [1] * 5
    assert np.allclose([x / 2**s for x, s, _ in found], np.linalg.eigvalsh(m.astype(float))[::-1][:5], rtol=1e-10)


def test_roots_that_come_several_times():
    poly = [1]
    for root in (0, 3, 3, 3, 10, 10, 17):
        poly = [(poly[i - 1] if i else 0) - root * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    found = whitening.largest_roots(poly, 16)
    assert [(round(m / 2**s, 9), t) for m, s, t in found] == [(17, 1), (10, 2), (3, 3)]
    m = np.array([[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 1], [0, 0, 1, 2]], object)
    basis = whitening.null_vectors(m, 5, 0, 2)
    assert np.allclose(basis @ basis.T, np.eye(2), atol=1e-15) and np.allclose(m.astype(float) @ basis.T, 5 * basis.T, atol=1e-14)


@pytest.mark.parametrize("scale", [50, 2**31, 2**59])
def test_gram_is_exact(scale):
    x = np.random.default_rng(2).integers(-scale, scale, (9000, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.gram(x).tolist() == want

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, scale=256):
    """Exact covariance by fractions, its eigenvectors by inverse iteration on long doubles."""
    xs = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    v = [[sum((Fraction(n * x[a] - sums[a], n)) * (Fraction(n * x[b] - sums[b], n)) for x in fit) / n for b in range(d)] for a in range(d)]
    trace = sum(v[k][k] for k in range(d))
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    out = {}
    for i, x in xs:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(4, d)):
            e, u = values[-1 - k], vectors[:, -1 - k]
            w = sum(float(Fraction(n * c - s, n)) * t for c, s, t in zip(x, sums, u)) / math.sqrt(e)
            out.setdefault((i, k + 1), []).append((n, dev, abs(w), e / float(trace)))
    return out


def close(df, rows):
    got = {}
    errors = set()
    for r in df.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        errors.add(r["identity_error"])
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        for g, w in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9, abs=1e-9)
    assert len(errors) == 1 and errors.pop() < 1e-9
    return got


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 1] + 1000).tolist()) for i in range(300)]
    rows += [(900 + i, rows[0][1]) for i in range(200)] + [(5, rows[5][1])]
    got = close(W.whiten(spark.createDataFrame(rows, SCHEMA)), rows)
    assert got[(0, 1)][0][0] == 300


def test_given_embeddings_equal_exact_covariance(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(120)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    close(W.whiten(spark.createDataFrame(rows, SCHEMA)), rows)


def test_sums_are_compensated():
    rng = np.random.default_rng(1)
    hi, lo = rng.normal(size=(700, 5)) * [1e8, 1, 1e-3, 1e5, 7], rng.normal(size=(700, 5)) * 1e-17
    total = W.add_outer((np.zeros((5, 5)), np.zeros((5, 5))), hi, lo)
    for a in range(5):
        for b in range(5):
            exact = sum((Fraction(h[a]) + Fraction(x[a])) * (Fraction(h[b]) + Fraction(x[b])) for h, x in zip(hi.tolist(), lo.tolist()))
            size = float(sum(abs(h[a] * h[b]) for h in hi))
            assert abs(float(Fraction(total[0][a, b]) + Fraction(total[1][a, b]) - exact)) <= 1e-27 * max(size, 1e16)


def test_eigenvectors_are_refined_where_values_are_close():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    ql = q.astype(np.longdouble)
    for _ in range(3):
        ql = ql @ (1.5 * np.eye(8) - 0.5 * (ql.T @ ql))
    want = np.array([5, 5 - 1e-6, 4, 3, 2, 1, 0.5, 0], np.longdouble)
    v = (ql * want) @ ql.T
    hi = v.astype(np.float64)
    values, x = W.eigen(hi, (v - hi).astype(np.float64))
    assert np.allclose(values, want.astype(float), atol=1e-13)
    assert np.abs(np.abs((ql.T @ x).astype(float)) - np.eye(8)).max() < 1e-11


def test_rows_that_take_no_part_ties_and_nothing_that_varies(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (None, [-0.0, 0.25]), (5, [0.5]), (5, [0.5]), (6, [0.0, 1.0]), (6, [2.0, -1.0])]
    df = spark.createDataFrame(bad, SCHEMA).withColumn("id", F.lit("x")).withColumn("V", F.lit(1)).withColumn("n", F.lit(9))
    close(W.whiten(df), [(None, [0.0, 0.25]), (5, [0.5, 0.0]), (5, [0.5, 0.0]), (6, [0.0, 1.0]), (6, [2.0, -1.0])])
    assert W.whiten(spark.createDataFrame(bad[:4], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    one = W.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    assert W.whiten(spark.createDataFrame([(1, [])], SCHEMA)).count() == 0


def test_very_large_entries_have_exact_deviations_or_none(spark):
    rows = [(1, [2.0**40]), (2, [0.0]), (3, [1e300])]
    df = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert [r["deviation"] for r in df.collect()] == [None] * 3
    small = W.whiten(spark.createDataFrame([(1, [2.0**22]), (2, [0.0])], SCHEMA)).orderBy("vec_id").collect()
    assert [r["deviation"] for r in small] == [2**60, 2**60]

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from conftest import SF01
from textloom.llm import whitening as W

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows, k=16):
    """Exact integers, then a dense solver."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in e]) for i, e in rows
            if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    y = np.array([[(n * c - t) / n for c, t in zip(x, s)] for _, x in kept]) @ q / np.sqrt(e)
    far = [sum((n * c - t) ** 2 for c, t in zip(x, s)) for _, x in kept]
    return [i for i, _ in kept], n, far, y, e / np.trace(z.T @ z / n)


def compare(got, rows, k=16, tolerance=1e-8):
    ids, n, far, y, share = brute(rows, k)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = [1.0] * k
    big = np.abs(y).argmax(0)
    for c in range(k):
        sign[c] = math.copysign(1.0, by[ids[big[c]]][c + 1][0].whitened * y[big[c], c])
    for row, i in enumerate(ids):
        for c in range(k):
            for r in by[i][c + 1]:
                assert r.deviation == far[row] and abs(r.whitened * sign[c] - y[row, c]) < tolerance
                assert abs(r.explained / share[c] - 1) < 1e-10 and r.identity_error < 1e-10


def test_whole_table_equals_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = W.op12_whitening(spark, SF01)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    compare(got.collect(), rows)


def test_bad_vectors_copies_and_clashing_names(spark, scratch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [3, 2, 1.5, 1, 0.7, 0.5]]) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]               # a third of all rows are copies
    bad = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5),
           (2004, []), (2005, [1.0, 2.0]), (2006, [3e38] * 6)]
    df = spark.createDataFrame(rows + bad, VEC).repartition(7).selectExpr("*", "1 as x", "2 as n", "3 as `a.b`")
    compare(W.whitened_rows(df, scratch(), 4).collect(), rows, 4)
    assert W.whitened_rows(df.limit(0), scratch()).count() == 0
    assert W.whitened_rows(df.where("vec_id >= 1000 and vec_id < 2000"), scratch()).count() == 0    # one distinct vector
    few = W.whitened_rows(df.where("vec_id < 3"), scratch())                                        # rank 2 in 6 dimensions
    assert {r.component for r in few.collect()} == {1, 2}


def test_exact_far_beyond_64_bits():
    n, x = 3 * 10**9, np.array([[2**50, -5], [7, 1_000_000]])
    c = W.Centre(n, [n * 1_000_000 + 17, -n * 999_999 - 3])
    want = [[n * int(v) - s for v, s in zip(row, c.sums)] for row in x]
    assert c.scaled(x).tolist() == want
    assert c.deviation(x) == [sum(v * v for v in row) for row in want]


class Dense:
    """A small stand-in for the distributed product."""
    def __init__(self, m):
        self.m, self.d, self.passes = m, len(m), 0

    def __call__(self, q):
        self.passes += 1
        return self.m @ q


@pytest.mark.parametrize("kind", ["bulk", "steps", "ties", "low rank", "geometric"])
def test_iteration_against_dense_spectra(kind):
    rng = np.random.default_rng(3)
    d = 120
    e = {"bulk": np.r_[400, 130, rng.uniform(0.8, 1.2, d - 2)], "steps": np.repeat([9.0, 5.0, 4.0, 1.0], 30),
         "ties": np.r_[[7.0] * 5, [6.0] * 20, np.linspace(1, 3, d - 25)], "low rank": np.r_[np.arange(1, 11), np.zeros(d - 10)],
         "geometric": 2.0 ** -np.arange(d)}[kind]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = Dense((q * e) @ q.T)
    values, vectors = W.subspace_iteration(v, 16)
    want = np.sort(e)[::-1][:16]
    assert np.abs(values - want).max() < 1e-11 * want[0]
    live = want > 1e-9 * want[0]
    assert np.abs(v.m @ vectors - vectors * values)[:, live].max() < 1e-10 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert v.passes < 400


def test_a_start_that_misses_the_largest_direction_is_found_out(monkeypatch):
    """The first block is orthogonal to the largest eigenvector: only the probe can find it."""
    d = 60
    m = np.diag(np.r_[50.0, np.linspace(10, 1, d - 1)])
    plain, calls = W.orthogonal, []

    def blind(x, against):
        calls.append(1)
        if len(calls) == 1:
            x = x.copy()
            x[0] = 0
        return plain(x, against)

    monkeypatch.setattr(W, "orthogonal", blind)
    values, _ = W.subspace_iteration(Dense(m), 8)
    assert abs(values[0] - 50) < 1e-9 and len(values) == 8

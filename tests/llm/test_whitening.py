"""Whitening against a dense eigensolver and exact integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchtrail.llm import whitening as w

MIDDLE = "/root/testdata/sf0.01"


def plain(vectors):
    """(n, sums, eigenvalues, eigenvectors, trace, integers) of usable vectors of one length, without the solver."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[n * c - s for c, s in zip(row, sums)] for row in fit], dtype=np.float64) / n
    v = off.T @ off / n
    values, z = np.linalg.eigh(v)
    return n, sums, values[::-1], z[:, ::-1], np.trace(v), x


def check(rows, vectors, components=16):
    """``rows``: result by (position in ``vectors``, component)."""
    n, sums, values, z, trace, x = plain(vectors)
    for j in range(min(components, len(values))):
        if values[j] < 1e-9 * values[0]:
            continue
        got = np.array([rows[i, j + 1].whitened for i in range(len(vectors))])
        want = ((np.array(x, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n) @ z[:, j] / math.sqrt(values[j])
        want = want if np.dot(got, want) > 0 else -want
        assert np.allclose(got, want, rtol=1e-7, atol=1e-7)
        assert all(abs(rows[i, j + 1].explained / (values[j] / trace) - 1) < 1e-9 for i in range(len(vectors)))
    for i, row in enumerate(x):
        assert rows[i, 1].n == n and rows[i, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(row, sums))
    assert len({r.identity_error for r in rows.values()}) == 1 and rows[0, 1].identity_error < 1e-9


def test_equals_a_dense_solver(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    order = sorted(vectors)
    got = {(order.index(r.vec_id), r.component): r for r in w.whiten(table).collect()}
    assert len(got) == 16 * len(order)
    check(got, [vectors[i] for i in order])


def test_many_tasks_and_a_tree_of_factors(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN", 2)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(7)
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    order = sorted(vectors)
    check({(order.index(r.vec_id), r.component): r for r in w.whiten(table).collect()}, [vectors[i] for i in order])


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, -3.0]), (2, [0.0, 1.0, -3.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [inf, 1.0, 1.0]),
            (7, [nan, 1.0, 1.0]), (None, [5.0, 5.0, 5.5]), (8, [0.0, 0.0, 0.0]), (9, [1.0, 2.0]), (10, [3.0, 1.0]), (11, [7.0])]
    kind = "vec_id long, embedding array<float>, x string, n int, component int, dim int"
    table = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], kind)
    got = w.whiten(table).collect()
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in (1, 2, None, 8) for c in (1, 2, 3)} | {(9, 1), (10, 1)}
    assert len(got) == 17  # id 2 twice; the single vector of one entry has no spread
    three = [v for i, v in rows if i in (1, 2, None, 8)]
    spots = {}
    for r in got:
        if r.vec_id not in (9, 10):
            for k in [k for k, (i, v) in enumerate([x for x in rows if x[0] in (1, 2, None, 8)]) if i == r.vec_id]:
                spots[k, r.component] = r
    check(spots, three)
    assert w.whiten(table.limit(0)).count() == 0 and w.whiten(table.where("vec_id = 3")).count() == 0


def test_huge_entries(spark):
    rows = [(i, [float(i), (-1.0) ** i * 1e12, 3e38 if i == 1 else 0.0]) for i in range(6)]
    got = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(6)) and any(r.deviation is None for r in got)
    assert all(math.isfinite(r.whitened) and r.identity_error < 1e-4 for r in got)


@pytest.mark.parametrize("spread", [np.ones(40), np.r_[np.ones(20), np.full(20, 0.5)], 1 + 1e-8 * np.arange(40), 1 + 1e-5 * np.arange(40),
                                    np.logspace(0, -7, 40), np.r_[np.ones(5), np.zeros(35)]], ids=["equal", "two", "1e-8", "1e-5", "graded", "rank 5"])
def test_close_and_graded_values(spread):
    rng = np.random.default_rng(3)
    q, p = np.linalg.qr(rng.normal(size=(90, 40)))[0], np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a = (q * spread) @ p
    values, z = w.leading_directions(np.linalg.qr(a, mode="r"), 16)
    assert len(values) == min(16, int((spread > 0).sum()))
    assert np.allclose(values, np.sort(spread[spread > 0] ** 2)[::-1][:len(values)], rtol=1e-9, atol=1e-15)
    assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-10
    product = a @ z / np.sqrt(values)
    assert np.abs(product.T @ product - np.eye(len(values))).max() < 1e-7


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10 ** 6), st.sampled_from([1.0, 1e-3, 0.0]))
def test_dqds_finds_singular_values(d, seed, scale):
    rng = np.random.default_rng(seed)
    a, b = np.abs(rng.normal(size=d)) + 1e-6, rng.normal(size=d - 1) * scale
    want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert np.allclose(w.dqds(a, b), want, rtol=1e-8, atol=1e-14)

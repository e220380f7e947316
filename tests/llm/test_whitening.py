"""Whitening against a dense eigendecomposition in exact integers."""

import numpy as np
import pytest

from belfry.llm import queries, whitening


def check(rows, got, components=8):
    """``rows``: (vec_id, vector) pairs that take part; ``got``: result rows."""
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64) + 100_000
    n, d = x.shape
    sums = x.astype(object).sum(axis=0)
    off = n * x.astype(object) - sums
    z = off.astype(float) / n
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    want_dev = sorted(int(s) for s in (off ** 2).sum(axis=1))
    assert sorted(r.deviation for r in got if r.component == 1) == want_dev
    assert {r.n for r in got} == {n}
    trace = np.trace(cov)
    for c in range(1, k + 1):
        part = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == c}
        ours = np.array([part[i, int(s)] for (i, _), s in zip(rows, (off ** 2).sum(axis=1))], dtype=float)
        theirs = z @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        theirs *= np.sign(theirs @ ours)
        assert np.abs(ours - theirs).max() < 1e-8
        assert all(abs(r.explained - values[c - 1] / trace) < 1e-10 for r in got if r.component == c)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_rank_one_updates_keep_the_decomposition():
    r = np.random.default_rng(3)
    for d, n, kind in [(1, 4, "plain"), (5, 2, "plain"), (12, 200, "plain"), (20, 90, "ties"), (24, 60, "deficient"), (30, 200, "graded")]:
        x = r.standard_normal((n, d)) * 1000
        if kind == "ties":
            x = np.round(x / 700)
        if kind == "deficient":
            x[:, d // 2:] = x[:, :d - d // 2]
        if kind == "graded":
            x *= np.exp(-np.arange(d) / 2)
        one, left, right = (whitening.Spectrum.empty(d) for _ in range(3))
        for row in x:
            one.add(row)
        left.add_rows(x[:n // 2])
        right.add_rows(x[n // 2:])
        left.join(whitening.Spectrum.from_bytes(right.to_bytes(), d))
        scatter = x.T @ x
        for s in (one, left):
            assert np.abs(s.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * s.values[-1]
            assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
            assert np.abs(scatter @ s.vectors - s.vectors * s.values).max() < 1e-9 * s.values[-1]


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op11_embedding_whitening"](spark, sf).collect())


@pytest.mark.parametrize("dim", [1, 3, 11])
def test_many_partitions_and_small_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    monkeypatch.setattr(whitening, "FAN", 2)
    r = np.random.default_rng(dim)
    rows = [(i, (r.standard_normal(dim) * np.arange(1, dim + 1) + 5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    check(rows, whitening.whitened(df).collect())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [0.5, 3.0, -2.0]), (None, [0.0, 0.0, 0.0]), (4, [9.0, -1.0, 1.0])]
    odd = [(5, None), (6, [nan, 1.0, 1.0]), (7, [1.0, inf, 1.0]), (8, [1.0, None, 1.0]), (9, [1.0, 2.0]), (10, []), (11, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in good + odd], "vec_id long, embedding array<float>, whitened double")
    got = whitening.whitened(df).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in got if r.component == 1) == [(False, 1), (False, 1), (False, 2), (False, 4), (True, None)]
    check(good, got)
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(df.where("vec_id in (5, 6)")).count() == 0


def test_no_variance_and_large_entries(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = whitening.whitened(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and {r.explained for r in got if r.component == 2} == {0.0}
    one = whitening.whitened(flat.where("vec_id = 3")).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in one] == [(None, 0, 0.0, 0.0)] * 2
    large = spark.createDataFrame([(1, [2.0 ** 37, 0.0]), (2, [-2.0 ** 37, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whitened(large).collect()}[1] is None

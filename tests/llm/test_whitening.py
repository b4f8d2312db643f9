from __future__ import annotations

import math

import numpy as np
import pytest

from dayglass.llm import whitening
from dayglass.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>, whitened string, _x int, n int"


def brute(rows, wanted=8):
    """The same from the whole covariance matrix, in NumPy."""
    kept = [(k, v) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = exact / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    explained = values / ((centred**2).sum() / n)
    return [k for k, _ in kept], n, (exact**2).sum(axis=1), centred @ axes / np.sqrt(values), explained


def check(got, rows, wanted=8):
    ids, n, deviation, whitened, explained = brute(rows, wanted)
    count = whitened.shape[1]
    assert len(got) == len(ids) * count
    want = sorted((str(k), int(d)) for k, d in zip(ids, deviation) for _ in range(count))
    assert sorted((str(r.vec_id), r.deviation) for r in got) == want
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    for c in range(count):
        own = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1)
        other = sorted((str(k), int(d), w) for k, d, w in zip(ids, deviation, whitened[:, c]))
        a, b = np.array([t[2] for t in own]), np.array([t[2] for t in other])
        sign = np.sign((a * b).sum()) or 1.0
        if len(set(ids)) == len(ids):
            assert np.abs(a - sign * b).max() < 1e-9
        else:
            assert np.abs(np.sort(a) - np.sort(sign * b)).max() < 1e-9
        assert all(r.explained == pytest.approx(explained[c], rel=1e-12) for r in got if r.component == c + 1)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op11_embedding_whitening"](spark, sf).collect(), rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [4, 3, 2, 1, 0.5])], "w", i, 1) for i in range(60)]
    rows += [rows[0], rows[0], (None, [0.5] * 5, "no id", 1, 1)]
    rows += [(70, None, "", 1, 1), (71, [1.0, None, 1.0, 1.0, 1.0], "", 1, 1), (72, [math.nan] + [1.0] * 4, "", 1, 1)]
    rows += [(73, [1.0] * 4 + [-math.inf], "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(whitening.by_component(whitening.whiten(df)).collect(), rows)
    check(whitening.by_component(whitening.whiten(df, components=2)).collect(), rows, 2)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 0")).count() == 0  # equal vectors vary nowhere


def test_directions_without_variance_give_no_component(spark):
    rng = np.random.default_rng(4)
    flat = [(i, [*map(float, rng.normal(0, 3, 2)), 1.0, 2.0], "", 0, 0) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(got) == 30 and all(len(r.whitened) == 2 and sum(r.explained) == pytest.approx(1) for r in got)


def test_refused(spark):
    with pytest.raises(ValueError, match="unlike"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], "", 0, 0), (2, [1.0, 2.0], "", 0, 0)], SCHEMA))
    with pytest.raises(OverflowError):
        whitening.whiten(spark.createDataFrame([(i, [2e15, 1.0], "", 0, 0) for i in range(2)], SCHEMA))


@pytest.mark.parametrize(("seed", "size"), [(0, 3), (1, 9), (2, 40), (3, 120)])
def test_components_reach_double_precision(seed, size):
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = np.sort(rng.uniform(1, 2, size))[::-1] * np.where(np.arange(size) < 2, 100, 1)
    matrix = (axes * values) @ axes.T
    passes = []

    def multiply(vectors):
        passes.append(vectors.shape[1])
        return matrix @ vectors

    found, vectors = whitening.leading_components(multiply, size, 8)
    wanted = min(8, size)
    assert np.abs(found - values[:wanted]).max() < 1e-13 * values[0]
    assert np.abs(matrix @ vectors - vectors * found).max() < size * 1e-15 * values[0] * 32
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    assert len(passes) < 250


def test_equal_eigenvalues():
    matrix = np.diag([5.0] * 12 + [1.0] * 20)
    values, vectors = whitening.leading_components(lambda v: matrix @ v, 32, 8)
    assert np.abs(values - 5).max() < 1e-13 and np.abs(vectors[12:]).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    matrix, right = (axes * np.linspace(-3, 4, 30)) @ axes.T, rng.normal(size=30)
    solver = whitening.minres(right, 200, 1e-13)
    image = None
    try:
        while True:
            image = matrix @ solver.send(image)
    except StopIteration as done:
        assert np.abs(matrix @ done.value - right).max() < 1e-9
    with pytest.raises(StopIteration):  # nothing to solve
        next(whitening.minres(np.zeros(3), 5, 0.1))

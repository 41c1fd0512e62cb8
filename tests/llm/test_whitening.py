from fractions import Fraction

import numpy as np
import pytest

from aislemetrics.llm import vectors, whitening
from aislemetrics.llm.queries import QUERIES
from aislemetrics.session import materialise


def upper(rng, n):
    return np.linalg.qr(rng.standard_normal((3 * n + 2, n)), mode="r")


def matrices():
    rng = np.random.default_rng(5)
    q, p = (np.linalg.qr(rng.standard_normal((48, 48)))[0] for _ in range(2))
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 12) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    few = rng.standard_normal((6, 30))
    yield from (upper(rng, n) for n in (1, 2, 3, 40))
    yield np.eye(7)
    yield q  # one value, 48 times
    yield q * np.repeat([5, 4, 3, 1e-5], 12) @ p  # four clusters
    yield np.linalg.cholesky(wilkinson).T  # pairs alike to rounding
    yield np.diag(10.0 ** -np.arange(12)) @ np.linalg.qr(rng.standard_normal((12, 12)))[0]
    yield upper(rng, 30) * (np.arange(30) % 7 != 0)  # constant columns
    yield np.vstack([np.linalg.qr(few - few.mean(axis=0), mode="r"), np.zeros((24, 30))])  # fewer rows than columns


@pytest.mark.parametrize("matrix", list(matrices()), ids=str)
def test_singular_triples(matrix):
    a, b, right = whitening.bidiagonal(matrix)
    values = whitening.singular_values(a, b)
    theirs = np.linalg.svd(matrix, compute_uv=False)
    assert np.abs(values - theirs).max() <= 1e-14 * theirs[0]
    count = int((values > 1e-13 * values[0]).sum())
    z = right @ whitening.right_vectors(a, b, values, count)
    assert np.abs(z.T @ z - np.eye(count)).max() < 1e-11
    assert np.abs(matrix.T @ (matrix @ z) - z * values[:count] ** 2).max() < 1e-13 * theirs[0] ** 2


def test_small_values_to_relative_accuracy():
    a, b = 10.0 ** -np.arange(0, 60, 4), 0.3 * 10.0 ** -np.arange(0, 56, 4)
    values = whitening.singular_values(a, b)
    assert np.isclose(np.prod(values / 10.0 ** -np.arange(0, 60, 4)), 1.0, rtol=1e-12)  # the product is the determinant's


def brute(embeddings):
    """Deviation of every vector, covariance and centred vectors, all from exact fractions."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in embeddings]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    return deviation, centred.T @ centred / n, centred


def test_query_against_numpy(spark, folder):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = sorted(source)
    deviation, covariance, centred = brute([source[i] for i in ids])
    rows = QUERIES["op13_whitening"](spark, folder).collect()
    assert len(rows) == 32 * len(ids) and {r.n for r in rows} == {len(ids)}
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    white = np.zeros((len(ids), 32))
    place = {i: n for n, i in enumerate(ids)}
    for r in rows:
        assert r.deviation == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        white[place[r.vec_id], r.component - 1] = r.whitened
    theirs = centred @ directions[:, :32] / np.sqrt(values[:32])
    theirs *= np.sign((theirs * white).sum(axis=0))
    assert np.abs(white - theirs).max() < 1e-8


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 5.0]),
        (1, [1.0, 2.0, 5.0]),
        (None, [0.5, -1.0, 5.0]),
        (2, [0.25, 0.0, 5.0]),
        (3, None),
        (4, []),
        (5, [1.0, None, 5.0]),
        (6, [nan, 1.0, 5.0]),
        (7, [1.0, -inf, 5.0]),
        (8, [1.0, 2.0]),
        (9, [1e30, 2.0]),
    ]
    rows = [(*row, 7, "x", 1.0) for row in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, part string, whitened double")
    got = whitening.whitened_components(frame)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    made = got.collect()
    # The third entry is constant, so there are two components; the deviations are those of the four vectors that remain.
    deviation, _, _ = brute([[1.0, 2.0, 5.0], [1.0, 2.0, 5.0], [0.5, -1.0, 5.0], [0.25, 0.0, 5.0]])
    found = sorted(((r.vec_id or 0), r.component, int(r.deviation)) for r in made)
    ids = [1, 1, 0, 2]
    assert found == sorted((i, c, d) for i, d in zip(ids, deviation, strict=True) for c in (1, 2))
    assert {r.n for r in made} == {4} and sum({r.explained for r in made}) == pytest.approx(1)
    assert whitening.whitened_components(frame.limit(0)).collect() == []
    assert whitening.whitened_components(frame.where("vec_id = 2")).collect() == []  # one row has no variance
    with pytest.raises(Exception, match="beyond"):
        whitening.whitened_components(frame.where("vec_id = 9")).collect()


def test_tree_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((1_500, 5)) @ rng.standard_normal((5, 5)) + 1_000
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    spread = materialise(frame.repartition(3 * vectors.FAN + 5), "spread")
    model = whitening.fit(frame.repartition(3 * vectors.FAN + 5), components=5)
    whole = np.floor(64 * data)
    values = np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1]
    assert model.n == 1_500 and np.allclose(model.variances, values, rtol=1e-9)
    assert whitening.identity_error(whitening.whiten(spread, model)) < 1e-10


def test_deviation_beyond_a_long(spark):
    frame = spark.createDataFrame([(1, [9e8]), (2, [-9e8]), (3, [0.0])], "vec_id long, embedding array<double>")
    made = {r.vec_id: int(r.deviation) for r in whitening.whitened_components(frame).collect()}
    x = [int(c * 64) + 1_000_000 for c in (9e8, -9e8, 0)]
    assert made == {i + 1: (3 * c - sum(x)) ** 2 for i, c in enumerate(x)} and max(made.values()) > 2**63

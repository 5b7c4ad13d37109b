import numpy as np
import pytest

from docmeter.llm import whitening


def _reference(rows):
    x = np.array([np.floor(1024 * np.array(v, float)) + 100000 for _, v in rows])
    n = len(x)
    value, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    value, vectors = value[::-1][:8], vectors[:, ::-1][:, :8]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    return n, value, value / np.trace(np.cov(x.T, bias=True).reshape(x.shape[1], -1)), (x - x.mean(axis=0)) @ vectors / np.sqrt(value), deviation


def _check(spark, rows, extra=()):
    table = spark.createDataFrame([(i, v, "x") for i, v in [*rows, *extra]], "vec_id long, embedding array<double>, component string").repartition(3)
    got = {(r.vec_id, r.component): r for r in whitening.whitened_components(table).collect()}
    with np.errstate(invalid="ignore"):
        n, value, explained, whitened, deviation = _reference(rows)
    k = int((value > 1e-12 * value[0]).sum())
    assert set(got) == {(i, c) for i, _ in rows for c in range(1, k + 1)}
    ours = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i, _ in rows])
    ours *= np.sign((ours * whitened[:, :k]).sum(axis=0))
    np.testing.assert_allclose(ours, whitened[:, :k], rtol=0, atol=1e-8)
    for j, (i, _) in enumerate(rows):
        assert all((r.n, r.deviation) == (n, deviation[j]) and abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for c in range(1, k + 1) for r in [got[i, c]])


def test_against_whole_eigendecomposition(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=48) * np.geomspace(1, 0.2, 48)).tolist()) for i in range(300)]
    bad = [(900, None), (901, []), (902, [float("nan")] * 48), (903, [float("inf")] + [0.0] * 47), (904, [None] + [0.0] * 47), (905, [1e300] * 48), (906, [1.0, 2.0])]
    _check(spark, rows, bad)


def test_few_dimensions_copies_and_large_numbers(spark):
    draw = np.random.default_rng(2)
    _check(spark, [(i, draw.normal(size=3).tolist()) for i in range(40)])
    once = draw.normal(size=(5, 6))
    _check(spark, [(i, once[i % 5].tolist()) for i in range(60)])  # no variance beyond four components
    far = [(i, (1e6 + draw.normal(size=2)).tolist()) for i in range(50)]
    _check(spark, far)


def test_degenerate_tables(spark):
    make = lambda rows: whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        got = make(rows)
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    repeated = make([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [3.0, 3.0])]).collect()
    assert sorted((r.vec_id or 0, r.component) for r in repeated) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [0.0]), (1, [3e12]), (2, [0.001])]
    got = {r.vec_id: r.deviation for r in whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: None, 1: None, 2: None}


def test_subspace_is_certified_with_a_flat_spectrum():
    draw = np.random.default_rng(3)
    basis = np.linalg.qr(draw.normal(size=(400, 400)))[0]
    value = np.concatenate([np.linspace(1.1, 1.001, 8), np.linspace(1, 0.5, 392)])
    matrix = (basis * value) @ basis.T
    passes = []
    got, q = whitening.subspace(lambda b: passes.append(1) or matrix @ b, 400, 8)
    np.testing.assert_allclose(got, value[:8], rtol=1e-12)
    np.testing.assert_allclose(np.abs(q.T @ basis[:, :8]), np.eye(8), atol=1e-8)
    assert len(passes) < 400


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6])
def test_subspace_does_not_depend_on_scale(scale):
    matrix = np.diag(np.geomspace(1, 1e-6, 80)) * scale
    got, _ = whitening.subspace(lambda b: matrix @ b, 80, 8)
    np.testing.assert_allclose(got, np.geomspace(1, 1e-6, 80)[:8] * scale, rtol=1e-10)

import numpy as np

from docmeter.llm import neighbours as nb


def _brute(rows, every, nearest):
    out = []
    good = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for k, i, v in good:
        if i % every == 0:
            near = sorted((float(nb.distances(v[None], w[None])[0]), j) for m, j, w in good if m != k and len(w) == len(v))
            out += [(i, r, j, d) for r, (d, j) in enumerate(near[:nearest], 1)]
    return sorted(out, key=repr)


def _run(spark, rows, **how):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, row int").repartition(4)
    return sorted((tuple(r) for r in nb.nearest_vectors(table, **how).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_chi_square_quantiles():
    for p, m, value in ((0.95, 2, 5.991), (0.95, 10, 18.307), (0.99, 16, 32.000), (0.5, 4, 3.357)):
        assert abs(nb.chi_square_quantile(p, m) - value) < 1e-3


def test_small_tables_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(60)] + [(i, [1.0, 2.0]) for i in range(100, 104)]
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (None, [1.0] * 5), (206, [None] + [1.0] * 4), (20, [0.5] * 5)]
    assert _run(spark, rows, queries_every=10, nearest=4) == _brute(rows, 10, 4)
    for few in ([], [(0, [1.0])], [(0, [1.0]), (5, [1.0, 2.0])]):
        assert _run(spark, few, queries_every=5) == []
    assert _run(spark, [(0, [1.0]), (7, [3.0])], queries_every=5) == [(0, 1, 7, 2.0)]


def test_copies_and_ties_take_the_smallest_ids(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(400)] + [(1000 + i, [0.0, 1.0, 0.0]) for i in range(5)] + [(2000 + i, draw.normal(size=3).tolist()) for i in range(40)]
    assert _run(spark, rows, queries_every=20) == _brute(rows, 20, 10)
    axes = [(10 * s + k, [float(s) if j == k else 0.0 for j in range(6)]) for k in range(6) for s in (1, 2)] + [(0, [1e-300] * 6), (100, [1e200] * 6)]
    assert _run(spark, axes, queries_every=10, nearest=6) == _brute(axes, 10, 6)


def test_vectors_far_from_the_origin(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (1e7 + draw.normal(size=8)).tolist()) for i in range(300)]
    assert _run(spark, rows, queries_every=30) == _brute(rows, 30, 10)


def test_many_cells_and_blocks_reach_the_promised_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 200)
    monkeypatch.setattr(nb, "PART_QUERIES", 7)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + 0.4 * draw.normal(size=24)).tolist()) for i in range(2500)] + [(5000 + i, [0.1] * 24) for i in range(900)]
    got, want = _run(spark, rows, queries_every=25, cell_rows=600), _brute(rows, 25, 10)
    assert len(got) == len(want)
    found = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(found) >= 0.97 * len(want)


def test_the_test_stops_the_search():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 32))
    v = centres[np.arange(8000) % 40] + 0.1 * draw.normal(size=(8000, 32))
    p = nb.projected(v).astype(float)
    block = nb.Block(v, p, np.ones(len(v), int), 11, nb.CERTAINTY)
    at, far = block.search(v[:50], p[:50], np.full(50, np.inf))
    whole = np.sqrt(((v[:50, None] - v[None]) ** 2).sum(axis=2))
    want = np.argsort(whole, axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at.tolist(), want.tolist(), strict=True)]) >= 0.98 * 11
    assert block.verified < 0.1 * 50 * len(v) and (np.diff(far, axis=1) >= 0).all()

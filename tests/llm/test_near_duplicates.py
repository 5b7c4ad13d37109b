import math
import random
from itertools import combinations

import numpy as np
import pytest

from docmeter.llm import minhash, pivots
from docmeter.llm.components import connected_components
from docmeter.llm.hot import join_by_key
from tests.llm.brute import components, shingles

SCHEMA = "doc_id long, text string, lang string, doc_id_2 string, shingles string"


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out = [None, "", " \n\t ", "one", "One", "two words", "TWO  words", "a b c d", "a b c d e", "A B C D E", "ß ẞ É é x y"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 12, 30, 120]))]
        for k in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own) if k % 3 else " ".join(own).upper())
    hot = [word() for _ in range(150)]  # many near copies around the threshold, of which some link and some don't
    for _ in range(120):
        own = list(hot)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    return out + [" ".join(word() for _ in range(30_000))] + out[20:30]


def test_minhash_equals_all_pairs(spark):
    texts = _texts()
    rows = [(1000 - 3 * i, t, "x", "clash", "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a, b in combinations([i for i, s in sets.items() if s], 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_minhash_repeated_rows_and_empty_table(spark):
    text = "repeated words stand in this short line of text"
    rows = [(1, text, None, None, None)] * 3 + [(2, text, None, None, None), (1, "another text altogether under the same id here", None, None, None), (None, "no id for this one but words", None, None, None)]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 1, True)] * 4 + [("2", 1, False), ("None", None, True)]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    rows += [(None, "No id for this one but words", None, None, None), (None, text, None, None, None)]
    got = minhash.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang", "doc_id_2", "shingles"]
    assert sorted((str(r.doc_id), r.text.lower()) for r in got.collect()) == [("1", rows[4][1]), ("1", text), ("None", rows[5][1])]


def test_intersections_of_sets():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 30_000, n).astype(np.uint64)) for n in (0, 1, 9_000, 20_000, 5_000)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = minhash._intersections(sets)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_key_equals_join(spark, how):
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(400)] + [(50, k) for k in range(900)], "key long, v long")
    per_key = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 50, 60)], "key long, name string")
    want = sorted(map(str, rows.join(per_key, "key", how).select("key", "v", "name").collect()))
    assert sorted(map(str, join_by_key(rows, per_key, ["key"], ["v"], how).select("key", "v", "name").collect())) == want


def test_crowded_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    test_minhash_equals_all_pairs(spark)


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    both, a, b = (draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    agree = (minhash.signature(np.concatenate([both, a])) == minhash.signature(np.concatenate([both, b]))).mean()
    assert abs(agree - 0.75) < 0.1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {51: 50}
    assert connected_components(links.limit(0)).count() == 0


def _vectors():
    draw, out, n = np.random.default_rng(3), [], 0
    for label in (1, 2):
        for _ in range(12):
            base = draw.normal(size=16)
            for _ in range(int(draw.integers(1, 9))):
                n += 1
                out.append((n * 7, (base + draw.normal(size=16) * draw.choice([0, 0.05, 0.1, 0.14])).tolist(), label, "x"))
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, out[0][1][:8]]
    out += [(2000 + i, v, 1, "x") for i, v in enumerate(odd)] + [(3000, out[0][1], None, "x"), (3001, out[0][1], None, "x"), (3002, out[1][1], out[1][2], "x")]
    return out


@pytest.mark.parametrize("options", [{}, {"blocks": (8, 8)}, {"vectors_a_pivot": 1}])
def test_pivots_equal_all_pairs(spark, options):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, pivots string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicate_vectors(frame, **options).collect()}
    usable = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for a, b in combinations(usable, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a[0], b[0]))
    want = components([r[0] for r in rows], links)
    assert got == {i: (sum(i in x for x in links), c, c == i) for i, c in want.items()}
    assert pivots.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vectors_of_extreme_size_and_repeated_ids(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [1e200, 1.0000001e200], "a"), (3, [1e-200, 1e-200], "a"), (4, [-1e-200, 1e-200], "a"), (4, [1.0, 1.01], "a"), (5, [-1.0, 1.0], "a"), (None, [-1.0, 1.0], "a"), (None, [3.0, 1.0], "a")]
    got = pivots.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 4), (4, 3, 1), (5, 1, 4)]
    assert sorted(r.component_id or 0 for r in got if r.vec_id is None) == [0, 4]


@pytest.mark.parametrize("d", [2, 16, 64, 768])
@pytest.mark.parametrize("number", [128, 4096])
def test_pivot_recall_at_the_threshold(d, number):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=(2000, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    near = [pivots.nearest_pivots(v, pivots._pivots_for(d, number)) for v in (x, y)]
    shared = np.array([len(set(a) & set(b)) for a, b in zip(*map(np.ndarray.tolist, near), strict=True)])
    assert (shared >= 1).all() and np.mean(shared >= 2) > 0.998


def _crowded(n, dimension):
    draw = np.random.default_rng(7)
    centre = draw.normal(size=dimension)
    near = centre / np.linalg.norm(centre) + 0.2 * draw.normal(size=(n // 2, dimension)) / math.sqrt(dimension)
    return np.concatenate([near, draw.normal(size=(n - n // 2, dimension))])


def _link_counts(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("crowded", [pivots.CROWDED, math.inf])
def test_pivots_find_all_of_a_group_that_is_half_the_table(spark, monkeypatch, crowded):
    monkeypatch.setattr(pivots, "CROWDED", crowded)  # inf: by pivot lists only
    x = _crowded(1200, 64)
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicate_vectors(frame, blocks=(256, 256)).collect()}
    want = _link_counts(x)
    assert sum(want) > 300_000 and [got[i] for i in range(len(x))] == want


def test_pivots_find_all_in_two_dimensions(spark):
    x = np.random.default_rng(2).normal(size=(400, 2))
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicate_vectors(frame).collect()}
    assert [got[i] for i in range(len(x))] == _link_counts(x)

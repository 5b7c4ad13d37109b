import difflib
import random

from docmeter.operators import fuzzy


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def _texts(seed, n, size, letters="ABCDE -"):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(size)) for _ in range(n)]


def _changed(text, changes, seed):
    draw, out = random.Random(seed), list(text)
    for _ in range(changes):
        k = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[k] = "x"
        elif kind == 1:
            out.insert(k, "y")
        elif len(out) > 5:
            del out[k]
    return "".join(out)


def test_windows_equal_brute_force():
    for seed in range(60):
        source = _texts(seed, 1, 260)[0]
        at, n = seed * 3 % 180, 12 + seed % 50
        excerpt = _changed(source[at : at + n], seed % 9, seed)
        windows = range(len(source) - len(excerpt) + 1)
        passing = {i for i in windows if _ratio(excerpt, source[i : i + len(excerpt)]) >= 0.9}
        assert passing <= set(fuzzy.candidate_windows(excerpt, source, 0.9).tolist())
        assert fuzzy.window_matches(excerpt, source) == bool(passing)
    assert not fuzzy.window_matches("longer than the source", "short") and not fuzzy.window_matches("", "source")


def test_few_windows_are_compared():
    source = "\n".join(f"MOVE WS-FIELD-{k} TO WS-OTHER-{k * 7 % 13}." for k in range(400))
    excerpt = source[5000:5100].replace("OTHER", "OTTER", 1)
    ratio = fuzzy.Ratios()
    assert fuzzy.window_matches(excerpt, source, ratio=ratio) and ratio.computed <= 3
    ratio = fuzzy.Ratios()
    assert not fuzzy.window_matches("PERFORM 100-INIT THRU 900-EXIT UNTIL DONE", source, ratio=ratio) and ratio.computed == 0


def test_lines_equal_brute_force():
    for seed in range(40):
        source = _texts(seed, 12, 14)
        excerpt = [_changed(source[(seed + k) % 12], k % 5, seed * 7 + k) for k in range(6)]
        hits = sum(any(x in y or _ratio(x, y) >= 0.85 for y in source) for x in excerpt)
        assert fuzzy.lines_match(excerpt, source) == (hits / 6 >= 0.8)
    assert not fuzzy.lines_match([], ["A"])


def test_best_ratio_equals_brute_force_and_computes_only_what_can_win():
    for seed in range(40):
        others = _texts(seed, 25, 18) + [_changed(t, 4, seed) for t in _texts(seed + 100, 3, 18)]
        text = _changed(others[seed % 28], seed % 8, seed)
        ratio = fuzzy.Ratios()
        best = max(_ratio(text, o) for o in others)
        found = fuzzy.best_ratio(text, others, 0.6, ratio)
        assert found == (best if best >= 0.6 else None)
        bounds = fuzzy._bounds(text, others, fuzzy._counts(others))
        assert ratio.computed <= sum(bounds >= max(0.6, found or 0) - 1e-9)
    assert fuzzy.best_ratio("text", [], 0.6) is None


def test_excerpts_of_any_kind(spark):
    source = "       MAIN-PARA.\n           MOVE A TO B.\n           STOP RUN."
    rows = [(1, "move a   to b."), (1, ""), (1, None), (1, "MOVE A TO C. STOP RUN"), (1, "COMPLETELY DIFFERENT WORDS"), (2, "anything"), (3, "x" * 500)]
    excerpts = spark.createDataFrame([(k, i, c, "x") for i, (k, c) in enumerate(rows)], "program long, nth int, code string, source string")
    sources = spark.createDataFrame([(1, source), (2, None), (3, "short")], "program long, source string")
    got = {r.nth: r.way for r in fuzzy.matched_excerpts(excerpts, sources).collect()}
    assert got == {0: "exact", 1: "exact", 2: "exact", 3: "window", 4: None, 5: None, 6: None}
    assert fuzzy.matched_excerpts(excerpts.limit(0), sources).count() == 0


def test_resembling_parts_equal_brute_force():
    for seed in range(60):
        words = " ".join(_texts(seed, 3, 40, "ab c")).split()
        text = _changed(" ".join(words[-(seed % 9 + 1) :]), seed % 4, seed)
        n = len(text)
        windows = [" ".join(words[i : i + n // 2]) for i in range(len(words) - n // 4)]
        assert fuzzy.resembles_part(text, words) == any(_ratio(text, w) >= 0.8 for w in windows)
    assert not fuzzy.resembles_part("", ["a"]) and not fuzzy.resembles_part("abcd", [])

import random
from collections import Counter

from docmeter.operators import rouge as rg


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
        "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
        "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controlling": "control", "rolling": "roll", "calculates": "calcul", "dying": "die", "enjoy": "enjoy",
    }
    assert {w: rg.stemmed(w) for w in known} == known


def _table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def _places(a, b):
    t, i, j, out = _table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j, out = i - 1, j - 1, [i - 1, *out]
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _brute(reference, candidate):
    a, b = rg.stems(reference), rg.stems(candidate)
    f = lambda hits, n, m: 0.0 if not hits else 2 * (hits / m) * (hits / n) / (hits / m + hits / n)
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    out = {f"rouge_{n}": f(sum((grams(a, n) & grams(b, n)).values()), max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)}
    out["rouge_l"] = f(_table(a, b)[-1][-1], len(a), len(b))
    left, right = Counter(a), Counter(b)
    hits = 0
    for line in reference.split("\n"):
        own = rg.stems(line)
        for i in sorted(set().union(*[set(_places(own, rg.stems(x))) for x in candidate.split("\n")])):
            if left[own[i]] > 0 and right[own[i]] > 0:
                left[own[i]], right[own[i]], hits = left[own[i]] - 1, right[own[i]] - 1, hits + 1
    out["rouge_lsum"] = f(hits, len(a), len(b))
    return out


def _text(seed):
    draw = random.Random(seed)
    words = ["compute", "Computing", "totals", "the", "a", "of", "line-12", "paying", "paid", "é", "x"]
    return "\n".join(" ".join(draw.choices(words, k=draw.randint(0, 7))) for _ in range(draw.randint(0, 5)))


def test_measures_equal_brute_force(spark):
    rows = [(i, _text(i), _text(1000 + i // 2)) for i in range(80)] + [(90, None, "a"), (91, "", ""), (92, "same words here", "same words here")]
    got = {r.i: r.rouge for r in rg.rouge(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b").collect()}
    for i, a, b in rows:
        want = _brute(a or "", b or "")
        assert all(abs(got[i][k].f - v) < 1e-9 for k, v in want.items()), (a, b)
        assert abs(got[i].average - sum(want.values()) / 4) < 1e-9


def test_common_places_of_long_texts():
    draw = random.Random(5)
    for _ in range(20):
        a, b = (draw.choices("abcde", k=draw.randint(0, 120)) for _ in range(2))
        assert rg.common_places(a, b) == _places(a, b)

"""Recall-oriented overlap of texts: unigrams, bigrams, longest common subsequences of whole texts and of their lines, on stems."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docmeter.functions.text import as_column

# Irregular words, and the suffixes of the stemmer's steps with what they become.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning",
    "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# End of fixed values.

MEASURES = ("rouge_1", "rouge_2", "rouge_l", "rouge_lsum")


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """Vowel runs that a consonant run follows."""
    return len(re.findall("v+c+", _shape(stem)))


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The first rule whose suffix fits decides: its stem's measure has to be over ``least``."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _participle(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
    if stem is None:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem


def _second(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-4] + "al")
    if word.endswith("logi") and not any(word.endswith(s) for s, _ in SECOND):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replaced(word, SECOND, 0)


def _fourth(word: str) -> str:
    for suffix in FOURTH:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if suffix == "ion" and stem[-1:] not in ("s", "t"):
                return word
            return stem if _measure(stem) > 1 else word
    return word


@lru_cache(maxsize=1 << 16)
def stemmed(word: str) -> str:
    """A lower-case word's stem by the suffix-stripping rules of Porter with common extensions; short words stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _participle(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _fourth(_replaced(_second(word), THIRD, 0))
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _closed(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased; those of over three characters as stems."""
    return [stemmed(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())]


def common_places(reference: list[str], candidate: list[str]) -> list[int]:
    """Places in the reference of one longest common subsequence, chosen from the ends.

    Row by row, one integer holds by bits where the length of the common subsequence grows along the candidate.
    """
    places: dict[str, int] = {}
    for j, t in enumerate(candidate):
        places[t] = places.get(t, 0) | 1 << j
    whole = (1 << len(candidate)) - 1
    rows = [whole]
    for t in reference:
        row, hit = rows[-1], rows[-1] & places.get(t, 0)
        rows.append(((row + hit) | (row - hit)) & whole)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(reference), len(candidate)
    while i and j:
        if reference[i - 1] == candidate[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out[::-1]


def _f(hits: int, reference: int, candidate: int) -> tuple[float, float, float]:
    """Precision, recall and F-measure."""
    p, r = (hits / candidate if candidate else 0.0), (hits / reference if reference else 0.0)
    return p, r, (2 * p * r / (p + r) if p + r > 0 else 0.0)


def _clipped(a: list, b: list) -> int:
    return sum((Counter(a) & Counter(b)).values())


def line_overlap(reference: list[list[str]], candidate: list[list[str]]) -> tuple[float, float, float]:
    """Each reference line's union of common subsequences with all candidate lines, each word at most as often as either
    text has it."""
    left, right = Counter(t for x in reference for t in x), Counter(t for x in candidate for t in x)
    n, m, hits = sum(left.values()), sum(right.values()), 0
    for line in reference:
        for i in sorted({i for other in candidate for i in common_places(line, other)}):
            if left[line[i]] > 0 and right[line[i]] > 0:
                left[line[i]] -= 1
                right[line[i]] -= 1
                hits += 1
    return _f(hits, n, m)


def overlaps(reference: str, candidate: str) -> dict[str, tuple[float, float, float]]:
    """Precision, recall and F-measure of each of MEASURES."""
    a, b = stems(reference), stems(candidate)
    pairs = lambda x: list(zip(x, x[1:], strict=False))
    lined = lambda t: [s for s in map(stems, t.split("\n")) if s]
    return {
        "rouge_1": _f(_clipped(a, b), len(a), len(b)), "rouge_2": _f(_clipped(pairs(a), pairs(b)), max(0, len(a) - 1), max(0, len(b) - 1)),
        "rouge_l": _f(len(common_places(a, b)), len(a), len(b)), "rouge_lsum": line_overlap(lined(reference), lined(candidate)),
    }


_PARTS = ("precision", "recall", "f")
_KIND = StructType([*[StructField(k, StructType([StructField(p, DoubleType()) for p in _PARTS])) for k in MEASURES], StructField("average", DoubleType())])


@F.pandas_udf(_KIND)
def _overlaps(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    rows = [overlaps(x or "", y or "") for x, y in zip(reference, candidate, strict=True)]
    columns = {k: [dict(zip(_PARTS, r[k], strict=True)) for r in rows] for k in MEASURES}
    return pd.DataFrame(columns | {"average": [sum(r[k][2] for k in MEASURES) / len(MEASURES) for r in rows]})


def rouge(pairs: DataFrame, reference: str, candidate: str, out: str = "rouge") -> DataFrame:
    """Pairs of texts with a struct of MEASURES, each with precision, recall and F-measure, and the F-measures' ``average``.

    Null texts are empty; where a text is empty all are 0. A row's work grows with the product of its two texts' lengths over
    the bits of a machine word; nothing is shuffled.
    """
    return pairs.withColumn(out, _overlaps(as_column(reference), as_column(candidate)))

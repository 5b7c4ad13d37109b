"""Texts that nearly match: excerpts within sources and rules among sentences, by the ratio of matching blocks.

The ratio is dear. It's twice the characters in matching blocks over all characters, so lengths, shared characters and shared
runs of characters bound it; it is computed only for pairs whose bounds reach what is asked.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from docmeter.functions.reports import comments
from docmeter.functions.text import as_column
from docmeter.operators.ranges import shuffled

#: Length of the character runs that candidates for a window share with an excerpt.
RUN = 3
_EPS, _TABLE = 1e-9, 1 << 20


class Ratios:
    """Ratios of matching blocks, and how many were computed."""

    def __init__(self) -> None:
        self.computed = 0

    def __call__(self, a: str, b: str) -> float:
        self.computed += 1
        return _ratio(a, b)


@lru_cache(maxsize=1 << 14)
def _ratio(a: str, b: str) -> float:
    """Lines recur from program to program; the last pairs are remembered."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def _counts(texts: list[str]) -> np.ndarray:
    """Characters of each text in 128 bins; bins that characters share only raise the bound. All texts are counted at once."""
    place = np.repeat(np.arange(len(texts)) * 128, [len(t) for t in texts])
    return np.bincount(place + (_codes("".join(texts)) & 127), minlength=128 * len(texts)).reshape(len(texts), 128)


def _bounds(text: str, others: list[str], counts: np.ndarray) -> np.ndarray:
    """What the ratio of a text with each of the others can be at most."""
    total = len(text) + np.array([len(x) for x in others], np.int64)
    shared = np.minimum(_counts([text]), counts).sum(axis=1)
    return np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)


def candidate_windows(excerpt: str, source: str, least: float) -> np.ndarray:
    """Starts of the source's windows of the excerpt's length whose ratio may reach ``least``, the likeliest first.

    With a share ``least`` of the excerpt in matching blocks, U = length * (1 - least) characters of either text are
    outside. Each of those breaks at most RUN runs of the excerpt, and each gap between blocks RUN - 1 more: the window
    holds all but U * (2 * RUN - 1) of the excerpt's runs. What passes is bounded by its shared characters.
    """
    x, y = _codes(excerpt), _codes(source)
    n, windows = len(x), len(y) - len(x) + 1
    if n == 0 or windows <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(windows)
    need = n - RUN + 1 - int(n * (1 - least) + _EPS) * (2 * RUN - 1)
    if need > 0:
        known = np.append(0, np.cumsum(_stands_in(_runs(y), _runs(x))))
        at = np.flatnonzero(known[n - RUN + 1 :][:windows] - known[:windows] >= need)
    if not len(at):
        return at
    shared = np.zeros(len(at), np.int64)
    letters, most = np.unique(x, return_counts=True)
    # As many letters at once as a bounded table holds.
    for k in range(0, len(letters), step := max(1, _TABLE // len(y))):
        total = np.zeros((min(step, len(letters) - k), len(y) + 1), np.int32)
        np.cumsum(y == letters[k : k + step, None], axis=1, out=total[:, 1:])
        shared += np.minimum(most[k : k + step, None], total[:, at + n] - total[:, at]).sum(axis=0)
    some = shared >= n * least - _EPS
    return at[some][np.argsort(-shared[some], kind="stable")]


def _runs(codes: np.ndarray) -> np.ndarray:
    """Runs of RUN characters as numbers of 7 bits each; characters that share theirs make more windows candidates, not fewer."""
    low = codes & 127
    return sum(low[k : len(low) - RUN + 1 + k] << 7 * k for k in range(RUN))


#: Which runs the excerpt at hand has; cleared after each use.
_SEEN = np.zeros(1 << 7 * RUN, bool)


def _stands_in(runs: np.ndarray, of: np.ndarray) -> np.ndarray:
    _SEEN[of] = True
    found = _SEEN[runs]
    _SEEN[of] = False
    return found


def window_matches(excerpt: str, source: str, least: float = 0.90, ratio: Ratios | None = None) -> bool:
    """Whether some window of the excerpt's length has a ratio of ``least``."""
    ratio = ratio or Ratios()
    return any(ratio(excerpt, source[i : i + len(excerpt)]) >= least for i in candidate_windows(excerpt, source, least).tolist())


def best_ratio(text: str, others: list[str], least: float, ratio: Ratios | None = None) -> float | None:
    """The highest ratio of a text with any of the others, if it reaches ``least``; none is computed that cannot win."""
    ratio, best = ratio or Ratios(), None
    if not others:
        return None
    bound = _bounds(text, others, _counts(others))
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < (least if best is None else best) - _EPS or bound[k] <= (best or 0):
            break
        found = ratio(text, others[k])
        if found >= least and found > (best or 0):
            best = found
    return best


def lines_match(excerpt_lines: list[str], source_lines: list[str], least: float = 0.85, share: float = 0.80, ratio: Ratios | None = None) -> bool:
    """Whether a ``share`` of the excerpt's lines stands within lines of the source or has a ratio of ``least`` with one."""
    ratio, source_lines = ratio or Ratios(), list(dict.fromkeys(source_lines))
    if not excerpt_lines:
        return False
    counts, together, hits = _counts(source_lines), "\n".join(source_lines), 0
    for x in excerpt_lines:
        if x in together:
            hits += 1
            continue
        bound = _bounds(x, source_lines, counts)
        hits += any(ratio(x, source_lines[k]) >= least for k in np.argsort(-bound, kind="stable").tolist() if bound[k] >= least - _EPS)
    return hits / len(excerpt_lines) >= share


def code_excerpts(document: str | Column) -> Column:
    """Blocks of code that a report quotes."""
    return F.regexp_extract_all(F.coalesce(as_column(document), F.lit("")), F.lit(r"(?s)```(?:cobol)?\n(.*?)\n```"), 1)


def _squeezed(text: str | None) -> list[str]:
    """Lines with ASCII white space collapsed, and stripped from their ends."""
    return [b" ".join(x.split()).decode() for x in (text or "").encode().split(b"\n")]


def way(excerpt: list[str], source: list[str]) -> str | None:
    """How the squeezed lines of an excerpt match those of a source."""
    x, y = (" ".join(filter(None, t)) for t in (excerpt, source))
    return "exact" if x in y else "window" if window_matches(x, y) else "lines" if lines_match([t for t in excerpt if t], source) else None


@F.pandas_udf(ArrayType(StringType()))
def _ways(excerpts: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([[way(_squeezed(x), theirs) for x in own] for own, theirs in zip(excerpts, map(_squeezed, source), strict=True)], dtype=object)


def excerpt_ways(excerpts: Column, source: str | Column) -> Column:
    """``way`` of each of a source's excerpts, in the order of their array: exact, window (.90 of it in some window), lines
    (.80 of its lines at .85), or null.

    White space and case don't count. An empty excerpt stands in any source; one that is longer than its source has no
    window. Only windows and lines whose bounds reach what is asked are compared.
    """
    upper = lambda x: F.make_valid_utf8(F.upper(x))
    return _ways(F.transform(excerpts, upper), upper(as_column(source)))


def matched_excerpts(excerpts: DataFrame, sources: DataFrame, key: str = "program", code: str = "code", source: str = "source") -> DataFrame:
    """Excerpts with ``way``, as ``excerpt_ways`` has it, for excerpts that don't stand in a row with their source.

    An equi-join on the key; a source is compared with its own excerpts only.
    """
    rows = excerpts.join(shuffled(sources.select(key, F.col(source).alias("_source"))), key)
    return rows.withColumn("way", excerpt_ways(F.array(code), "_source")[0]).drop("_source")


@F.pandas_udf(DoubleType())
def _best(text: pd.Series, others: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else best_ratio(t, list(o), n) for t, o, n in zip(text, others, least, strict=True)], dtype="float64")


def documented_rules(rules: DataFrame, documents: DataFrame, key: str = "program", text: str = "document", keyword_share: float = 0.5, least: float = 0.6) -> DataFrame:
    """Rules (``description, keywords``) with ``keyword_ratio``, ``sentence_ratio`` and whether they are ``documented``.

    A rule is documented if the report has half of its keywords, or a sentence with a ratio of .6 with its description.
    The best sentence's ratio is looked for only where keywords don't settle it, and is null below .6. Sentences end at
    ``.!?`` and line feeds and have more than ten characters; a report's sentences meet its own program's rules only.
    """
    rows = rules.join(shuffled(documents.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))), key)
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.col("_low"), F.lower(k))))
    rows = rows.withColumn("keyword_ratio", F.coalesce(F.try_divide(hits, F.size("keywords")), F.lit(0.0)))
    settled = F.col("keyword_ratio") >= keyword_share
    sentences = F.filter(F.split("_low", r"[.!?\n]"), lambda s: F.length(F.trim(s)) > 10)
    best = _best(F.when(~settled, F.lower(F.coalesce("description", F.lit("")))), F.when(~settled, sentences), F.lit(least))
    rows = rows.withColumn("sentence_ratio", best)
    return rows.withColumn("documented", settled | F.coalesce(F.col("sentence_ratio") >= least, F.lit(False))).drop("_low")


def resembles_part(text: str, words: list[str], least: float = 0.8, ratio: Ratios | None = None) -> bool:
    """Whether a text has a ratio of ``least`` with some window of half as many words as it has characters.

    Windows begin at every word but the last quarter of that number, and are shorter towards the end. Only windows whose
    length, and then whose characters, let the ratio reach ``least`` are compared.
    """
    ratio, n = ratio or Ratios(), len(text)
    starts = np.arange(max(0, len(words) - n // 4))
    if not len(starts) or not n:
        return False
    ends = np.minimum(starts + n // 2, len(words))
    total = np.append(0, np.cumsum([len(w) + 1 for w in words]))
    size = np.maximum(total[ends] - total[starts] - 1, 0)
    some = np.flatnonzero(2.0 * np.minimum(size, n) / (size + n) >= least - _EPS)
    windows = [" ".join(words[starts[k] : ends[k]]) for k in some.tolist()]
    if not windows:
        return False
    bound = _bounds(text, windows, _counts(windows))
    return any(ratio(text, windows[k]) >= least for k in np.argsort(-bound, kind="stable").tolist() if bound[k] >= least - _EPS)


@F.pandas_udf(DoubleType())
def _parroted(comments_: pd.Series, low: pd.Series) -> pd.Series:
    out = []
    for own, text in zip(comments_, low, strict=True):
        own, words = ([] if own is None else list(own)), (text or "").split()
        copied = sum(1.0 if c in (text or "") else 0.5 if resembles_part(c, words) else 0.0 for c in own)
        out.append(min(1.0, copied / len(own)) if own else 0.0)
    return pd.Series(out)


def parroted_share(document: str | Column, source: str | Column, longer_than: int = 10) -> Column:
    """Share of the source's comments of over ten characters that a report copies: word for word, or by half if a part of it
    resembles them; 0 without any."""
    long = F.filter(comments(source), lambda c: F.length(F.trim(c)) > longer_than)
    return _parroted(F.transform(long, lambda c: F.lower(F.trim(c))), F.lower(F.coalesce(as_column(document), F.lit(""))))

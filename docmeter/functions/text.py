"""Text features of documents as Column expressions."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from docmeter.lexicons import DOCUMENT_WEIGHTS, Lexicon

_SPACE = r"\x20\x09-\x0D"
_VOWELS = re.compile("[aeiou]+")


def _word_class(unicode: bool) -> str:
    return r"\p{L}\p{N}_" if unicode else "A-Za-z0-9_"


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it within the functions of arrays."""
    return F.transform(F.array(value), f)[0]


def words(text: str | Column) -> Column:
    """Maximal runs without ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(as_column(text), F.lit("")), f"[{_SPACE}]+"), lambda w: w != "")


def lines(text: str | Column) -> Column:
    return F.split(as_column(text), "\n")


def syllables(word: Column) -> Column:
    """Vowel runs of a word over three characters, less a final e, plus a consonant before ``le``; one at least."""
    low = F.lower(word)
    runs = F.regexp_count(low, F.lit("[aeiou]+"))
    runs = F.when(low.endswith("e"), F.greatest(F.lit(1), runs - 1)).otherwise(runs)
    runs = runs + F.when(low.rlike("[^aeiou]le$"), 1).otherwise(0)
    return F.when(F.length(low) <= 3, 1).otherwise(F.greatest(F.lit(1), runs))


def plain(text: str | Column, unicode: bool = True) -> Column:
    """Text with anything but word characters, white space and full stops blanked."""
    return F.regexp_replace(F.coalesce(as_column(text), F.lit("")), f"[^{_word_class(unicode)}{_SPACE}.]", " ")


@lru_cache(maxsize=1 << 16)
def _word_syllables(word: bytes) -> int:
    """Syllables of a lower-case word, as ``syllables`` has them but that a final e counts if no other run stands before it."""
    word = word.decode()
    if len(word) <= 3:
        return 1
    runs = [m.end() for m in _VOWELS.finditer(word)]
    silent = len(runs) > 1 and word[-1] == "e"
    return max(1, len(runs)) - silent + (word.endswith("le") and word[-3] not in "aeiou")


@F.pandas_udf(LongType())
def syllable_sum(low: pd.Series) -> pd.Series:
    """Syllables of all words (split at ASCII white space) of lower-case texts; words recur, and the last ones are remembered."""
    return low.map(lambda t: None if t is None else sum(map(_word_syllables, t.encode().split())))


def readability(text: str | Column, lexicon: Lexicon | None = None, unicode: bool = True) -> Column:
    """Struct of ``words, sentences, syllables, grade`` (Flesch-Kincaid, in 0 to 20) and ``score``.

    Only full stops end sentences. The score is 1 inside the range of grades and falls by a penalty a grade outside;
    texts without words have .5.
    """
    lexicon = lexicon or Lexicon()
    low, high = lexicon.grade_range
    away = lambda g: F.greatest(F.lit(0.0), F.lit(low) - g, g - F.lit(high))
    count = lambda t, p: F.regexp_count(t, F.lit(p))
    t = F.lower(plain(text, unicode))
    counts = F.struct(count(t, r"\S+").alias("words"), F.greatest(F.lit(1), count(t, "[.]+")).alias("sentences"), syllable_sum(t).alias("syllables"))

    def scored(c: Column) -> Column:
        grade = F.greatest(F.lit(0.0), F.least(F.lit(20.0), 0.39 * c["words"] / c["sentences"] + 11.8 * c["syllables"] / F.greatest(F.lit(1), c["words"]) - 15.59))
        of_grade = lambda g: F.struct(c["words"].alias("words"), c["sentences"].alias("sentences"), c["syllables"].alias("syllables"), g.alias("grade"), F.when(c["words"] == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - away(g) * lexicon.grade_penalty)).alias("score"))
        return let(grade, of_grade)

    return let(counts, scored)


def section_share(text: str | Column, sections: dict[str, str]) -> Column:
    """Share of the section patterns that occur anywhere in the lower-cased text."""
    low = F.lower(F.coalesce(as_column(text), F.lit("")))
    return reduce(add, [low.rlike(p).cast("int") for p in sections.values()]) / float(len(sections))


def line_citations(text: str | Column, source_lines: Column | None = None) -> Column:
    """Struct of ``citations, valid, score`` of references like ``line 12`` or ``L3-9``.

    With source lines both ends have to lie in 1 to that number; without, ends of 10,000 or more count nowhere. No
    reference scores .5.
    """
    text = F.coalesce(as_column(text), F.lit(""))
    pattern = F.lit(rf"(?i)(?:line[{_SPACE}]*|L)([0-9]+)(?:[{_SPACE}]*-[{_SPACE}]*([0-9]+))?")
    ends = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("a"), F.regexp_extract_all(text, pattern, 2).alias("b"))
    number = lambda s: F.when(F.length(s) > 9, F.lit(999_999_999)).otherwise(F.try_to_number(F.lpad(s, 9, "0"), F.lit("999999999")).cast("int"))
    spans = F.transform(ends, lambda e: F.struct(number(e["a"]).alias("lo"), number(F.when(e["b"] == "", e["a"]).otherwise(e["b"])).alias("hi")))
    known = source_lines if source_lines is not None else F.lit(0)
    inside = lambda e, n: F.when(n > 0, e["lo"].between(1, n) & e["hi"].between(1, n)).otherwise((e["lo"] < 10_000) & (e["hi"] < 10_000))

    def counted(x: Column) -> Column:
        valid = F.size(F.filter(x["spans"], lambda e: inside(e, x["known"])))
        return F.struct(F.when(x["known"] > 0, F.size(x["spans"])).otherwise(valid).alias("citations"), valid.alias("valid"))

    scored = lambda c: F.struct(c["citations"].alias("citations"), c["valid"].alias("valid"), F.when(c["citations"] > 0, c["valid"] / c["citations"]).otherwise(0.5).alias("score"))
    return let(let(F.struct(spans.alias("spans"), known.alias("known")), counted), scored)


def plain_words(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which one stands in every match, the longest ones that the pattern tells; none if it tells none.

    They are its plain words and its groups of plain words, but those within other groups or that may be left out.
    """
    plain = re.sub(r"\\.|\[[^\]]*\]", " ", pattern)
    groups = [(m, plain[: m.start()]) for m in re.finditer(r"\(\?:([^()]*)\)(?![?*{])", plain)]
    groups = [m[1].split("|") for m, before in groups if before.count("(") == before.count(")")]
    found = [tuple(x[:-2] if x.endswith("?") else x for x in g) for g in groups if all(re.fullmatch(r"[a-z ]*[a-z]{2}\??", x) for x in g)]
    while (less := re.sub(r"\([^()]*\)[?*+]*", " ", plain)) != plain:
        plain = less
    if "|" in plain:
        return ()
    found += [(x,) for x in re.findall(r"(?<![a-z])[a-z]{2,}(?![a-z?*{])", plain)]
    return max(found, key=lambda g: min(map(len, g)), default=())


def term_counts(text: str | Column, terms: tuple[str, ...]) -> Column:
    """Whole-word occurrences of all terms together in the lower-cased text; terms may overlap each other.

    Terms of one word never do, so that one expression counts all of them.
    """
    one = [t for t in dict.fromkeys(terms) if re.fullmatch(r"\w+", t)]
    count = lambda low, p: F.regexp_count(low, F.lit(rf"{p}(?!\w)"))
    some = lambda low, t: F.when(F.contains(low, F.lit(t)), count(low, rf"(?<!\w){re.escape(t)}")).otherwise(0)
    # A first letter is seen at once; what stands before it is dearer to look at.
    first = "".join(sorted({t[0] for t in one}))
    ones = lambda low: [count(low, rf"(?=[{first}])(?<!\w)(?:{'|'.join(one)})")] if one else []
    return let(F.lower(F.coalesce(as_column(text), F.lit(""))), lambda low: reduce(add, [some(low, t) for t in terms if t not in one] + ones(low)))


def terms_present(text: str | Column, terms: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(as_column(text), F.lit("")))
    return reduce(add, [F.contains(low, F.lit(t)).cast("int") for t in terms])


def abstraction(text: str | Column, lexicon: Lexicon | None = None) -> Column:
    """Struct of ``why, what, score``: the share of why-terms over its target, at most 1; .5 without any term."""
    lexicon = lexicon or Lexicon()
    counts = F.struct(term_counts(text, lexicon.why).alias("why"), term_counts(text, lexicon.what).alias("what"))
    score = lambda c: F.when(c["why"] + c["what"] == 0, 0.5).otherwise(F.least(F.lit(1.0), F.try_divide(c["why"], c["why"] + c["what"]) / lexicon.target_why_share))
    return let(counts, lambda c: F.struct(c["why"].alias("why"), c["what"].alias("what"), score(c).alias("score")))


def presence_share(text: str | Column, why: tuple[str, ...], what: tuple[str, ...]) -> Column:
    """Share of distinct why-terms among the distinct terms present, 0 without any."""
    a, b = terms_present(text, why), terms_present(text, what)
    return F.coalesce(F.try_divide(a, a + b), F.lit(0.0))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(add, [scores[k] * w for k, w in weights.items()])


def document_quality(text: str | Column, source_lines: Column | None = None, lexicon: Lexicon | None = None, weights: dict[str, float] | None = None, unicode: bool = True) -> dict[str, Column]:
    """The four quality scores of a document and their weighted sum ``dq``."""
    lexicon = lexicon or Lexicon()
    parts = {
        "structure": section_share(text, lexicon.sections),
        "traceability": line_citations(text, source_lines)["score"],
        "readability": readability(text, lexicon, unicode)["score"],
        "abstraction": abstraction(text, lexicon)["score"],
    }
    return parts | {"dq": weighted({k: F.col(k) for k in parts}, weights or DOCUMENT_WEIGHTS)}


def expand_synonyms(text: str | Column, synonyms: dict[str, list[str]]) -> Column:
    """Each alternative's whole words become their base term, base by base."""
    out = as_column(text)
    for base, others in synonyms.items():
        out = let(out, _to_base(base, others))
    return out


def _to_base(base: str, others: list[str]):
    """The pattern is tried on texts only that hold one of its words, which is far cheaper to see."""
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in others])
    first = "".join(sorted({re.escape(w[0]) for w in others}))  # Seen at once; what stands before a place is dearer to look at.
    return lambda t: F.when(some(t), F.regexp_replace(t, rf"(?=[{first}])(?<!\w)(?:{'|'.join(map(re.escape, others))})(?!\w)", base)).otherwise(t)


def normalised(text: str | Column, synonyms: dict[str, list[str]]) -> Column:
    """Lower case, synonyms to base terms, white space collapsed, punctuation but hyphens dropped."""
    out = expand_synonyms(F.lower(F.coalesce(as_column(text), F.lit(""))), synonyms)
    return F.regexp_replace(F.trim(F.regexp_replace(out, f"[{_SPACE}]+", " ")), f"[^A-Za-z0-9_{_SPACE}-]", "")


def token_set(text: str | Column, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(words(F.lower(as_column(text))), lambda w: F.length(w) > longer_than))


def containment(part: Column, whole: Column) -> Column:
    """Share of the part's tokens that the whole has, 0 without tokens."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(part, whole)), F.size(part)), F.lit(0.0))


def bigrams(text: str | Column) -> Column:
    pairs = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 1)), lambda i: F.substring(s, i, F.lit(2))))
    return let(as_column(text), lambda s: F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(pairs(s)))


def bigram_jaccard(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of character-bigram sets; 1 for equal strings, 0 if either has none."""
    x, y = bigrams(F.upper(as_column(a))), bigrams(F.upper(as_column(b)))
    share = F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    return F.when(F.upper(as_column(a)) == F.upper(as_column(b)), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def headings(text: str | Column) -> Column:
    return F.regexp_extract_all(as_column(text), F.lit(r"(?m)^#+[ \t]+(.+)$"), 1)


def indicator_density(text: str | Column, patterns: tuple[str, ...], few: int = 5, full: int = 12) -> Column:
    """0 without an indicator, n/5 up to five, then n/12 but at most 1."""
    n = reduce(add, [F.regexp_count(F.lower(as_column(text)), F.lit(p)) for p in patterns])
    return F.when(n == 0, 0.0).when(n < few, n / float(few)).otherwise(F.least(F.lit(1.0), n / float(full)))


def _holding(term: str):
    return lambda sentence: F.contains(sentence, F.lit(term))


def stuffing_score(text: str | Column, keywords: tuple[str, ...], least_words: int = 5) -> Column:
    """One less the share of present keywords that stand in a sentence of enough words; 0 without a keyword."""
    sentences = F.filter(F.split(F.lower(as_column(text)), "[.!?]+"), lambda s: F.size(words(s)) >= least_words)
    low = F.lower(as_column(text))
    present = reduce(add, [F.contains(low, F.lit(k)).cast("int") for k in keywords])
    shown = reduce(add, [(F.contains(low, F.lit(k)) & F.exists(sentences, _holding(k))).cast("int") for k in keywords])
    return F.when(present == 0, 0.0).otherwise(1 - F.try_divide(shown, present))


def scaled_penalty(value: Column, threshold: float, most: float) -> Column:
    """The excess over a threshold as a share of what is left above it, times the cap."""
    return F.when(value <= threshold, 0.0).otherwise(F.least(F.lit(most), (value - threshold) / (1 - threshold) * most))


def numbers(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(as_column(text), F.lit(r"(-?[0-9]+\.?[0-9]*)"), 1), lambda x: x.cast("double"))

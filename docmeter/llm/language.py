"""Language identification by word-first backoff to character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.textbytes import HashIndex, SpanHasher, sliced, spans, steps, text_buffers
from docmeter.llm.workspace import drop, stored

#: Labelled documents to learn from, in expectation: of each language, and of all languages together.
SAMPLE_PER_LANGUAGE, SAMPLE = 2_000, 64_000
#: Values of found keys that are added up at a time.
STEP_VALUES = 1 << 20
LONGEST = 5
SMOOTHING = 0.1
UNDETERMINED = "und"
#: Words of a language are known if so large a part of its sample's words is like them; so their share in a text says the same
#: whatever the sample's size.
KNOWN_FREQUENCY = 1e-5
#: The pipeline keeps texts with at least this score, and this share of words known in the predicted language.
LEAST_SCORE, LEAST_KNOWN = 0.5, 0.48

_EDGE = 0x20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@cache
def _code_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 62, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    """Log frequencies per language of known words (order 0) and n-grams (order n).

    A key's values stand at ``start[i]:start[i + 1]``, one for each language that has it: ``language`` and how much more
    than ``base``, the value of the languages that lack it.
    """

    languages: list[str]
    keys: list[np.ndarray]
    start: list[np.ndarray]
    language: list[np.ndarray]
    more: list[np.ndarray]
    base: list[np.ndarray]
    known: np.ndarray  # whether each value of order 0 is that of a word known in its language

    def index(self) -> list[HashIndex]:
        out = []
        for k in self.keys:
            out.append(HashIndex(len(k) + 1))
            out[-1].add(k, np.arange(len(k), dtype=np.int32))
        return out


def _codes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lower-cased code points of some texts at a time: first and last row, the points, and their bounds."""
    data, bounds = text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for lo, hi in steps(bounds):
        part = data[bounds[lo] : bounds[hi]]
        code = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=head[1:])
        yield lo, hi, code, head[bounds[lo : hi + 1] - bounds[lo]]


class _Words:
    """The words (runs of letters) of some texts, and n-grams of chosen words with an edge mark at either end."""

    def __init__(self, code: np.ndarray, bounds: np.ndarray):
        self.code = code
        self.start, self.end, first = spans(~_letters()[code], bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))

    def hashes(self) -> np.ndarray:
        return SpanHasher(self.code, values=_code_values())(self.start, self.end)

    def grams(self, chosen: np.ndarray):
        """A function that gives hash and word (position in ``chosen``) of every n-gram."""
        size = self.end[chosen] - self.start[chosen] + 2
        last = np.cumsum(size)
        at = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size)
        source = np.repeat(self.start[chosen] - 1, size) + at
        edge = (at == 0) | (at == np.repeat(size - 1, size))
        padded = np.where(edge, _EDGE, self.code[np.where(edge, 0, source)]) if len(source) else np.zeros(0, np.uint32)
        hasher, word = SpanHasher(padded, values=_code_values()), np.repeat(np.arange(len(chosen)), size)
        room = np.repeat(size, size) - at

        def of(n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i = np.flatnonzero((room >= n) & wanted[word])
            return hasher(i, i + n), word[i]

        return of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of each language by key, counted over some texts at a time."""
    for batch in sliced(batches):
        names = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, code, bounds in _codes(batch.column(1)):
            words = _Words(code, bounds)
            language, of_doc = np.unique(names[lo:hi].astype(str), return_inverse=True)
            grams, every = words.grams(np.arange(len(words.doc))), np.ones(len(words.doc), bool)
            for order in range(LONGEST + 1):
                key, word = (words.hashes(), np.arange(len(words.doc))) if order == 0 else grams(order, every)
                own = of_doc[words.doc[word]]
                sort = np.lexsort((key, own))
                key, own = key[sort], own[sort]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)])
                n = np.diff(np.append(new, len(key)))
                yield pa.record_batch([pa.array(language[own[new]].tolist(), pa.string()), pa.array(np.full(len(new), order, np.int32)), pa.array(key[new].view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "ord", "key", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Learn every language from a bounded sample of whole texts, picked by a hash of their ids: about ``per_language``
    documents of each, or fewer of each where there are so many languages that all would be over ``sample``.

    All words and n-grams of the sample are learned; only the sample bounds the model. Null texts and null languages are
    not learned from; without any row the model is empty."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], [], [], [], [], np.zeros(0, bool))
    most = min(per_language, sample / len(languages))
    share = [(i, k, min(1.0, most / sizes[k]) * (1 << 30)) for i, k in enumerate(languages)]
    share = F.broadcast(labelled.sparkSession.createDataFrame(share, "k int, lang string, share double"))
    picked = rows.join(share.select("lang", "share"), "lang").filter(F.col("h") < F.col("share")).select("lang", "text")
    counts = picked.mapInArrow(_counted, "lang string, ord int, key long, n long").groupBy("ord", "key", "lang").agg(F.sum("n").alias("n"))
    counts = stored(counts.join(share.select("lang", "k"), "lang").select("ord", "key", "k", "n"), "language-counts")
    found = counts.toArrow()
    drop(counts)
    order, key, k, n = (found.column(x).to_numpy() for x in ("ord", "key", "k", "n"))
    model = Model(languages, [], [], [], [], [], np.zeros(0, bool))
    for o in range(LONGEST + 1):
        own = np.flatnonzero(order == o)
        own = own[np.lexsort((k[own], key[own]))]
        keys, first = np.unique(key[own], return_index=True)
        whole = np.bincount(k[own], n[own], len(languages))
        if o == 0:
            model.known = n[own] >= KNOWN_FREQUENCY * whole[k[own]]
        scale = whole + SMOOTHING * (len(keys) + 1)
        model.base.append(np.log(SMOOTHING / scale))
        model.keys.append(keys.view(np.uint64))
        model.start.append(np.append(first, len(own)))
        model.language.append(k[own].astype(np.int32))
        model.more.append(np.log((n[own] + SMOOTHING) / SMOOTHING))
    return model


def _add(total: np.ndarray, model: Model, order: int, doc: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """Add the values of found keys (places ``at``) to their documents' totals."""
    total += np.bincount(doc, weights=weight, minlength=len(total))[:, None] * model.base[order]
    start, step = model.start[order], max(1, STEP_VALUES // len(model.languages))
    for lo in range(0, len(at), step):
        own = slice(lo, lo + step)
        size = start[at[own] + 1] - start[at[own]]
        last = np.cumsum(size)
        i = np.repeat(start[at[own]] - (last - size), size) + np.arange(last[-1])
        cell = np.repeat(doc[own], size) * len(model.languages) + model.language[order][i]
        total += np.bincount(cell, weights=model.more[order][i] * np.repeat(weight[own], size), minlength=total.size).reshape(total.shape)


def _scores(words: _Words, docs: int, model: Model, index: list[HashIndex]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's log frequencies, the sums of its words': a word's own if known, else the mean over the longest
    n-grams of which any is known. Then how many of its words each language knows."""
    total = np.zeros((docs, len(model.languages)))
    known = index[0].find(words.hashes())
    hit = np.flatnonzero(known >= 0)
    start, size = model.start[0][known[hit]], np.diff(model.start[0])[known[hit]]
    each = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    cell = np.repeat(words.doc[hit], size) * len(model.languages) + model.language[0][each]
    of_language = np.bincount(cell, model.known[each], total.size).reshape(total.shape)
    _add(total, model, 0, words.doc[hit], known[hit], np.ones(len(hit)))
    unseen = np.flatnonzero(known < 0)
    grams, left = words.grams(unseen), np.ones(len(unseen), bool)
    for n in range(LONGEST, 0, -1):
        if not left.any():
            break
        key, word = grams(n, left)
        at = index[n].find(key)
        word, at = word[at >= 0], at[at >= 0]
        count = np.bincount(word, minlength=len(unseen))
        _add(total, model, n, words.doc[unseen[word]], at, 1 / count[word])
        left &= count == 0
    return total, of_language


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    index, names = model.index(), np.array([*model.languages, UNDETERMINED], object)
    for batch in sliced(batches):
        best, score, familiar = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for lo, hi, code, bounds in _codes(batch.column(1)) if model.languages else ():
            words = _Words(code, bounds)
            total, known = _scores(words, hi - lo, model, index)
            share = np.exp(total - total.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            n_words = np.bincount(words.doc, minlength=hi - lo)
            some = n_words > 0
            best[lo:hi][some] = share.argmax(axis=1)[some]
            familiar[lo:hi][some] = known[np.arange(hi - lo), share.argmax(axis=1)][some] / n_words[some]
            score[lo:hi][some] = share.max(axis=1)[some]
        yield pa.record_batch([*batch.columns[:1], *batch.columns[2:], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(familiar)], [batch.schema.names[0], *batch.schema.names[2:], "lang_pred", "score", "known"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, known`` of every whole text, one row per input row.

    A word is a run of letters, lower-cased. A text's log frequencies are the sums of its words'; ``score`` is the best
    language's share after exponentiation, ``known`` the share of its words that make up at least KNOWN_FREQUENCY of this language's sample. Texts that are null,
    empty or without a letter, and all texts if the model is empty, are ``und`` with score 0; ties go to the first language
    by name. Repeated and null ids keep a row each, very long texts are read in steps, other columns are not read, and an
    empty table gives an empty one. Nothing is shuffled; the model that each task reads is bounded by its sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _predicted(batches, shared.value), "doc_id long, lang_pred string, score double, known double")


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, with all their columns, in a language that was learned: the score tells the best from the others, and
    the share of known words, which doesn't grow with the text, the learned from the unknown. Null, empty and letterless
    texts go; repeated and null ids keep a row each, and columns of any name stay as they are."""
    shared = spark.sparkContext.broadcast(fit(docs.filter(~held_out() & F.col("doc_id").isNotNull())))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("doc_id", "text", whole.alias("d"))
    found = rows.mapInArrow(lambda batches: _predicted(batches, shared.value), f"doc_id long, d {rows.schema['d'].dataType.simpleString()}, lang_pred string, score double, known double")
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE) & (F.col("known") >= LEAST_KNOWN)).select("d.*")

"""Line-first cleaning: rules per line remove failures, then documents that lose too much text are rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.llm.textbytes import SPACE, SpanHasher, mixed, sliced, spans, steps, text_buffers, word_sequences

LEAST_WORDS = 50
#: Percent of words in repeated 3-word windows, and of word characters in failed lines, above which a document goes.
MOST_REPEATED = 50
MOST_LOST = 50
#: A line of at least this many words fails with punctuation marks over this percentage of its words.
CROWDED_WORDS, CROWDED_PERCENT = 5, 80
#: A line is navigation with a separator for each so many words.
WORDS_PER_SEPARATOR = 4
SEPARATOR = "|"
TERMINAL = ".!?:;\"')]…”’»。！？"
BOILERPLATE = (
    "accept cookies", "accepter les cookies", "aceptar cookies", "alle rechte vorbehalten", "all rights reserved", "aviso legal",
    "click here", "cliquez ici", "cookie policy", "cookies akzeptieren", "enable javascript", "follow us on", "haga clic",
    "hier klicken", "lorem ipsum", "mentions legales", "nutzungsbedingungen", "privacy policy", "share this", "sign up for", "skip to content", "subscribe to", "terms of service",
    "terms of use", "todos los derechos reservados",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TERMINAL_ASCII = np.zeros(256, bool)
_TERMINAL_ASCII[[ord(c) for c in TERMINAL if c.isascii()]] = True
_TERMINAL_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in TERMINAL if not c.isascii()]
_DOC_STEP = np.uint64(0xD1B54A32D192ED03)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars")


def _sum(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _failed_lines(part: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, word_end: np.ndarray, last_word: np.ndarray) -> np.ndarray:
    """Boilerplate, navigation and punctuation rules over lines that have a word."""
    failed = np.zeros(len(start), bool)
    low = part.tobytes().lower()
    for phrase in BOILERPLATE:
        phrase = phrase.encode()
        at = low.find(phrase)
        while at >= 0:
            line = int(np.searchsorted(start, at, "right")) - 1
            if at + len(phrase) <= end[line]:
                failed[line] = True
            at = low.find(phrase, at + 1)
    failed |= _sum(part == ord(SEPARATOR), start, end) * WORDS_PER_SEPARATOR >= words
    failed |= (words >= CROWDED_WORDS) & (_sum(_PUNCTUATION[part], start, end) * 100 > words * CROWDED_PERCENT)
    tail = word_end[last_word]
    ends = _TERMINAL_ASCII[part[tail - 1]]
    for mark in _TERMINAL_WIDE:
        hit = (tail - len(mark) >= start) & (part[tail - 1] == mark[-1])
        for k in range(2, len(mark) + 1):
            hit &= part[np.maximum(tail - k, 0)] == mark[-k]
        ends |= hit
    return failed | ~ends


def _measure(part: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text, then start, end and text number of the failed lines."""
    n = len(bounds) - 1
    space = SPACE[part]
    start, end, first = spans(space, bounds)
    hasher = SpanHasher(part)
    doc = np.repeat(np.arange(n), np.diff(first))
    points = ~space & ((part & 0xC0) != 0x80)
    out = {"n_words": np.diff(first), "word_chars": _sum(points, bounds[:-1], bounds[1:]), "n_symbols": _sum(_SYMBOL[part], bounds[:-1], bounds[1:])}

    window = word_sequences(hasher(start, end), 3)
    own = doc[: len(window)] == doc[2:] if len(window) else np.zeros(0, bool)
    twice = np.zeros(len(window), bool)
    twice[own] = _repeated(mixed(window[own] + doc[: len(window)][own].astype(np.uint64) * _DOC_STEP))
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)

    line, line_end, line_first = spans(part == 10, bounds)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    a, b = np.searchsorted(start, line), np.searchsorted(start, line_end)
    line, line_end, line_doc, a, b = (x[b > a] for x in (line, line_end, line_doc, a, b))
    key = mixed(hasher(line, line_end) + line_doc.astype(np.uint64) * _DOC_STEP)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    failed = _failed_lines(part, line, line_end, b - a, end, b - 1) if len(line) else np.zeros(0, bool)
    lost = _sum(points, line, line_end)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_failed_lines"] = np.bincount(line_doc[failed], minlength=n)
    out["lost_chars"] = np.bincount(line_doc[failed], weights=lost[failed], minlength=n).astype(np.int64)
    return out, line[failed], line_end[failed], line_doc[failed]


def _without(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    """``text`` without the given lines and the line break of each."""
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.append(text[at:a])
        at = b + 1
    out = b"".join([*kept, text[at:]])
    return out.removesuffix(b"\n") if at > len(text) else out


def _clean(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        data, bounds = text_buffers(batch.column(1))
        counts, texts = {x: [np.zeros(0, np.int64)] for x in COUNTS}, []
        for lo, hi in steps(bounds):
            part, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            found, start, end, doc = _measure(part, own)
            for x in COUNTS:
                counts[x].append(found[x])
            if with_text:
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    text, a, b = part[own[i] : own[i + 1]].tobytes(), cut[i], cut[i + 1]
                    texts.append((_without(text, start[a:b] - own[i], end[a:b] - own[i]) if b > a else text).decode())
        columns = [batch.column(0), *(pa.array(np.concatenate(counts[x]).astype(np.int64)) for x in COUNTS)]
        names = ["doc_id", *COUNTS]
        if with_text:
            valid = batch.column(1).is_valid().to_pylist()
            columns.append(pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string()))
            names.append("clean_text")
        yield pa.record_batch(columns, names)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row with counts, verdict and, if asked for, the text without its failed lines.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; lines are cut at ``\\n`` and count if they have a word. A line
    fails if it holds a boilerplate phrase (A-Z in any case), a separator for each few words (navigation), no terminal
    punctuation mark at its end, or marks on most of its words. ``base_failed``: under 50 words, or over half the words
    in 3-word windows that occur again. ``kept`` is false if base_failed or if failed lines hold over half of the
    characters in words. Null, empty and blank texts have zeros and base_failed; a null text stays null in
    ``clean_text``. Repeated rows and null ids keep a row each; other columns are not read; an empty table gives an
    empty one. Lines are compared by 64-bit hashes. Nothing is shuffled.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", clean_text string" * with_text
    out = docs.mapInArrow(lambda batches: _clean(batches, with_text), schema)
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, with their cleaned text as ``text``, its length as ``n_chars`` where there is such a column, and
    all their other columns of any name. Null, empty and blank texts go; repeated and null ids keep a row each; very long
    texts are read whole; an empty table gives an empty one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    of = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {dict(text='string', n_chars='long').get(c, t)}" for c, t in of.items())
    return rows.mapInArrow(_clean_documents, schema)


def _clean_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        doc = dict(zip((f.name for f in batch.column(0).type), batch.column(0).flatten(), strict=True))
        got = next(_clean(iter([pa.record_batch([doc["doc_id"], doc["text"]], ["doc_id", "text"])]), True))
        n = {x: got.column(x).to_numpy() for x in COUNTS}
        kept = (n["n_words"] >= LEAST_WORDS) & (100 * n["n_repeat_words"] <= MOST_REPEATED * n["n_words"]) & (100 * n["lost_chars"] <= MOST_LOST * n["word_chars"])
        doc["text"] = got.column("clean_text")
        if "n_chars" in doc:
            doc["n_chars"] = pa.compute.utf8_length(doc["text"]).cast(pa.int64())
        yield pa.record_batch(list(doc.values()), list(doc)).filter(pa.array(kept))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WORD = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents
), win AS (
  SELECT r, i, list_value(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), lines AS (
  SELECT r, line, pos, rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, lower(line) AS low, len(regexp_extract_all(line, {WORD})) AS words,
    length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(line, '[!-/:-@\[-`{{-~]')) AS marks, len(regexp_extract_all(line, '[|]')) AS separators
  FROM (SELECT r, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT r, string_split(text, chr(10)) AS l FROM d))
), judged AS (
  SELECT r, chars, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again,
    (separators * {WORDS_PER_SEPARATOR} >= words) OR (words >= {CROWDED_WORDS} AND marks * 100 > words * {CROWDED_PERCENT}) OR strpos({_sql_text(TERMINAL)}, right(body, 1)) = 0
    OR {" OR ".join(f"contains(low, {_sql_text(x)})" for x in BOILERPLATE)} AS failed
  FROM lines WHERE words > 0
), per AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_failed_lines, coalesce(sum(chars) FILTER (WHERE failed), 0) AS lost_chars FROM judged GROUP BY r
), q AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN per USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars, base_failed, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM q)
"""

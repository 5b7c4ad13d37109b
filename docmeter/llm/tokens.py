"""Token ids of whole texts by the tokenizers library, which sees each distinct word of a worker once."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

from docmeter.llm.textbytes import HashIndex, SpanHasher, spans

#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Stands between words that are encoded together; words that hold it are encoded alone.
_BETWEEN = "\x00"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 10]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER_ASCII = ~_LETTER & ~_SEPARATOR
_OTHER_ASCII[128:] = False


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Lower-cased letters that normalisation leaves alone, and characters whose lower case may depend on the library.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_UNUSUAL = re.compile("[^\x00-\u012f\u0131-\u024f]")


def _letters_of(tokenizer) -> dict[int, str] | None:
    """What the tokenizer's model reads for each plain letter, if it takes a word of them as one piece."""
    text = "".join(chr(c) for c in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
    one = [tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c)) for c in text]
    if len(pieces) == 1 and pieces[0][0] == "".join(x[0][0] for x in one):
        return {ord(c): x[0][0] for c, x in zip(text, one, strict=True)}
    return None


#: Texts that are encoded both ways when a tokenizer is loaded.
_PROBES = (
    "Some words, and THEIR Case", " lead  and trail \n", "a-b c_d e.f", "x1y2 3z 45", "don't we'll I'M", "tab\there\rnow\u00a0then", "\u00c9t\u00e9 na\u00efve stra\u00dfe", "e\u0301 \ufb01ne \u212b \u2460", "\u4e2d\u6587 \U0001f600!", "#1 (two) [three] \"four\"", "a\nb\n\nc", "\x00\x01",
)


class WordTokenizer:
    """Ids of texts under a tokenizer. The fast way is for those whose pre-tokens never hold white space nor both ASCII
    letters and what follows them, and that lower-case; that is tried on some texts when the tokenizer is loaded. Others,
    and those with special tokens that do not begin with ``<|``, encode whole texts.

    Texts are cut at spaces, line feeds and where an ASCII letter meets another ASCII character that is none; the
    tokenizer cuts at all these places itself, so that the ids of the parts, one after the other, are the ids of the
    text. A part's ids are remembered under a 64-bit hash of its bytes with A-Z lower-cased. Texts with ``<|``, in
    which special tokens may stand, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()
        self.whole = not self._fast()

    def _fast(self) -> bool:
        """Whether words by themselves give the ids of whole texts."""
        parts = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer
        if None in parts or not all(t.content.startswith("<|") for t in self._tokenizer.get_added_tokens_decoder().values()):
            return False
        self._between = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self._letters = _letters_of(self._tokenizer)
        data = [p.encode() for p in _PROBES]
        bounds = np.cumsum([0, *map(len, data)])
        ids, counts = self._by_words(np.frombuffer(b"".join(data), np.uint8), bounds)
        want = [x.ids for x in self._tokenizer.encode_batch(list(_PROBES), add_special_tokens=False)]
        self._forget()
        return counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]

    def _forget(self, room: int = 0) -> None:
        self._index = HashIndex(max(REMEMBERED + (1 << 18), room))
        self._ids, self._used = np.zeros(1 << 20, np.uint32), 0
        self._start, self._known = np.zeros(1 << 16, np.int64), 0

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """The ids of words without white space; those of plain letters go straight to the tokenizer's model."""
        words = [w if _UNUSUAL.search(w) else w.lower() for w in words]
        if self._letters is None:
            return self._encode_joined(words)
        plain, model = _PLAIN.fullmatch, self._tokenizer.model
        out = [np.array([t.id for t in model.tokenize(w.translate(self._letters))], np.uint32) if plain(w) else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._encode_joined([words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _encode_joined(self, words: list[str]) -> list[np.ndarray]:
        out = []
        for lo in range(0, len(words), 64):
            some = words[lo : lo + 64]
            ids = np.array(self._tokenizer.encode(f" {_BETWEEN} ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self._between[0]) if len(self._between) == 1 else []
            if len(cuts) == len(some) - 1:
                out += [x[1:] if k else x for k, x in enumerate(np.split(ids, cuts))]
            else:
                out += [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch(some, add_special_tokens=False)]
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = self._encode(words)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._known + len(keys) + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        self._ids[self._used : self._used + len(flat)] = flat
        self._start[self._known + 1 : self._known + 1 + len(keys)] = self._used + np.cumsum(size)
        self._index.add(keys, np.arange(self._known, self._known + len(keys), dtype=np.int32))
        self._used += len(flat)
        self._known += len(keys)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that ``bounds`` cut from ``data``, and how many each text has."""
        if not self.whole:
            return self._by_words(data, bounds)
        texts = [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids = [np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    def _by_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        separator, letter = _SEPARATOR[data], _LETTER[data]
        also = np.zeros(len(data), bool)
        also[1:] = letter[:-1] & _OTHER_ASCII[data[1:]]
        start, end, first = spans(separator, bounds, also)
        key = SpanHasher(data, fold_ascii_case=True)(start, end)
        if self._known > REMEMBERED:
            self._forget()
        found = self._index.find(key)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, at = np.unique(key[miss], return_index=True)
            at = miss[at]
            if self._known + len(new) > REMEMBERED + (1 << 18):
                new, at = np.unique(key, return_index=True)
                self._forget(len(new))  # one very long text may hold more words than are remembered
            text = data.tobytes()
            self._learn(new, [text[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            found = self._index.find(key)
        size = self._start[found + 1] - self._start[found]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self._ids[np.repeat(self._start[found] - total[:-1], size) + np.arange(total[-1])]
        counts = np.diff(total[first])
        return self._with_special(data, bounds, ids, counts)

    def _with_special(self, data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hint = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if not len(hint):
            return ids, counts
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.unique(np.searchsorted(bounds, hint, "right") - 1):
            text = data[bounds[k] : bounds[k + 1]].tobytes().decode()
            pieces[k] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker and path."""
    return WordTokenizer(path)

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from docmeter.llm import alignment as al


def _brute(texts):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbols = al.byte_symbols()
    spell_a = lambda i: bytes(symbols[c] for c in a_side.id_to_token(i))
    spell_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    rows, links = [], []
    for text in texts:
        a, b = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or "")
        if not text or any(b"".join(map(s, x)) != b" " + text.encode() for s, x in ((spell_a, a), (spell_b, b))):
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [set(np.cumsum([len(s(i)) for i in x]).tolist()) for s, x in ((spell_a, a), (spell_b, b))]
        both, groups = ends[0] & ends[1], defaultdict(lambda: ([], []))
        for side, s, x in ((0, spell_a, a), (1, spell_b, b)):
            place = nth = 0
            for i in x:
                groups[nth][side].append(i)
                place += len(s(i))
                nth += place in both
        found = [(i, j) for k in sorted(groups) for i in groups[k][0] for j in groups[k][1]]
        spelled = ";".join(f"{','.join(map(str, groups[k][0]))}|{','.join(map(str, groups[k][1]))}" for k in sorted(groups))
        rows.append((len(a), len(b), len(groups), len(found), hashlib.sha256(spelled.encode()).hexdigest()))
        links.append(found)
    count = Counter(p for found in links for p in set(found))
    highest = defaultdict(int)
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    return [(*r[:4], sum(count[p] == highest[p[0]] for p in found), sum(count[p] for p in found), r[4]) for r, found in zip(rows, links, strict=True)], count


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _run(spark, texts):
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a string, chunk int").repartition(3)
    out = al.align(table)
    return [tuple(r[c] for c in COLUMNS) for r in out.documents.orderBy("doc_id").collect()], {(r.a, r.b): r.n_docs for r in out.pairs.collect()}


ODD = [None, "", " ", "  two  spaces ", "\n\n", "x▁y", "▁", "<|endoftext|> and <s> </s> <unk>", "\x00\x01", "café naïve 中文字 \U0001f600\U0001f600", "a" * 3000, "=" * 500 + " " * 70, "ab" * 400, "don't we'll I'm 12345 67,890.12", "\t\ttabs\r\nand lines\n", "é combining ​ zero"]


def test_odd_texts_equal_brute_force(spark):
    texts = [*ODD, *ODD[9:14], "the same words in other texts", "the same words again"]
    want, count = _brute(texts)
    got, pairs = _run(spark, texts)
    assert got == want
    assert pairs == dict(count)
    assert _run(spark, []) == ([], {})
    assert _run(spark, [None, ""]) == ([(0, 0, 0, 0, 0, 0, "")] * 2, {})


def test_documents_equal_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want, count = _brute(texts)
    got, pairs = _run(spark, texts)
    assert got == want and pairs == dict(count)


def test_repeated_and_null_ids_keep_rows(spark):
    table = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, "some other")], "doc_id long, text string")
    out = al.align(table, with_groups=True).documents
    assert sorted((r.doc_id or 0, hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256) for r in out.collect()) == [(0, True), (1, True), (1, True)]


def _one_by_one(texts, per_step):
    aligner = al.Aligner(*al.default_paths())
    out = []
    for lo in range(0, len(texts), per_step):
        good, n_a, n_b, windows, first = aligner(texts[lo : lo + per_step])
        groups, links = aligner.totals(windows, first)
        text, pair, times = aligner.links(windows, first)
        spelled = aligner.spelled_pairs(pair).tolist()
        for k in range(len(good)):
            own = text == k
            out.append((int(n_a[k]), int(n_b[k]), int(groups[k]), int(links[k]), aligner.groups(windows[first[k] : first[k + 1]]), sorted(zip([p for p, o in zip(spelled, own, strict=True) if o], times[own].tolist(), strict=True))))
        if lo % 3 == 0:
            aligner.forget()
    return out


def test_memory_and_steps_do_not_matter():
    texts = [t for t in ODD if t and "▁" not in t] * 3
    assert _one_by_one(texts, 1) == _one_by_one(texts, len(texts))


def test_long_texts_are_cut_where_tokenizers_cut(monkeypatch):
    text = "".join(t or "" for t in ODD if "▁" not in (t or "")) + " and plain words, then 123 more  words\n" * 40
    whole = al.Aligner(*al.default_paths()).encode([text, "short"])
    monkeypatch.setattr(al, "PART_CHARS", 50)
    assert len(al._parts(text)) > 20
    assert al.Aligner(*al.default_paths()).encode([text, "short"]) == whole


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    texts = [t for t in ODD if t and "▁" not in t]
    want = _one_by_one(texts, 4)
    monkeypatch.setattr(al, "WRITTEN_OUT", 1)
    assert _one_by_one(texts, 4) == want


def test_mixing_is_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (al._unmixed(al.mixed(x)) == x).all()

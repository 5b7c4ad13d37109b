import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docmeter.llm import packing, pieces, planes, sharding
from docmeter.llm.tokens import WordTokenizer, default_path
from docmeter.llm.workspace import fresh_path

ODD = [None, "", " ", "\n", "a", "Don't 'tis IT'S", "Élan İstanbul ΣΑΣ — “q” é.", "a<|endoftext|>b <|x", "a\x00b \x00", "tab\tx\x0b", "x" * 5000, "9.5% a1b2 ½ 漢字。テスト", "  two  spaces \n\n lines\n", "▁x▁ y", "    def f(x):\n        return x"]
SCHEMA = "doc_id long, text string, part string, size string"


def _docs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoin shrdlué.,") for _ in range(rng.randint(1, 12)))
    texts = ODD + ["".join(word() for _ in range(rng.choice([3, 50, 900, 6000]))) for _ in range(40)]
    rows = [(5 * i - 20, t, "clash", "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def _ids(rows):
    own = Tokenizer.from_file(default_path())
    return {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(spark, monkeypatch, bits):
    rows, docs = _docs(spark)
    folder = fresh_path(spark, "planes")
    planes.write_tokens(docs, folder, bits=bits)
    got = planes.read_tokens(spark, folder, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for (i, ids), r in zip(sorted(_ids(rows).items()), got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        assert r.ids == ids.tolist()
        start += len(ids)


def test_planes_of_an_empty_table_and_equal_ids(spark):
    folder = fresh_path(spark, "planes")
    planes.write_tokens(spark.createDataFrame([], SCHEMA), folder)
    assert planes.read_tokens(spark, folder).count() == 0
    folder = fresh_path(spark, "planes")
    planes.write_tokens(spark.createDataFrame([(1, "same", None, None)] * 3 + [(None, "x", None, None)], SCHEMA), folder)
    assert [(r.doc_id, r.start, r.n_tokens) for r in planes.read_tokens(spark, folder).orderBy("start").collect()] == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]


def test_packing_places_each_id_once(spark):
    rows, docs = _docs(spark)
    docs = docs.unionAll(docs.limit(0)).unionAll(spark.createDataFrame([(None, "no id", None, None)], SCHEMA))
    got = packing.pack(docs).collect()
    want, by_doc, by_sequence = _ids(rows), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        if r.doc_id is not None:
            assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            assert r.doc_tokens == len(want[r.doc_id])
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert i is None or at == len(want[i])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert packing.pack(docs.limit(0)).count() == 0


def test_cutting_stock_is_close_to_the_bound():
    draw = np.random.default_rng(1)
    length = np.minimum(2048, draw.lognormal(5.5, 1, 50_000).astype(int) + 1)
    sizes, demand = np.unique(-(-length // packing.GRAIN), return_counts=True)
    plan = packing.cutting_stock(sizes, demand, packing.SEQUENCE // packing.GRAIN)
    assert (sum(n * p for n, p in plan) == demand).all() and all((p * sizes).sum() <= 256 for _, p in plan)
    assert sum(n for n, _ in plan) * 2048 <= length.sum() * 1.02
    assert packing.cutting_stock(np.zeros(0, int), np.zeros(0, int), 256) == []


def test_shards_have_exact_sizes_and_keep_rows(spark):
    rows = [(None, None)] * 3 + [(i, "same") for i in range(100)] + [(7, "same")] * 5
    frame = spark.createDataFrame(rows, "rank long, shard string").repartition(5)  # clashing names
    got = sharding.shuffle_into_shards(frame.select("rank", "shard"), shards=7).toDF("rank", "text", "shard", "slot").collect()
    assert sorted(map(str, ((r.rank, r.text) for r in got))) == sorted(map(str, rows))
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in sizes) and {len(x) for x in sizes} <= {15, 16}
    assert sharding.shuffle_into_shards(frame.limit(0)).count() == 0


def test_shuffle_is_uniform_over_shards(spark):
    frame = spark.range(4000, numPartitions=8)
    got = sharding.shuffle_into_shards(frame, shards=4).selectExpr("id div 500 as p", "shard").groupBy("p", "shard").count().collect()
    assert len(got) == 32 and all(85 < r["count"] < 165 for r in got)
    matrix = sharding.communication_matrix([500] * 8, [1000] * 4, 3)
    assert (matrix.sum(axis=1) == 500).all() and (matrix.sum(axis=0) == 1000).all()


def test_shuffle_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PIECE", 5)
    test_shards_have_exact_sizes_and_keep_rows(spark)


def test_word_tokenizer_equals_library():
    own, library = WordTokenizer(default_path()), Tokenizer.from_file(default_path())
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abEÉé'.,1 \n\t-<|>ſﬁ́") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    data = [t.encode() for t in texts]
    ids, counts = own(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
    for t, x in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert x.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces_equal_library_and_decode(spark):
    rows, docs = _docs(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for r, text in ((r, dict((i, t) for i, t, *_ in rows)[r.doc_id]) for r in pieces.decode(pieces.encode(docs)).collect()):
        assert r.ids == library.encode(text or ""), text
        assert r.text == (text or "").replace("▁", " ")
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_pieces_equal_library_on_random_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), pieces.PieceEncoder(pieces.load_model(pieces.default_path()))
    rng = random.Random(9)
    for alphabet in ("anetho", "abcdeéthinorsw.,▁ \n漢0129"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
        data = [t.encode() for t in texts]
        for t, ids in zip(texts, own(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data]))), strict=True):
            assert ids.tolist() == library.encode(t), t


def test_shard_query_has_sizes_hashes_and_one_law(spark, sf):
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.query(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in text.items()} and len(got) == len(text)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(sharding.SHARDS)}
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_matrix_is_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS_AT_ONCE", 2)
    test_shards_have_exact_sizes_and_keep_rows(spark)


@pytest.mark.parametrize("remembered", [5, 10 - (1 << 18)])
def test_pieces_when_words_are_forgotten(monkeypatch, remembered):
    monkeypatch.setattr(pieces, "REMEMBERED", remembered)
    library, own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), pieces.PieceEncoder(pieces.load_model(pieces.default_path()))
    rng = random.Random(2)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcdeé(1.") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(5)]
        data = [t.encode() for t in texts]
        got = own(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
        assert [x.tolist() for x in got] == [library.encode(t) for t in texts]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import AddedToken, normalizers

    texts = ["é café  two spaces", "", "Don't <special> it <|endoftext|>", "A b\nC"]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    nfc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    nfc.normalizer = normalizers.NFC()
    nfc.save(str(tmp_path / "nfc.json"))
    marked = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marked.add_special_tokens([AddedToken("<special>", special=True)])
    marked.save(str(tmp_path / "marked.json"))
    for path, whole in ((public_tokenizers.path("word_bpe_49k.json"), False), (public_tokenizers.path("byte_bpe_50k.json"), True), (str(tmp_path / "nfc.json"), True), (str(tmp_path / "marked.json"), True)):
        ours = WordTokenizer(path)
        ids, counts = ours(data, bounds)
        want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
        assert ours.whole == whole and counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]

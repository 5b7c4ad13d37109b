import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docmeter.operators import selection, similarity
from docmeter.operators.ranges import numbered
from docmeter.sources import results as rs


def test_numbers_within_a_hot_key(spark):
    draw = random.Random(1)
    rows = [("hot" if k % 3 else f"k{k % 7}", draw.randrange(50), k) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "k string, v int, id int").repartition(5), ["k"], ["v", "id"], "n").collect()
    want = defaultdict(list)
    for k, v, i in sorted(rows):
        want[k].append(i)
    assert {r.id: r.n for r in got} == {i: n for ids in want.values() for n, i in enumerate(ids, 1)}
    assert numbered(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "n").count() == 0


def test_merged_texts_and_digests(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 2, "a"), (2, 1, None), (3, 1, "x" * 50), (3, 2, "y"), (None, 1, "z")]
    table = spark.createDataFrame(rows, "k long, turn int, text string").repartition(3)
    whole = {1: "a\na\nb", 2: "", 3: "x" * 50 + "\ny", None: "z"}
    digests = {r.k: (r.parts, r.n_chars, r.md5) for r in rs.merged_digests(table, "k", ["turn"], "text").collect()}
    assert digests == {k: (t.count("\n") + 1, len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in whole.items()}
    documents = {r.k: r.document for r in rs.merged(table, "k", ["turn"], "text", most_chars=40).collect()}
    assert {k: documents[k] for k in (1, 2, 3)} == {1: "a\na\nb", 2: "", 3: None}
    assert rs.merged_digests(table.limit(0), "k", ["turn"], "text").count() == 0


def _texts(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [" ".join(["the", "the", *draw.choices(words, k=draw.randint(1, 9))]) for _ in range(n)] + ["the the", "", "alone"]


@pytest.mark.parametrize("rare", [1, 3])
def test_best_cosine_equals_all_pairs(spark, rare):
    own, other = _texts(1, 40), [t for t in _texts(2, 50) if t != "alone"]
    counts = [Counter(t.split()) for t in own + other]
    df = Counter(w for c in counts for w in c)
    n = len(counts)
    vectors = [{w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in c.items()} for c in counts]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)) if a and b else 0
    want = {k: max(cosine(vectors[k], v) for v in vectors[len(own) :]) for k in range(len(own))}
    make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.best for r in similarity.tf_idf_best(make(own), make(other), "id", "text", rare).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items() if v > 0}


def test_passages_beyond_the_size_that_is_sent(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "A b  c d e f g h"), (3, "x y"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i"), (8, "q r s t u v w x y"), (9, "")], "item_id long, text string")
    for most in (0, 100):
        got = sorted(tuple(r) for r in similarity.passages_found(docs, items, sent_grams=most).collect())
        assert got == [(1, 7, 2, 1.0), (2, 7, 1, 0.5)]


def test_round_robin_keeps_few_rows_before_it_shuffles(spark):
    rows = spark.range(5000).select(F.lit("T1").alias("tier"), (F.col("id") % 3).cast("string").alias("dataset"), F.rand(1).alias("score"), F.col("id").alias("tie"))
    chosen = selection.round_robin(rows, {"T1": 5})
    assert chosen._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2 and chosen.count() == 5

import pytest
from pyspark.sql import functions as F

from docmeter.functions import text as t
from docmeter.lexicons import SYNONYMS, Lexicon
from docmeter.operators import compare, scoring, selection, similarity


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("word, n", [("the", 1), ("table", 2), ("simple", 2), ("create", 1), ("banana", 3), ("rhythm", 1), ("people", 2)])
def test_syllables(spark, word, n):
    assert one(spark, t.syllables(F.col("w")), w=word) == n


def test_readability_of_empty_and_null(spark):
    assert one(spark, t.readability("x")["score"], x="") == 0.5 and one(spark, t.readability(F.lit(None).cast("string"))["score"]) == 0.5


def test_line_citations(spark):
    text = "See line 3, L7-9 and lines 100; html5 counts."
    got = one(spark, t.line_citations("x", F.lit(8)), x=text)
    assert (got.citations, got.valid) == (3, 2)
    assert one(spark, t.line_citations("x", F.lit(8)), x="none")["score"] == 0.5
    assert one(spark, t.line_citations("x"), x="line 5 and line 123456")["citations"] == 1


def test_abstraction_and_sections(spark):
    text = "Overview. It is so because of the input; the output is set in order to ensure."
    assert one(spark, t.section_share("x", Lexicon().sections), x=text) == 0.75
    assert one(spark, t.abstraction("x"), x=text).why == 3  # "in order to" and "to ensure" share a word
    assert one(spark, t.presence_share("x", ("because",), ("is", "has")), x=text) == 0.5


def test_synonyms_and_containment(spark):
    assert one(spark, t.normalised("x", SYNONYMS), x="We  CALCULATE the total-sum, then stop!") == "we compute the add-add then stop"
    assert one(spark, t.containment(t.token_set("a"), t.token_set("b")), a="one two xyz", b="two one more") == pytest.approx(2 / 3)
    assert one(spark, t.bigram_jaccard("a", "b"), a="WS-TOTAL", b="ws-total") == 1.0
    assert one(spark, t.bigram_jaccard("a", "b"), a="a", b="bc") == 0.0


def test_penalties_and_tiers(spark):
    assert one(spark, t.scaled_penalty(F.lit(0.9), 0.8, 0.5)) == pytest.approx(0.25)
    assert one(spark, scoring.penalised(F.lit(0.8), F.lit(0.5), F.lit(0.0))) == pytest.approx(0.4)
    assert [one(spark, scoring.performance_tier(F.lit(s))) for s in (0.6, 0.4, 0.2, 0.1)] == ["excellent", "good", "fair", "poor"]


def test_verdicts(spark):
    none = F.array().cast("array<string>")
    met = one(spark, scoring.verdict(F.lit(0.8), F.lit(0.9), F.lit(0.7), none))
    assert met.passed and met.lcb == pytest.approx(77.0) and met.reason == "All thresholds met"
    missed = one(spark, scoring.verdict(F.lit(0.1), F.lit(0.9), F.lit(0.2), none))
    assert missed.reason == "Failed thresholds: SC (10% < 60%), BF (20% < 55%)"
    stopped = one(spark, scoring.verdict(F.lit(0.8), F.lit(0.9), F.lit(0.7), scoring.gates(scoring.contradiction_gate(F.lit(1), F.lit(1)), scoring.missing_handlers_gate(F.lit(4), F.lit(1)))))
    assert stopped.lcb == 0 and stopped.reason == "Critical failure: CF-03"


def test_gates_and_claims(spark):
    assert one(spark, scoring.external_call_gate(F.lit(1), F.lit(5), F.lit(1))) == "CF-05" and one(spark, scoring.external_call_gate(F.lit(1), F.lit(4), F.lit(1))) is None
    assert one(spark, scoring.undocumented_rules_gate(F.lit(2), F.lit(0))) == "CF-01"
    assert one(spark, scoring.hybrid_claim_score(F.lit(3), F.lit(2), F.lit(9))) == pytest.approx(4 / 6)
    assert one(spark, scoring.behavioural_score(F.lit(0), {"pure": (F.lit(1), F.lit(1.0))})) == 0.0
    assert one(spark, scoring.mixed_score(F.lit(1.0), F.lit(0.0), F.lit(5))) == pytest.approx(0.6)


def test_nesting_never_falls_below_zero(spark):
    code = "END-IF\nIF A\nIF B\nEND-IF\nIF C\nX"
    assert one(spark, selection.nesting_depth("x"), x=code) == 3  # a closing line also opens, as IF stands in END-IF
    assert one(spark, selection.code_lines("x"), x="  * note\n\nMOVE A\n / page\n STOP") == 2


@pytest.mark.parametrize("size, boost, tier", [(100, 0.0, "T1"), (20_000, 0.5, "T2"), (39_999, 1.0, "T3"), (80_000, 2.0, "T4"), (100, 3.5, "T4")])
def test_size_tiers(spark, size, boost, tier):
    assert one(spark, selection.size_tier(F.lit(size), F.lit(boost))) == tier


def test_difficulty(spark):
    score = one(spark, selection.difficulty(F.lit(900), F.lit(15), F.lit(3), F.lit(4), F.lit(9)))
    assert score == pytest.approx(30 * 0.6 + 30 * (0.7 * 0.6 + 0.3 * 0.5) + 20 * 0.6 + 20 * 0.7 + 6.0)
    assert [one(spark, selection.difficulty_level(F.lit(x))) for x in (29.0, 30.0, 60.0)] == ["easy", "medium", "hard"]


def test_free_numbers(spark):
    rows = spark.createDataFrame([("T1", 5.0), ("T1", 4.0), ("T2", 1.0)], "tier string, score double")
    taken = spark.createDataFrame([("T1", 1), ("T1", 3)], "tier string, number int")
    got = {(r.tier, r.score): r.number for r in selection.free_numbers(rows, taken).collect()}
    assert got == {("T1", 4.0): 2, ("T1", 5.0): 4, ("T2", 1.0): 1}


def test_output_comparison(spark):
    rows = [("RESULT: 300", "RESULT:   300\r\n"), ("AMOUNT: 123.456 of the whole account", "AMOUNT: 123.457 of the whole account"), ("TOTAL 200", "other text"), (None, "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = {r.a: r.similarity for r in compare.text_similarity(frame, "a", "b").collect()}
    assert got["RESULT: 300"] == 1 and got[rows[1][0]] == 1 and got["TOTAL 200"] < 0.5 and got[None] == 1
    assert one(spark, compare.gap_share("x"), x="MOVE A\n* note\n[GAP: rule]\n") == 0.5


def test_overlap_measures(spark):
    assert one(spark, similarity.bleu("a", "b"), a="the cat sat on the mat", b="the cat sat on the mat") == pytest.approx(1.0)
    assert 0 < one(spark, similarity.bleu("a", "b"), a="the cat sat", b="the dog sat on the mat") < 0.5
    assert one(spark, similarity.tf_cosine("a", "b"), a="xx yy xx", b="xx yy") == pytest.approx(3 / (5**0.5 * 2**0.5))
    got = one(spark, similarity.set_scores(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B"), F.lit("C"), F.lit("D"))))
    assert (got.precision, got.recall) == (pytest.approx(1 / 3), 0.5)
    assert one(spark, similarity.count_overlap_f1(F.lit(10), F.lit(5))) == pytest.approx(2 * 0.7 * 0.35 / 1.05)

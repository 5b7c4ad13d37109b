"""What grows with the input: tasks in number, not in length; nothing parsed goes to every task."""

import re

import pytest
from pyspark.sql import functions as F

from docmeter import queries as core
from docmeter.operators import board, claims, similarity, verifier
from docmeter.plans.spread import dealt

PARSED = (
    "c12_forward_jumps", "c12_jumps", "c3_lists_of_fields", "c6_expanded_edges", "g24_code_verdicts", "g26_case_verdicts", "g31_code_scores", "m45_static_scores", "g38_range_closure",
    "g43_static_verdicts", "c11_range_successors", "g38_perform_closure", "k4_source_metrics", "c13_complexity", "g12_checked_calls", "g14_checklist_scores", "g58_mixed_scores",
)


@pytest.mark.parametrize("name", PARSED)
def test_parsed_rows_are_not_sent_to_every_task(spark, sf, name):
    joins = [x for x in core.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in x]
    assert len(joins) == name.startswith(("g12", "g14"))  # The checklists, a row for each kind of call.


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark):
    crowded = spark.range(4000, numPartitions=40).filter("id < 100")
    sizes = [r.n for r in dealt(crowded).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) <= 30
    assert dealt(crowded, most=10).rdd.getNumPartitions() == 12


def test_percentages_round_halves_as_sql_does(spark):
    import duckdb

    rows = spark.range(10001).select((F.col("id") / 10000).alias("x"))
    parts = {c: F.col("x") for c in ("avg_lcb_components", "avg_sc", "avg_bf", "avg_dq")}
    tiers = F.create_map().cast("map<string,struct<total:bigint,avg_score:double>>")
    made = rows.select("x", F.lit(1).alias("rank"), F.lit("s").alias("submitter"), F.lit("m").alias("model"), *[v.alias(k) for k, v in parts.items()], tiers.alias("by_tier"), F.lit(1).alias("tasks_total"), F.round(F.col("x") * 10000).cast("int").alias("critical_failures"))
    got = {int(r.critical_failures): r.bf for r in board.summary(made).collect()}
    assert got == dict(duckdb.sql("SELECT k::INT, printf('%.1f', round_even(100 * (k / 10000::DOUBLE), 1)) FROM range(10001) t(k)").fetchall())


def test_patterns_are_tried_on_texts_that_hold_their_core(spark):
    texts = ["The total (`WS-SUM`) is computed from `WS-A`.", "WS-A = WS-B + 2", "the `X-1` equals 5", "nothing here", "", None, "WS-Q must be between 1 and 9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for pattern in (p for ps in claims.CLAIM_PATTERNS.values() for p in ps):
        assert rows.filter(F.col("text").rlike(f"(?im){pattern}") & ~F.col("text").rlike(f"(?im){claims._core(pattern)}")).count() == 0
    plan = claims.claims(rows, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE(text" in plan and {r.id for r in claims.claims(rows, "id", "text").collect()} == {0, 1, 2, 6}


def test_clipped_matches_of_many_equal_words_take_no_square(spark):
    from collections import Counter

    pairs = [(["a"] * 3 + ["b", None], ["a", "a", "b", "b"]), ([], ["a"]), (["x", "x", "y"], ["y", "x", "z"])]
    got = spark.createDataFrame(pairs, "c array<string>, r array<string>").select(similarity.clipped_matches(F.col("c"), F.col("r")).alias("n"))
    assert [r.n for r in got.collect()] == [sum((Counter(c) & Counter(r)).values()) for c, r in pairs]
    assert "filter(" not in got._jdf.queryExecution().analyzed().toString()


def test_a_tests_block_is_cut_once(spark):
    rows = spark.createDataFrame([(1, "IF WS-A = 5 DISPLAY 'X' END-IF.")], "program long, source string")
    plan = verifier.conditionals(rows)._jdf.queryExecution().analyzed().toString()
    assert plan.count("END-IF") == 1


def test_programs_are_cut_in_batches_and_once_for_fields(spark):
    from docmeter.operators import source_code as sc

    text = "       DATA DIVISION.\n       01  WS-A.\n       05  WS-B PIC 9(3).\n           88 OK VALUE 1.\n       05  WS-C PIC X.\n       PROCEDURE DIVISION.\n      * no.\n       A-1.\n           MOVE 1 TO WS-B.  \n\n       END-IF.\n       B-2.\n       PROCEDURE DIVISION.\n       LAST.\n           STOP RUN.\n"
    rows = spark.createDataFrame([(1, text), (2, ">>SOURCE FORMAT IS FREE\nprocedure division.\nx1.\n  GO TO y. *> no"), (3, None), (4, "")], "program long, source string")
    assert [tuple(r) for r in sc.paragraphs(rows).collect()] == [(1, "LAST", 13, 15, " LAST.\n     STOP RUN.\n"), (2, "X1", 2, 3, "x1.\n  GO TO y.")]
    fields = sc.data_fields(rows)
    assert {r.name: (r.line_no, r.parent) for r in fields.collect()} == {"WS-A": (1, None), "WS-B": (2, "WS-A"), "OK": (3, "WS-B"), "WS-C": (4, "WS-A")}
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (fields, sc.paragraphs(rows))]
    assert "Join" not in plans[0] and "Exchange" not in plans[0] and "MapInArrow" in plans[1]


def test_complexity_reads_programs_once(spark, sf):
    plan = core.QUERIES["c13_complexity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_tests_and_actions_are_looked_for_by_their_words(spark):
    text = "IF WS-A = 5 DISPLAY 'X' STOP RUN ELSE MOVE 1 TO B END-IF. XIF WS-B = 1. END-IF WS-C. RE-EVALUATE Q. EVALUATE WS-D WHEN 1 GOBACK WHEN 2 RESET X END-EVALUATE"
    found = verifier.conditionals(spark.createDataFrame([(1, text)], "program long, source string"))
    assert [(r.variable, r.type, r.actions) for r in found.collect()] == [("WS-A", "if_equals", ["stop_run", "display"]), ("WS-D", "evaluate", ["goback"])]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert r"(?<![\w-])" not in plan and "STOP) AND" in plan


def test_unit_paragraphs_are_cut_in_batches(spark):
    from docmeter.operators import ground_truth as gt

    text = "       MAIN.\n       procedure division.\n       A-1.\n       PERFORM B-2.\n      * no\n       STOP.\n      *OLD.\n       b-2.\r\n       CALL 'X'.\n       1C.\n       2D.\u0085\n       MY-SECTION.\n       compute X = Y."
    rows = spark.createDataFrame([(1, text), (2, "A.\nB."), (3, None), (4, "")], "program long, source string")
    units = gt.unit_paragraphs(rows)
    lines = text.split("\n")
    want = [("A-1", 3, 6), ("B-2", 8, 8), ("1C", 10, 9), ("2D", 11, 13)]
    assert [tuple(r) for r in units.collect()] == [(1, n, a, b, "\n".join(lines[a - 1 : b])) for n, a, b in want]
    plan = gt.isolated_units(units)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan.split("MapInArrow")[1]
    assert {r.name: r.blocking_reason for r in gt.isolated_units(units).collect()} == {"A-1": None, "B-2": None, "1C": None, "2D": None}


@pytest.mark.parametrize("lower", [False, True])
def test_isolated_units_by_words_equal_those_by_patterns(spark, lower):
    from docmeter.operators import ground_truth as gt

    bodies = ["A.\n MOVE 1 TO WS-X", "A.\n EXEC  SQL X", "call 'x'", "RECALL X", "CALL", "read\nF", "REWRITE R", "DISPLAY A COMPUTE B = C ADD 1 TO D IF E > 1", "subtract a from b perform c", "GO TO X", "COMPUTER ADD", "restart x"]
    rows = spark.createDataFrame([(k, x.lower() if lower else x) for k, x in enumerate(bodies)], "program long, body string")
    got = gt.isolated_units(rows).select("program", "performs", "inputs", "outputs", "blocking_reason").collect()
    plain = F.coalesce(*[F.when(F.col("body").rlike(f"(?i){p}"), F.lit(r)) for p, r in gt.BLOCKING.items()])
    want = rows.select("program", gt.performed("body"), gt.variables_read("body"), gt.variables_written("body"), plain).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert "EXEC) AND" in gt.isolated_units(rows)._jdf.queryExecution().analyzed().toString()


def test_parts_of_fields_are_taken_in_rows_of_their_own(spark):
    from docmeter.operators import source_code as sc

    text = "       DATA DIVISION.\n       01  A.\n           05  B PIC 9(2) COMP-3 OCCURS 3 TIMES.\n           05  C REDEFINES B PICTURE IS X(4).\n               88  D VALUES ARE 1.\n           77  E-PIC BINARY VALUE 'PIC'."
    fields = sc.data_fields(spark.createDataFrame([(1, text)], "program long, source string"))
    want = [("A", None, None, None, None, None, None), ("B", "9(2)", 3, None, "COMP-3", None, "A"), ("C", "X(4)", None, "B", None, None, "A"), ("D", None, None, None, None, "ARE 1", "C"), ("E-PIC", "BINARY", None, None, "BINARY", "'PIC'", "C")]
    assert [(r.name, r.picture, r.occurs, r.redefines, r.usage, r.value, r.parent) for r in fields.collect()] == want
    assert "OCCURS" not in fields.select("program", "picture")._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_of_source_take_the_whole_text(spark):
    from docmeter.operators import selection

    texts = ["if a\n IF b\nEND-IF\n\r\n\t* x\n/y\n  z", "IFX\nXIF\n-IF-", "", "\n\n", None, "PERFORM X\nUNTIL\nperform y until z * IF", "ſif İF if_ if-1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lines = F.split("text", "\n")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, x):
        up = s["now"] + x.rlike(r"(?i)\bIF\b").cast("int")
        return F.struct(F.when(x.rlike(r"(?i)\bEND-IF\b"), F.greatest(F.lit(0), up - 1)).otherwise(up).alias("now"), F.greatest(s["most"], up).alias("most"))

    plain = [F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^\s*[^\s*/]"))), F.aggregate(lines, start, step, lambda s: s["most"]), F.regexp_count("text", F.lit(r"(?i)\bIF\b"))]
    fast = [selection.code_lines("text"), selection.nesting_depth("text"), selection.count_of("text", r"(?i)\bIF\b")]
    assert [tuple(r) for r in rows.select(*fast).collect()] == [tuple(r) for r in rows.select(*plain).collect()]
    plan = rows.select(*fast)._jdf.queryExecution().analyzed().toString()
    plan = re.sub(r"#\d+L?", "", plan)
    assert "filter(split" not in plan and r"regexp_count(text, (?i)IF(?<=\bIF)\b" in plan and r"RLIKE(lambda x, (?i)\b" not in plan


def test_a_pictures_parts_are_made_once(spark):
    from docmeter.operators import unit_tests as ut

    pictures = ["9(4)V99", "S9(3)", "PIC X(5).", "AAA", "ZZ9", "X(", "", None, "-99", "9V9"]
    rows = spark.createDataFrame([(x,) for x in pictures], "p string").select(ut.picture_range("p").alias("r"))
    want = [("numeric", 0.0, 9999.0), ("numeric", -999.0, 999.0), ("alphanumeric", 0.0, 5.0), ("alphabetic", 0.0, 3.0), ("numeric", 0.0, 999.0), (None, None, None), (None, None, None), (None, None, None), ("numeric", -999.0, 999.0), ("numeric", 0.0, 9.0)]
    assert [tuple(r.r) for r in rows.collect()] == want
    assert rows._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_static_verdicts_deal_texts_once(spark):
    from docmeter.operators import static_claims as st

    rules = spark.createDataFrame([(1, "BR-001", "total of sales", ["SALES-TOTAL", "WS-A"]), (1, "BR-002", "", ["WS-B"]), (2, "BR-001", "other", [])], "program long, rule_id string, description string, keywords array<string>")
    claims = spark.createDataFrame([(1, 0, "The total of sales", "ws-a", ["WS-A"]), (1, 1, "the", None, None), (1, 2, "gone", "WS-Z", []), (1, 3, "unseen", "WS-B", [None]), (3, 0, "total", None, [])], "program long, claim_id int, text string, output_var string, input_vars array<string>")
    names = spark.createDataFrame([(1, "WS-A"), (1, "WS-B")], "program long, name string")
    got = st.statically_verified(claims, names, rules)
    assert {(r.program, r.claim_id): (r.status, r.method) for r in got.collect()} == {(1, 0): ("verified", "tfidf_match"), (1, 1): ("unverified", "no_verification"), (1, 2): ("failed", "variable_check"), (1, 3): ("partial", "variable_existence_only"), (3, 0): ("unverified", "no_verification")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") <= 4 and plan.count("Join") <= 2


def test_documents_are_normalised_once_for_all_their_rules(spark):
    from docmeter.operators import source_code as sc
    from docmeter.plans import evaluation as ev
    from docmeter.plans.programs import programs

    rows = programs(spark, "/root/testdata/sf0.001").limit(40)
    tracks = ev.structural_tracks(rows, ev.parsed(rows))
    plan = tracks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("finalize|closes") <= 2  # Of the document, and of each rule's description.
    assert sc.paragraphs(rows).count() > 0 and tracks.filter("business_rules not between 0 and 1").count() == 0


def test_the_source_is_not_moved_with_each_claim(spark):
    programs = spark.createDataFrame([(1, "MOVE WS-B TO WS-A. IF WS-A = 1 DISPLAY 'X' END-IF. AT END"), (2, None)], "program long, source string")
    claims_ = spark.createDataFrame([(1, "a", "assignment", "", "ws-a", ["WS-B"], None), (1, "b", "error", "", "WS", [], None), (2, "c", "range", "", "WS-A", ["X"], None), (1, "d", "conditional", "", None, ["WS-A"], "shows it")], "program long, claim_id string, claim_type string, text string, output_var string, input_vars array<string>, action string")
    paragraphs = spark.createDataFrame([], "program long, name string, start_line int, end_line int, content string")
    got = verifier.verified_claims(claims_, programs, paragraphs)
    assert {r.claim_id: (r.status, r.method) for r in got.collect()} == {"a": ("verified", "assignment_match"), "b": ("partial", "error_generic"), "c": ("failed", "no_range"), "d": ("verified", "conditional_match")}
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    meets = next(k for k, x in enumerate(plan) if "Join Inner" in x)
    assert "_up#" in plan[meets - 1] and not any("_up#" in x or "source#" in x for x in plan[: meets - 1])


def test_claim_patterns_are_tried_where_their_words_stand(spark):
    made = {p: claims._words(p) for ps in claims.CLAIM_PATTERNS.values() for p in ps}
    assert made[r"`?\(?([\w-]+)\)?`?\s+must\s+be\s+between\s+(\d+)\s+and\s+(\d+)"] == ("between",)
    assert claims._words(r"(?:a|bc)?x") == claims._words(r"ab|cd") == claims._words(r"(?:x(?:ab|cd))?\w+") == claims._words(r"cde?f?[xyz]+") == () and claims._words(r"(?:stores?|is set to)\s+x") == ("store", "is set to")
    texts = ["WS-A IS CALCULATED BY x", "Computes WS-B as y", "`A-1` = B-2 + C-3", "X-1 equals 5", "X-1 is 5 percent of Y-2", "when A-1 Exceeds 5, go", "if the A-1 is 5, go", "for A-1 over 5, go", "VALUE IS STORED IN WS-X", "A-1 gets 5", "valid range for A-1: 1 - 2", "if it fail, stop", "on failure stop", "when an error occurs stop", "error X-1 results in Y", "A-B holds x", "`ab` contain x", "X-1 is the sum of y", "W-1 must be between 1 and 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hit = [F.col("text").rlike(f"(?im){p}") & ~F.coalesce(*[F.when(F.contains(F.lower("text"), F.lit(w)), True) for w in ws], F.lit(False)) for p, ws in made.items() if ws]
    assert rows.filter(F.exists(F.array(*hit), lambda x: x)).count() == 0 and {r.id for r in claims.claims(rows, "id", "text").collect()} == set(range(len(texts)))
    assert "contains(_low" in claims.claims(rows, "id", "text")._jdf.queryExecution().analyzed().toString().lower()


def test_reports_meet_their_sources_in_their_row(spark, sf):
    from docmeter.operators import fuzzy

    texts = [(1, "  move a\tto  b.\r\n\n stop", ["MOVE A TO B. STOP", "MOVE A TO C.\nSTOP", "", "nothing like it"]), (2, None, ["x"]), (3, "a b \x1c", ["A B"]), (4, "x", [])]
    rows = spark.createDataFrame(texts, "program long, source string, codes array<string>").select("program", fuzzy.excerpt_ways(F.col("codes"), "source").alias("ways"))
    assert {r.program: r.ways for r in rows.collect()} == {1: ["exact", "window", "exact", None], 2: [None], 3: ["exact"], 4: []}
    plan = core.QUERIES["d21_matched_excerpts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_windows_are_counted_in_bounded_tables(monkeypatch):
    import numpy as np

    from docmeter.operators import fuzzy

    source = "\n".join(f"MOVE WS-FIELD-{k} TO WS-OTHER-{k * 7 % 13}." for k in range(60))
    excerpt = source[505:540].replace("OTHER", "OTTER", 1) + "€"
    whole = fuzzy.candidate_windows(excerpt, source, 0.5)
    monkeypatch.setattr(fuzzy, "_TABLE", 3 * len(source))
    assert len(whole) > 100 and np.array_equal(fuzzy.candidate_windows(excerpt, source, 0.5), whole) and not fuzzy._SEEN.any()


def test_claims_meet_their_programs_facts_in_one_row(spark):
    source = "A-1.\n IF WS-A = 1 PERFORM B-1. IF WS-A > 2 PERFORM C-1.\nADD 1 TO WS-B. Compute WS-A = WS-B\n * 2 .\nMOVE X Y TO WS-C. MOVE 1 TO WS-C ."
    programs = spark.createDataFrame([(1, source), (2, "")], "program long, source string")
    paragraphs = spark.createDataFrame([(1, "B-1", 1, 2, "GOBACK"), (1, "B-1", 5, 6, "PERFORM C-1"), (1, "C-1", 7, 8, "DISPLAY 'X' PERFORM C-1")], "program long, name string, start_line int, end_line int, content string")
    assert {(r.program, r.name): r.actions for r in verifier.paragraph_actions(paragraphs).collect()} == {(1, "B-1"): ["display", "perform"], (1, "C-1"): ["display", "perform"]}
    assert {(r.variable, r.operation, tuple(r.operands)) for r in verifier.computations(programs).collect()} == {("WS-B", "add", ()), ("WS-A", "compute", ("WS-B",)), ("WS-C", "move", ())}
    claims_ = spark.createDataFrame([(1, "a", "conditional", "", None, ["WS-A"], "shows it"), (1, "b", "range", "", "WS-A", [], None), (1, "c", "calculation", "", "ws-a", ["WS-B", "WS-Q"], None), (2, "d", "conditional", "", None, ["WS-A"], "x"), (2, "e", "calculation", "", "WS-A", [], None)], "program long, claim_id string, claim_type string, text string, output_var string, input_vars array<string>, action string")
    got = verifier.verified_claims(claims_, programs, paragraphs)
    assert {r.claim_id: (r.status, r.method) for r in got.collect()} == {"a": ("verified", "conditional_match"), "b": ("verified", "range_match"), "c": ("partial", "calculation_partial"), "d": ("failed", "no_conditional"), "e": ("failed", "no_computation")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning(") == 5 == plan.count("Exchange hashpartitioning(program")


def test_words_are_counted_once_and_patterns_tried_where_their_words_stand(spark):
    from docmeter.functions import text as t
    from docmeter.lexicons import SYNONYMS
    from docmeter.operators import behaviour, evaluation

    texts = ["the queue ended. a little table, rhythm style ae aee seize ie.e e", "Ünder éle apple\x1cable\tcode", "", None, "since the totals sum; summary errors in order to because of in order  to", "EXEC SQL\nselect A into :B from T. call 'x' read F rewrite G REWRITE", "WS-AB is read from F; a-b is written to C, it holds X-Y. Returns WS-BC and gets Q-1 from"]
    rows = spark.createDataFrame(list(enumerate(texts)), "program long, source string").withColumn("low", F.lower("source"))
    short = r"(?<!\S)\S{1,3}(?!\S)"
    n = lambda x, p: F.regexp_count(x, F.lit(p))
    of_long = lambda x: n(x, "[aeiou]+") - n(x, r"[aeiou]\S*[^aeiou\s][aeiou]*e(?!\S)") + n(x, r"[^aeiou\s]le(?!\S)") + n(x, r"(?<!\S)[^aeiou\s]+(?!\S)")
    plain = "low"
    for base, others in SYNONYMS.items():
        plain = F.regexp_replace(plain, rf"(?<!\w)(?:{'|'.join(others)})(?!\w)", base)
    terms = ("since", "in order to", "sum")
    want = [n("low", short) + of_long(F.regexp_replace("low", short, "")), plain, sum((n(F.coalesce("low", F.lit("")), rf"(?<!\w){x}(?!\w)") for x in terms), F.lit(0))]
    got = [t.syllable_sum("low"), t.expand_synonyms("low", SYNONYMS), t.term_counts("source", terms)]
    assert [tuple(r) for r in rows.select(*got).collect()] == [tuple(r) for r in rows.select(*want).collect()]
    hits = lambda flags, ps: F.flatten(F.array(*[F.regexp_extract_all("source", F.lit(flags + p), 1) for p in ps]))
    calls = rows.select("program", F.explode(F.transform(hits("(?is)", [p for p, _ in behaviour.CALL_PATTERNS.values()]), lambda x: F.upper(x))))
    assert sorted(behaviour.external_calls(rows).select("program", "target").collect()) == sorted(calls.collect())
    named = {r.name for r in evaluation.moved_names(rows.select("program", "source"), "program", "source").collect()}
    assert {"WS-AB", "WS-BC"} == named <= {x.upper() for r in rows.filter("source is not null").select(hits("(?i)", evaluation.IO_PATTERNS).alias("x")).collect() for x in r.x}


def test_unknown_names_meet_the_known_ones_once(spark):
    mentioned = spark.createDataFrame([(1, "WS-TOTAL"), (1, "WS-TOTALS"), (1, "GHOST"), (2, "WS-A"), (2, "WS-A"), (None, "X")], "k int, name string")
    known = spark.createDataFrame([(1, "WS-TOTAL"), (1, None), (3, "WS-A"), (None, "X")], "k int, name string")
    got = claims.unknown_names(mentioned, known, "k")
    assert sorted((r.k or 0, r.name) for r in got.collect()) == [(0, "X"), (1, "GHOST"), (2, "WS-A")]
    assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_cosines_of_claims_are_exact_and_need_one_shuffle(spark):
    from docmeter.operators import static_claims as st

    assert st.near_texts(["a b b", "", "z"], ["b", "a b c d", "", "b b a"], 0.5) == [[(0, 2 / 5**0.5), (1, 3 / (5**0.5 * 2)), (3, 5 / (5**0.5 * 5**0.5))], [], []]
    assert st.near_texts(["a b c d"], ["a x y z"], 0.25) == [[(0, 0.25)]] and st.near_texts(["a"], [], 0.3) == [[]] and st.near_texts([], ["a"], 0.3) == []
    claims_ = spark.createDataFrame([(1, 0, "total of sales"), (1, 1, None)], "program long, claim_id long, text string")
    texts = spark.createDataFrame([(1, "T1", "sales"), (1, "T2", "nothing"), (2, "T3", "sales")], "program long, text_id string, text string")
    pairs = st.candidate_pairs(claims_, texts)
    assert [(r.program, r.claim_id, r.text_id, round(r.cosine, 6)) for r in pairs.collect()] == [(1, 0, "T1", 0.707107)]
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


def test_files_books_and_nodes_are_found_in_one_pass(spark):
    from docmeter.operators import ground_truth as gt

    divisions = spark.createDataFrame([(1, "ENVIRONMENT", "SELECT A-1 ASSIGN TO X. select b assign"), (1, "DATA", " FD A-1.\n FD C.\n XFD D"), (1, "PROCEDURE", "SELECT Z ASSIGN"), (2, "DATA", None)], "program long, name string, content string")
    files = gt.file_dependencies(divisions)
    assert sorted(tuple(r) for r in files.collect()) == [(1, "A-1", True, True), (1, "B", True, False), (1, "C", False, True)]
    assert files._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    edges = files.select("program", F.col("file").alias("dst"), F.lit("file").alias("type"))
    assert sorted(r.node for r in gt.dependency_graph(edges, edges)[1].collect()) == ["1", "A-1", "B", "C"]
    texts = ["       COPY A1.\n      * COPY NO.\n       copy\n      / x\n 'B-2'. *> COPY NOT\n-INC C3\n ++include D4\n EXEC SQL INCLUDE E5 END-EXEC COPY A1", "", None, "123456*COPY X\n12345 *COPY Y"]
    rows = spark.createDataFrame([(x,) for x in texts], "source string").select(gt.copy_books("source").alias("b"))
    assert [r.b for r in rows.collect()] == [["A1", "B-2", "D4", "C3", "E5"], [], None, []]


def test_jumps_are_counted_in_the_programs_row(spark):
    from docmeter.operators import source_code as sc

    text = lambda *parts: "       PROCEDURE DIVISION.\n" + "".join(f"       {n}.\n           {x}.\n" for n, x in parts)
    sources = [text(("A-1", "GO TO C-1. go  to A-1. GO TO NOWHERE"), ("B-1", "MOVE 1 TO GO-TO-X. PERFORM A-1"), ("C-1", "IF X GO TO B-1 GO\nTO UNTIL"), ("A-1", "GO TO C-1")), text(("A-1", "STOP RUN")), "", None]
    paragraphs = sc.paragraphs(spark.createDataFrame(list(enumerate(sources)), "program long, source string"))
    statements = sc.statements(paragraphs)
    got, want = sc.paragraph_jumps(paragraphs), sc.jump_stats(sc.flow_edges(statements), paragraphs, statements)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) != []
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 == plan.count("MapInArrow")


def test_closures_are_followed_in_the_programs_row(spark):
    from docmeter.operators import source_code as sc

    pairs = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "A"), ("E", "E")]
    assert sc.reached(pairs, 1) == set(pairs) and sc.reached(pairs, 2) == set(pairs) | {("A", "C"), ("B", "D"), ("C", "A"), ("D", "B")}
    assert sc.reached(pairs, 9) == {(x, y) for x in "ABCD" for y in "ABCD"} | {("E", "E")} and sc.reached([], 3) == set()
    rows = [(k, a, b, "perform" if k else "perform_through") for k in (0, 1) for a, b in pairs * 2] + [(1, "D", "Z", "goto"), (2, "A", "B", "goto")]
    closed = sc.perform_closure(spark.createDataFrame(rows, "program long, src string, dst string, type string"), 3)
    assert sorted(tuple(r) for r in closed.collect()) == sorted((k, *p) for k in (0, 1) for p in sc.reached(pairs, 3))
    plan = closed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Join" not in plan

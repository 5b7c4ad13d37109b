"""Queries on reports of programs, on tests made from them and on overlap measures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmeter.functions import reports as r
from docmeter.operators import claims as cl
from docmeter.operators import compare, similarity
from docmeter.operators import ground_truth as gt
from docmeter.operators import source_code as sc
from docmeter.operators import unit_tests as ut
from docmeter.functions.text import bigram_jaccard, words
from docmeter.operators.ranges import shuffled
from docmeter.plans.programs import HEAD_LINES, STEPS_SQL, TEXTS_SQL, programs
from docmeter.registry import fixed, query, sql_fixed, table

_T, _S = f"WITH {TEXTS_SQL}", f"WITH {STEPS_SQL}"
_WORDS = r"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _any(found, of="lower(document)") -> str:
    return "(" + " OR ".join(f"contains({of}, '{x}')" for x in found) + ")"


def _share(groups, of="lower(document)") -> str:
    return "(" + " + ".join(f"{_any(x, of)}::INT" for x in groups) + f") / {len(groups)}.0::DOUBLE"


_LINES = "string_split(document, chr(10))"
_HAS = lambda p: f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{p}'))) > 0"


@query("d7_report_layout", rf"{_T} SELECT program, {sql_fixed(_share(r.SECTION_WORDS.values()))} AS sections, {sql_fixed(f'0.3e0 + 0.2e0 + CASE WHEN contains(document, chr(96)) THEN 0.2e0 ELSE 0e0 END + CASE WHEN {_HAS('^[-*] ')} OR {_HAS('^[0-9]+[.] ')} THEN 0.2e0 ELSE 0e0 END + 0.1e0')} AS format, {sql_fixed(f'CASE WHEN w < 20 THEN 0e0 WHEN w < 40 THEN w / 40e0 WHEN w < 80 THEN 1e0 ELSE greatest(0.7e0, 1e0 - (w - 80) / 40e0) END')} AS length, {sql_fixed('CASE WHEN w / 30 < 0.5 THEN w / 30 / 0.5e0 WHEN w / 30 <= 1.5 THEN 1e0 ELSE greatest(0.7e0, 1e0 - (w / 30 - 1.5e0)) END')} AS against FROM (SELECT *, len({_WORDS.format(x='document')}) AS w FROM t)")
def d7(spark, sf_dir):
    n = F.size(words("document"))
    return programs(spark, sf_dir).select("program", fixed(r.section_word_share("document")).alias("sections"), fixed(r.format_quality("document")).alias("format"), fixed(r.length_score(n, 0.08)).alias("length"), fixed(r.length_against(n, F.lit(30))).alias("against"))


@query("d13_sections_and_items", f"{_T} SELECT program, array_to_string(list_filter(['overview', CASE WHEN program % 2 = 0 THEN 'business rules' END, CASE WHEN program % 3 = 0 THEN 'edge cases' END, CASE WHEN program % 5 = 0 THEN 'data structures' END], lambda x: x IS NOT NULL), ',') AS names, CASE WHEN program % 2 = 0 THEN n WHEN program % 3 = 0 THEN 2 ELSE 0 END AS rules, CASE WHEN program % 3 = 0 THEN '2:The CUST-FILE is empty at the end of file.' WHEN program % 2 = 0 THEN n || ':Rule 1: when `WS-FLD-1` exceeds 100, STEP-1 moves 1 to WS-FLAG.' ELSE '0:' END AS edges, {sql_fixed('(1 + 1 + (program % 3 = 0)::INT + (program % 5 = 0 OR program % 2 = 1)::INT + 1) / 5.0::DOUBLE')} AS common FROM t")
def d13(spark, sf_dir):
    rows = programs(spark, sf_dir).withColumns({"s": r.section_list("document"), "rules": r.listed_items("document", "business rule"), "e": r.listed_items("document", "edge case")})
    names = F.transform("s", lambda x: x["name"])
    reference = F.when(F.col("program") % 2 == 0, F.array(F.lit("data structures"), F.lit("edge cases"), F.lit("logic"))).otherwise(F.array(F.lit("edge cases")))
    return rows.select("program", F.array_join(names, ",").alias("names"), F.size("rules").alias("rules"), F.concat(F.size("e").cast("string"), F.lit(":"), F.coalesce(F.get("e", F.lit(0)), F.lit(""))).alias("edges"), fixed(r.common_sections(reference, names)).alias("common"))


_CATEGORIES = _share(r.CATEGORY_WORDS.values())


@query("d16_structural_report", f"{_T} SELECT program, {sql_fixed(f'0.5e0 * ({_CATEGORIES}) + 0.3e0 * least(1.0e0, len({_WORDS.format(x='document')}) / 200e0) + 0.2e0 * (0.5e0 + 0.25e0 + CASE WHEN {_HAS('^[-*] ')} THEN 0.25e0 ELSE 0e0 END)')} AS score FROM t")
def d16(spark, sf_dir):
    return programs(spark, sf_dir).select("program", fixed(r.structural_report("document")).alias("score"))


_NAMES = r"regexp_extract_all(document, '\b([A-Z][A-Z0-9-]+)\b', 1)"


@query("d17_semantic_report", rf"{_T}, w AS (SELECT *, len({_WORDS.format(x='document')}) AS w, len(regexp_split_to_array(document, '[.!?]')) AS sentences, {_NAMES} AS names, len(string_split(source, chr(10))) AS lines FROM t) SELECT program, {sql_fixed(f'((CASE WHEN w / sentences BETWEEN 10 AND 25 THEN 1e0 WHEN w / sentences BETWEEN 5 AND 35 THEN 0.7e0 ELSE 0.4e0 END) + len(list_filter(names, lambda x: contains(upper(source), x))) / len(names) + least(1e0, w / greatest(lines, 50)) + (0.4e0 + 0.2e0 * (1 + ({_HAS('^[0-9]+[.]? +')})::INT + ({_HAS('^[-*] ')})::INT))) / 4e0')} AS score FROM w")
def d17(spark, sf_dir):
    return programs(spark, sf_dir).select("program", fixed(r.semantic_report("document", "source")).alias("score"))


_L = f"({HEAD_LINES + 3} + 4 * n)"


@query("d18_citation_report", f"{_T}, c AS (SELECT program, n, 1 + CASE WHEN program % 5 = 0 THEN 2 ELSE 0 END AS citations, (program % 9 BETWEEN 1 AND n)::INT + CASE WHEN program % 5 = 0 THEN (program % 60 >= 1 AND program % 60 + 3 <= {_L})::INT + (program % 97 BETWEEN 1 AND {_L})::INT ELSE 0 END AS valid FROM t) SELECT program, citations, valid, {sql_fixed('greatest(0e0, valid / citations - least(0.3e0, (citations - valid) * 0.1e0))')} AS score FROM c")
def d18(spark, sf_dir):
    report = r.citation_report("document", "source")
    return programs(spark, sf_dir).select("program", report["citations"].alias("citations"), report["valid"].alias("valid"), fixed(report["score"]).alias("score"))


@query("d20_references", f"{_T}, c AS (SELECT program, n, 1 + CASE WHEN program % 5 = 0 THEN 3 ELSE 0 END AS total, (program % 9 BETWEEN 1 AND n)::INT + CASE WHEN program % 5 = 0 THEN (program % 60 BETWEEN 1 AND {_L})::INT + (program % 97 BETWEEN 1 AND {_L})::INT + (program % 60 >= 1 AND program % 60 + 3 <= {_L})::INT ELSE 0 END AS valid FROM t) SELECT program, total, CASE WHEN total > 1 THEN 'line_number:2,line_range:1,paragraph:1' ELSE 'paragraph:1' END AS kinds, valid, {sql_fixed('valid / total')} AS score FROM c")
def d20(spark, sf_dir):
    rows = programs(spark, sf_dir)
    names = sc.paragraphs(rows).groupBy("program").agg(F.collect_set("name").alias("names"))
    rows = rows.join(shuffled(names), "program").withColumn("found", r.references("document"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("valid", r.valid_references(F.col("found"), F.size(F.split("source", "\n")), F.col("names"), none, none))
    kinds = F.transform(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["type"]))), lambda k: F.concat(k, F.lit(":"), F.size(F.filter("found", lambda x: x["type"] == k)).cast("string")))
    return rows.select("program", F.size("found").alias("total"), F.array_join(kinds, ",").alias("kinds"), F.size("valid").alias("valid"), fixed(r.reference_score(F.col("found"), F.col("valid"))).alias("score"))


@query("d25_copied_comments", f"{_T} SELECT program, 1 AS comments, CASE WHEN program % 4 = 0 THEN 1e0 ELSE 0e0 END AS parroting, program % 7 = 0 AS contaminated FROM t")
def d25(spark, sf_dir):
    report = F.concat("document", F.when(F.col("program") % 4 == 0, F.concat(F.lit("TOTALS of batch "), F.col("program").cast("string"))).otherwise(""), F.when(F.col("program") % 7 == 0, " seen-mark-17").otherwise(""))
    rows = programs(spark, sf_dir).withColumn("report", report)
    return rows.select("program", F.size(r.comments("source")).alias("comments"), r.parroting("report", "source").alias("parroting"), r.contaminated("report", ("SEEN-MARK-17", "OTHER-MARK-3")).alias("contaminated"))


_FIELDS = "list_transform(range(1, n + 1), lambda k: 'WS-FLD-' || k)"


@query("e11_mentioned_elements", f"{_T} SELECT program, CASE WHEN program % 2 = 0 THEN 1e0 ELSE 0e0 END AS fields, 1e0 AS split_name, {sql_fixed('(CASE WHEN program % 2 = 0 THEN n ELSE 0 END + (program % 5 = 0)::INT) / (n + 1)')} AS named, program % 2 = 0 OR program % 3 = 0 AS flagged, {sql_fixed('CASE WHEN program % 3 = 0 THEN 1e0 ELSE 0e0 END')} AS handlers FROM t")
def e11(spark, sf_dir):
    rows = programs(spark, sf_dir)
    fields = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat(F.lit("WS-FLD-"), k.cast("string")))
    keywords = F.when(F.col("program") % 2 == 0, F.array(F.lit("ws-flag"), F.lit("exceeds"), F.lit("unseen"))).otherwise(F.array(F.lit("cust-file"), F.lit("invalid key")))
    return rows.select(
        "program", r.mentioned_share("document", fields).alias("fields"), r.mentioned_share("document", F.array(F.lit("THIS-PROGRAM-UNKNOWN"))).alias("split_name"), fixed(r.named_share("document", F.concat(F.array(F.lit("WS-AREA")), fields))).alias("named"),
        r.rule_mentioned("document", keywords).alias("flagged"), fixed(r.handlers_share("document", F.array(F.lit("invalid_key"), F.lit("end_of_file"), F.lit("invalid_key")))).alias("handlers"),
    )


@query("e21_priority_scores", f"SELECT l_orderkey, {sql_fixed('0.70e0 * coalesce(count(*) FILTER (WHERE l_returnflag = chr(82) AND l_quantity > 25) / nullif(count(*) FILTER (WHERE l_returnflag = chr(82)), 0), 1e0) + 0.30e0 * coalesce(count(*) FILTER (WHERE l_returnflag = chr(65) AND l_quantity > 25) / nullif(count(*) FILTER (WHERE l_returnflag = chr(65)), 0), 1e0)')} AS score FROM lineitem GROUP BY l_orderkey")
def e21(spark, sf_dir):
    is_of = lambda flag: F.col("l_returnflag") == flag
    hit = F.col("l_quantity") > 25
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(is_of("R")).alias("c"), F.count_if(is_of("R") & hit).alias("ch"), F.count_if(is_of("A")).alias("i"), F.count_if(is_of("A") & hit).alias("ih"))
    return counts.select("l_orderkey", fixed(r.priority_score(F.col("c"), F.col("ch"), F.col("i"), F.col("ih"))).alias("score"))


@query("e24_invented_and_opposite", f"{_T} SELECT program, CASE WHEN contains(source, (program % 11)::VARCHAR) THEN '' ELSE (program % 11)::VARCHAR END AS invented, CASE WHEN program % 2 = 0 THEN 'WS-FLAG' ELSE '' END AS opposite FROM t")
def e24(spark, sf_dir):
    operations = F.array(F.struct(F.lit("DIVIDE").alias("type"), F.lit("WS-FLAG").alias("variable")), F.struct(F.lit("ADD").alias("type"), F.lit("WS-FLAG").alias("variable")))
    return programs(spark, sf_dir).select("program", F.array_join(r.invented_numbers("document", "source"), ",").alias("invented"), F.array_join(r.contradictions("document", operations), ",").alias("opposite"))


# Claims and names


@query("f4_claims", f"""{_S} SELECT program, 'CLM-' || printf('%03d', k) AS claim_id, 'conditional' AS claim_type, 'when `WS-FLD-' || k || '` exceeds 100, STEP-' || k || ' moves 1 to WS-FLAG.' AS text, 'STEP-' || k AS output_var, 'WS-FLD-' || k || ',WS-FLAG,STEP,FLAG' AS input_vars, 'STEP-' || k || ' moves 1 to WS-FLAG.' AS action FROM s WHERE program % 2 = 0
UNION ALL SELECT program, 'CLM-' || printf('%03d', 1 + CASE WHEN program % 2 = 0 THEN n ELSE 0 END), 'assignment', '`WS-AREA` holds the fields. See lines ' || (program % 60) || '-' || (program % 60 + 3) || ' and line ' || (program % 97) || '.', 'WS-AREA', 'FIELDS,LINES,LINE', NULL FROM p WHERE program % 5 = 0""")
def f4(spark, sf_dir):
    found = cl.claims(programs(spark, sf_dir).select("program", "document"), "program", "document")
    return found.withColumn("input_vars", F.array_join("input_vars", ","))


@query("f3_unknown_names", f"{_S}, m AS (SELECT program, unnest(['WS-FLAG', 'CUST-FILE', 'WS-FLD-' || k || 'X', 'OTHER-' || k]) AS name FROM s) SELECT DISTINCT program, name FROM m WHERE name LIKE 'OTHER-%'")
def f3(spark, sf_dir):
    rows = programs(spark, sf_dir).select("program", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    text = F.col("k").cast("string")
    mentioned = rows.select("program", F.explode(F.array(F.lit("WS-FLAG"), F.lit("CUST-FILE"), F.concat(F.lit("WS-FLD-"), text, F.lit("X")), F.concat(F.lit("OTHER-"), text))).alias("name"))
    known = rows.select("program", F.explode(F.array(F.lit("ws-flag").cast("string"), F.lit("CUST-FILE"), F.concat(F.lit("WS-FLD-"), text))).alias("name")).withColumn("name", F.upper("name"))
    return cl.unknown_names(mentioned, known, "program")


# Tests


@query("h7_boundary_cases", f'''{_S} SELECT program, 'WS-FLD-' || k AS field, c AS variant, CASE c WHEN 'maximum' THEN 10e0 ** (k + 1) - 1 ELSE 0e0 END AS value FROM (SELECT *, unnest(['minimum', 'maximum', 'zero']) AS c FROM s)''')
def h7(spark, sf_dir):
    return ut.boundary_cases(sc.data_fields(programs(spark, sf_dir)))


@query("h8_branch_cases", f'''{_S}, i AS (SELECT program, 'FLD' || k || ' ' || ['>', '<', '=', '>=', '<='][1 + k % 5] || ' ' || (k * 10) AS condition, k, ['>', '<', '=', '>=', '<='][1 + k % 5] AS op FROM s) SELECT program, condition, c AS variant, 'FLD' || k AS variable, (k * 10 + CASE WHEN c = 'true' THEN CASE op WHEN '>' THEN 1 WHEN '<' THEN -1 ELSE 0 END ELSE CASE op WHEN '>' THEN -1 WHEN '<' THEN 1 WHEN '=' THEN 1 WHEN '>=' THEN -1 ELSE 1 END END)::VARCHAR AS value FROM (SELECT *, unnest(['true', 'false']) AS c FROM i)''')
def h8(spark, sf_dir):
    rows = programs(spark, sf_dir).select("program", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    op = F.get(F.array(*[F.lit(x) for x in (">", "<", "=", ">=", "<=")]), F.col("k") % 5)
    return ut.branch_cases(rows.select("program", F.concat_ws(" ", F.concat(F.lit("FLD"), F.col("k").cast("string")), op, (F.col("k") * 10).cast("string")).alias("condition")))


@query("h9_typical_and_error_inputs", f"{_S} SELECT program, 'WS-FLD-' || k AS field, floor((10e0 ** (k + 1) - 1) / 2) AS value, CASE k % 4 WHEN 0 THEN 'FILE-STATUS=35' WHEN 1 THEN 'DIVISOR=0' WHEN 2 THEN 'AMOUNT=999999999' ELSE 'ERROR-FLAG=Y' END AS error FROM s WHERE k <= 5")
def h9(spark, sf_dir):
    rows = ut.typical_inputs(sc.data_fields(programs(spark, sf_dir)))
    k = F.regexp_extract("field", r"(\d+)$", 1).cast("int") % 4
    condition = F.when(k == 0, "FILE STATUS").when(k == 1, "ON ZERO").when(k == 2, "ON OVERFLOW").otherwise("AT END")
    error = ut.error_input(F.lit("any"), condition)
    return rows.withColumn("error", F.concat_ws("=", error["variable"], error["value"]))


@query("h5_formula_values", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {sql_fixed('CASE l_linenumber % 7 WHEN 0 THEN l_quantity * l_tax * 1e0 WHEN 1 THEN CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END WHEN 2 THEN l_quantity - l_tax WHEN 3 THEN l_quantity + l_tax WHEN 4 THEN l_quantity / 100e0 * l_tax WHEN 5 THEN l_quantity + l_tax END')} AS value FROM lineitem")
def h5(spark, sf_dir):
    text = F.get(F.array(*[F.lit(x) for x in ("the product of A and B", "A divided by B", "A minus B", "sum of A and B", "A percent of B", "computes A of B", "nothing")]), F.col("l_linenumber") % 7)
    value = ut.formula_value(text, F.array("l_quantity", "l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fixed(value).alias("value"))


@query("h13_first_tests", "SELECT l_orderkey, least(count(*), 3) AS kept, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') >= 3 THEN 1 ELSE 0 END AS urgent_only FROM lineitem GROUP BY l_orderkey")
def h13(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("priority", F.when(F.col("l_returnflag") == "R", 1).otherwise(2))
    kept = ut.first_tests(rows, "l_orderkey", 3, "priority", "l_partkey", "l_suppkey", "l_linenumber")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), (F.count_if(F.col("priority") == 1) >= 3).cast("int").alias("urgent_only"))


@query("h16_runnable_and_gaps", f"{_T} SELECT program, program % 6 <> 0 AS runnable, CASE WHEN program % 4 = 0 THEN '2:total unknown' ELSE '' END AS gaps FROM t")
def h16(spark, sf_dir):
    rows = programs(spark, sf_dir)
    source = F.concat("source", F.when(F.col("program") % 6 == 0, "\n           EXEC  CICS RETURN END-EXEC.").otherwise(""))
    code = F.concat(F.lit("MOVE 1 TO A\n"), F.when(F.col("program") % 4 == 0, "* [GAP: total unknown ] here").otherwise("DONE"))
    return rows.select("program", ut.can_run(source).alias("runnable"), F.array_join(F.transform(ut.gap_list(code), lambda g: F.concat(g["line_no"].cast("string"), F.lit(":"), g["description"])), ",").alias("gaps"))


@query("h23_batch_verdicts", f"WITH r AS (SELECT l_orderkey, l_suppkey % 11 <> 0 AS l, CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE l_suppkey % 13 <> 0 END AS r, l_discount * 9.6 AS s, l_partkey % 9 = 0 AS g FROM lineitem), c AS (SELECT l_orderkey, count(*) AS tests, count(*) FILTER (WHERE coalesce(l AND r AND s >= 0.95, false)) AS matches, count(*) FILTER (WHERE NOT coalesce(l AND r, false)) AS errors, bool_or(g) AS gaps, bool_or(r IS NULL) AS unequal FROM r GROUP BY l_orderkey) SELECT l_orderkey, tests, CASE WHEN unequal THEN 0 ELSE matches END AS matches, CASE WHEN unequal THEN 1 ELSE errors END AS errors, CASE WHEN unequal THEN 0e0 ELSE {sql_fixed('matches / tests')} END AS score, CASE WHEN unequal THEN 'Result count mismatch' ELSE array_to_string(list_filter([CASE WHEN (tests - matches) / tests >= 0.10 THEN 'CF-03' END, CASE WHEN matches / tests >= 0.95 AND gaps THEN 'CF-06' END], lambda x: x IS NOT NULL), ',') END AS failures FROM c")
def h23(spark, sf_dir):
    key = F.col("l_suppkey")
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", (key % 11 != 0).alias("left_ok"), F.when(key % 41 != 0, key % 13 != 0).alias("right_ok"), (F.col("l_discount") * 9.6).alias("similarity"), (F.col("l_partkey") % 9 == 0).alias("gaps"))
    out = ut.batch_verdict(runs, "l_orderkey")
    return out.withColumns({"score": fixed(F.col("score")), "failures": F.array_join("failures", ",")})


@query("h21_file_similarity", f"{_T} SELECT program, {sql_fixed('CASE WHEN program % 4 = 0 THEN 1e0 WHEN program % 4 = 1 THEN 0e0 WHEN program % 4 = 2 THEN 1 / 2 * 1e0 ELSE 2 / 2 * 0.5e0 END')} AS score FROM t")
def h21(spark, sf_dir):
    files = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    case = F.col("program") % 4
    none = F.create_map().cast("map<string,string>")
    left = F.when(case == 0, none).otherwise(files("a", "one\ntwo  three", "b", "two"))
    right = F.when(case == 0, none).when(case == 1, files("c", "x")).when(case == 2, files("a", "one\r\ntwo three", "c", "y")).otherwise(files("a", "one\ntwo three", "b", "other"))
    rows = programs(spark, sf_dir).select("program", left.alias("l"), right.alias("r"))
    equal = lambda x, y: (compare.normal_output(x) == compare.normal_output(y)).cast("double")
    return rows.select("program", fixed(ut.file_similarity(F.col("l"), F.col("r"), equal)).alias("score"))


# Overlap

_TOKENS = _WORDS.format(x="lower(document)")


@query("l1_rouge", rf"{_T}, w AS (SELECT program, {_TOKENS} AS a FROM t), x AS (SELECT program, a, list_filter(range(1, len(a) + 1), lambda i: i % 3 <> 0) AS keep FROM w), y AS (SELECT program, a, list_transform(keep, lambda i: a[i]) AS b FROM x) SELECT program, {sql_fixed('2 * len(b) / (len(a) + len(b))')} AS rouge_1, {sql_fixed('2 * len(b) / (len(a) + len(b))')} AS rouge_l FROM y")
def l1(spark, sf_dir):
    rows = programs(spark, sf_dir).select("program", words(F.lower("document")).alias("a"))
    rows = rows.withColumn("b", F.filter("a", lambda x, i: (i + 1) % 3 != 0))
    common = lambda x, y: similarity.clipped_matches(F.col(y), F.col(x))
    return rows.select("program", fixed(ut.f_measure(common("a", "b"), F.size("a"), F.size("b"))).alias("rouge_1"), fixed(ut.f_measure(ut.longest_common("a", "b"), F.size("a"), F.size("b"))).alias("rouge_l"))


@query("l7_set_scores", f"{_S}, b AS (SELECT program, list_distinct(list_concat(['COMMON' || (program % 4)], list(CASE kind WHEN 4 THEN 'SUBP' || k END) FILTER (WHERE kind = 4))) AS truth FROM s GROUP BY program), f AS (SELECT program, truth, ['COMMON' || (program % 3), 'SUBP' || (program % 7)] AS found FROM b), h AS (SELECT program, len(list_intersect(truth, found)) AS hits, len(truth) AS t FROM f) SELECT program, {sql_fixed('hits / 2')} AS precision, {sql_fixed('hits / t')} AS recall, {sql_fixed('CASE WHEN hits = 0 THEN 0e0 ELSE 2 * (hits / 2) * (hits / t) / ((hits / 2) + (hits / t)) END')} AS f1, {sql_fixed('CASE WHEN t = 0 THEN 0e0 ELSE 2 * ((0.7e0 * least(t, 2)) / 2) * ((0.7e0 * least(t, 2)) / t) / (((0.7e0 * least(t, 2)) / 2) + ((0.7e0 * least(t, 2)) / t)) END')} AS counted FROM h")
def l7(spark, sf_dir):
    rows = programs(spark, sf_dir)
    called = sc.calls(sc.statements(sc.paragraphs(rows))).filter("not is_dynamic").groupBy("program").agg(F.collect_set("callee").alias("callees"))
    rows = rows.join(shuffled(called), "program", "left").withColumn("truth", F.array_distinct(F.concat(gt.copy_books("source"), F.coalesce("callees", F.array().cast("array<string>")))))
    found = F.array(F.concat(F.lit("COMMON"), (F.col("program") % 3).cast("string")), F.concat(F.lit("SUBP"), (F.col("program") % 7).cast("string")))
    scores = similarity.set_scores(F.col("truth"), found)
    return rows.select("program", *[fixed(scores[k]).alias(k) for k in ("precision", "recall", "f1")], fixed(similarity.count_overlap_f1(F.size("truth"), F.lit(2))).alias("counted"))


@query("f2_name_similarity", f"WITH b AS (SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b FROM part), g AS (SELECT p_partkey, a, b, list_distinct(list_transform(range(1, len(a)), lambda i: a[i:i + 1])) AS x, list_distinct(list_transform(range(1, len(b)), lambda i: b[i:i + 1])) AS y FROM b) SELECT p_partkey, {sql_fixed('CASE WHEN a = b THEN 1e0 ELSE coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0e0) END')} AS similarity FROM g")
def f2(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fixed(bigram_jaccard("p_name", "p_type")).alias("similarity"))

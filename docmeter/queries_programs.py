"""Queries over programs made of orders, and their SQL: what the texts hold is known from how they are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmeter.operators import behaviour
from docmeter.operators import ground_truth as gt
from docmeter.operators import evaluation as ev
from docmeter.operators import scoring, verifier
from docmeter.operators import source_code as sc
from docmeter.plans.evaluation import evaluated
from docmeter.plans.routed import routed_evaluation
from docmeter.plans.programs import FIXED_LINES, HEAD_LINES, STEPS_SQL, TEXTS_SQL, programs
from docmeter.document_sql import scored_sql
from docmeter.lexicons import THRESHOLDS, Lexicon
from docmeter.operators.checklists import KIND_WORDS
from docmeter.operators.ranges import shuffled
from docmeter.registry import fixed, query, sql_fixed

_S, _T = f"WITH {STEPS_SQL}", f"WITH {TEXTS_SQL}"
#: First line (from 0) of a step's paragraph, and last line of a program.
_AT, _LAST = f"{FIXED_LINES} + 2 * n + 2 * (k - 1)", f"{FIXED_LINES - 1} + 4 * n"


def _statements(spark, sf_dir):
    return sc.statements(sc.paragraphs(programs(spark, sf_dir)))


@query("b1_formats_and_names", f"{_T} SELECT program, false AS is_free, 'PRG_' || program AS program_id, ['COMMON' || (program % 4)] AS books, len(string_split(source, chr(10))) AS lines, len(string_split(source, chr(10))) - 1 AS code_lines FROM t")
def b1(spark, sf_dir):
    rows = programs(spark, sf_dir)
    cleaned = sc.clean_lines("source")
    return rows.select("program", sc.free_format("source").alias("is_free"), sc.program_id("source").alias("program_id"), gt.copy_books("source").alias("books"), F.size(cleaned).alias("lines"), F.size(F.filter(cleaned, lambda x: x != "")).alias("code_lines"))


@query("b2_clean_lines", rf"{_T} SELECT program, md5(array_to_string(list_transform(string_split(source, chr(10)), lambda x: CASE WHEN x[7] = '*' THEN '' ELSE x[7:] END), chr(10))) AS cleaned FROM t")
def b2(spark, sf_dir):
    return programs(spark, sf_dir).select("program", F.md5(F.array_join(sc.clean_lines("source"), "\n").cast("binary")).alias("cleaned"))


@query("b3_divisions", f"{_S} SELECT program, unnest([{{name: 'IDENTIFICATION', a: 0, b: 2}}, {{name: 'ENVIRONMENT', a: 3, b: 5}}, {{name: 'DATA', a: 6, b: {HEAD_LINES - 1} + n}}, {{name: 'PROCEDURE', a: {HEAD_LINES} + n, b: {_LAST}}}], recursive := true) FROM p")
def b3(spark, sf_dir):
    return sc.divisions(programs(spark, sf_dir)).select("program", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))


@query("b4_sections", f"{_S} SELECT program, unnest([{{name: 'INPUT-OUTPUT', a: 4, b: 5}}, {{name: 'WORKING-STORAGE', a: 7, b: {HEAD_LINES - 1} + n}}], recursive := true) FROM p")
def b4(spark, sf_dir):
    return sc.sections(programs(spark, sf_dir)).select("program", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))


@query("b5_paragraphs", f"{_S} SELECT program, 'MAIN-LOGIC' AS name, {HEAD_LINES + 1} + n AS a, {FIXED_LINES - 1} + 2 * n AS b FROM p UNION ALL SELECT program, 'STEP-' || k, {_AT}, {_AT} + 1 FROM s")
def b5(spark, sf_dir):
    return sc.paragraphs(programs(spark, sf_dir)).select("program", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))


@query("b7_statements", f"{_S} SELECT program, 'MAIN-LOGIC' AS paragraph, i AS statement_no, CASE WHEN i = 0 THEN 'MAIN-LOGIC' WHEN i <= n THEN 'PERFORM STEP-' || i ELSE 'STOP RUN' END AS head, {HEAD_LINES + 1} + n + i AS line_no FROM (SELECT program, n, unnest(range(n + 2)) AS i FROM p) UNION ALL SELECT program, 'STEP-' || k, i, CASE WHEN i = 0 THEN 'STEP-' || k ELSE ['COMPUTE', 'IF', 'IF', 'ADD', 'CALL', 'CALL', 'READ', 'GO', 'EXEC', 'MOVE'][kind + 1] END, {_AT} + i FROM (SELECT *, unnest([0, 1]) AS i FROM s)")
def b7(spark, sf_dir):
    head = F.when((F.col("paragraph") == "MAIN-LOGIC") | (F.col("statement_no") == 0), F.col("statement")).otherwise(F.split_part("statement", F.lit(" "), F.lit(1)))
    return _statements(spark, sf_dir).select("program", "paragraph", "statement_no", head.alias("head"), "line_no")


@query("b8_unit_paragraphs", f"{_S} SELECT program, 'MAIN-LOGIC' AS name, {HEAD_LINES + 2} + n AS line_start, {FIXED_LINES - 1} + 2 * n AS line_end FROM p UNION ALL SELECT program, 'STEP-' || k, {_AT} + 1, CASE WHEN k = n THEN {_AT} + 2 ELSE {_AT} + 1 END FROM s")
def b8(spark, sf_dir):
    return gt.unit_paragraphs(programs(spark, sf_dir)).select("program", "name", "line_start", "line_end")


_PARTS = f"u AS (SELECT program, 'MAIN-LOGIC' AS name, n AS performs, '' AS inputs, '' AS outputs, NULL AS reason, CASE WHEN n > 5 THEN 0.2e0 WHEN n > 2 THEN 0.35e0 ELSE 0.5e0 END AS score, n + 1 AS size FROM p UNION ALL SELECT program, 'STEP-' || k, CASE WHEN k = n AND kind = 2 THEN 1 ELSE 0 END, CASE WHEN k = n AND kind = 9 THEN 'ZEROS' ELSE '' END, CASE WHEN k < n THEN '' WHEN kind IN (0, 9) THEN 'WS-FLD-' || k WHEN kind = 1 THEN 'WS-FLAG' WHEN kind = 3 THEN 'WS-TOTAL' WHEN kind = 6 THEN 'WS-EOF' ELSE '' END, CASE WHEN k < n THEN NULL WHEN kind IN (4, 5) THEN 'External program call (CALL)' WHEN kind = 6 THEN 'File read operation' WHEN kind = 8 THEN 'Database operation (EXEC SQL)' END, CASE WHEN k < n OR kind = 7 THEN 0.5e0 WHEN kind = 2 THEN 0.65e0 WHEN kind IN (4, 5, 6, 8) THEN 0.0e0 ELSE 0.75e0 END, CASE WHEN k = n THEN 2 ELSE 1 END FROM s)"


def _units(spark, sf_dir):
    return gt.isolated_units(gt.unit_paragraphs(programs(spark, sf_dir)))


@query("g51_isolated_units", f"{_S}, {_PARTS} SELECT program, name, performs, inputs, outputs, reason, {sql_fixed('score')} AS score FROM u")
def g51(spark, sf_dir):
    join = lambda x: F.array_join(x, ",")
    return _units(spark, sf_dir).select("program", "name", F.size("performs").alias("performs"), join("inputs").alias("inputs"), join("outputs").alias("outputs"), F.col("blocking_reason").alias("reason"), fixed(F.col("isolation_score")).alias("score"))


@query("g53_unit_totals", f"{_S}, {_PARTS} SELECT program, count(*) AS paragraphs, sum(size)::BIGINT AS lines, count(*) FILTER (WHERE performs > 0) AS performing, sum(performs)::BIGINT AS performs, count(*) FILTER (WHERE reason IS NULL) AS isolated, {sql_fixed('avg(score) FILTER (WHERE reason IS NULL)')} AS mean_score, CASE WHEN count(*) FILTER (WHERE reason IS NULL) = count(*) THEN 'FULLY_EXECUTABLE' ELSE 'PARTIALLY_EXECUTABLE' END AS class FROM u GROUP BY program")
def g53(spark, sf_dir):
    return gt.unit_totals(_units(spark, sf_dir)).withColumn("mean_score", fixed(F.col("mean_score"))).drop("mean_lines", "isolated_percent")


@query("m56_blockers", f"{_S}, {_PARTS} SELECT program, reason AS blocking_reason, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY ALL")
def m56(spark, sf_dir):
    return gt.blockers(_units(spark, sf_dir))


# Ground truth


@query("c1_data_fields", f"{_S}, f AS (SELECT program, {HEAD_LINES - 1} AS line_no, 1 AS level, 'WS-AREA' AS name, NULL AS picture, NULL AS occurs, NULL AS usage, NULL AS parent, NULL AS digits FROM p UNION ALL SELECT program, {HEAD_LINES - 1} + k, 5, 'WS-FLD-' || k, '9(' || (k + 1) || ')V99', CASE WHEN k % 3 = 0 THEN k END, CASE WHEN k % 2 = 0 THEN 'COMP-3' END, 'WS-AREA', k + 3 FROM s) SELECT program, line_no, level, name, picture, occurs, usage, parent, CASE WHEN usage = 'COMP-3' THEN digits // 2 + 1 ELSE digits END AS bytes FROM f")
def c1(spark, sf_dir):
    return sc.data_fields(programs(spark, sf_dir)).drop("redefines", "value")


@query("c6_flow_edges", f"{_S} SELECT program, 'MAIN-LOGIC' AS src, 'STEP-' || k AS dst, 'perform' AS type, {HEAD_LINES + 1} + n + k AS line_no FROM s UNION ALL SELECT program, 'STEP-' || k, 'STEP-1', CASE kind WHEN 2 THEN 'perform' ELSE 'goto' END, {_AT} + 1 FROM s WHERE kind IN (2, 7)")
def c6(spark, sf_dir):
    return sc.flow_edges(_statements(spark, sf_dir))


@query("c11_flow_graph", f"{_S}, e AS (SELECT program, 'MAIN-LOGIC' AS src, 'STEP-' || k AS dst FROM s UNION SELECT program, 'STEP-' || k, 'STEP-1' FROM s WHERE kind IN (2, 7)) SELECT program, src, array_to_string(list_sort(list(dst)), ',') AS successors FROM e GROUP BY ALL")
def c11(spark, sf_dir):
    paragraphs = sc.paragraphs(programs(spark, sf_dir))
    return sc.flow_graph(sc.flow_edges(sc.statements(paragraphs)), paragraphs).withColumn("successors", F.array_join("successors", ","))


@query("c12_jumps", f"{_S}, j AS (SELECT program, n, count(*) FILTER (WHERE kind = 7) AS gotos FROM s GROUP BY ALL) SELECT program, n + 2 + 2 * n AS statements, gotos, 0 AS forward, {sql_fixed('gotos / (3 * n + 2)')} AS density, gotos / (3 * n + 2) > 0.15 AS spaghetti FROM j")
def c12(spark, sf_dir):
    return sc.paragraph_jumps(sc.paragraphs(programs(spark, sf_dir))).withColumn("density", fixed(F.col("density")))


@query("c13_complexity", f"{_S} SELECT program, n + count(*) FILTER (WHERE kind IN (2, 7)) AS complexity FROM s GROUP BY program, n")
def c13(spark, sf_dir):
    return gt.complexity(_statements(spark, sf_dir))


_RULES = """r AS (SELECT program, k, kind, row_number() OVER (PARTITION BY program ORDER BY k) AS i, CASE kind WHEN 0 THEN 'complex_formula' WHEN 1 THEN 'threshold_check' WHEN 2 THEN 'validation_rule' ELSE 'accumulation' END AS rule_type, CASE kind WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'IMPORTANT' ELSE 'TRIVIAL' END AS priority,
  CASE kind WHEN 3 THEN 0.90e0 ELSE 0.95e0 END AS confidence, CASE kind WHEN 0 THEN list_sort(list_distinct(['WS-FLD-' || k, 'WS-FLD-1'])) WHEN 1 THEN ['WS-FLAG', 'WS-FLD-' || k] WHEN 2 THEN ['STEP-1', 'WS-CODE'] ELSE ['WS-FLD-' || k, 'WS-TOTAL'] END AS keywords,
  CASE kind WHEN 0 THEN 'Mathematical calculation: WS-FLD-' || k || ' = WS-FLD-1 * 3' WHEN 1 THEN 'Threshold comparison: WS-FLD-' || k || ' > 100' WHEN 2 THEN 'Value validation: WS-CODE = A' ELSE 'Running total/accumulation: ADD WS-FLD-' || k || ' TO WS-TOTAL' END AS description FROM s WHERE kind <= 3)"""


@query("c14_business_rules", f"{_S}, {_RULES} SELECT program, printf('BR-%03d', i) AS rule_id, 'STEP-' || k AS paragraph, rule_type, priority, confidence, description, array_to_string(list_sort(keywords), ',') AS keywords FROM r")
def c14(spark, sf_dir):
    rules = sc.business_rules(_statements(spark, sf_dir))
    return rules.select("program", "rule_id", "paragraph", "rule_type", "priority", "confidence", gt.rule_description(F.col("rule_type"), F.col("statement")).alias("description"), F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@query("c18_rule_totals", f"{_S}, {_RULES} SELECT program, count(*) AS rules, count(*) FILTER (WHERE priority = 'CRITICAL') AS critical, count(*) FILTER (WHERE priority = 'IMPORTANT') AS important, count(*) FILTER (WHERE priority = 'TRIVIAL') AS trivial, count(*) AS high_confidence, {sql_fixed('avg(confidence)')} AS mean_confidence, array_to_string(list_sort(list_distinct(list(rule_type))), ',') AS rule_types, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords FROM r GROUP BY program")
def c18(spark, sf_dir):
    out = gt.rule_totals(sc.business_rules(_statements(spark, sf_dir)))
    return out.withColumns({"mean_confidence": fixed(F.col("mean_confidence")), "rule_types": F.array_join("rule_types", ","), "keywords": F.array_join("keywords", ",")}).drop("medium_confidence")


@query("m20_rule_groups", f"{_S}, {_RULES} SELECT program, lower(priority) AS rule_group, array_to_string(list_sort(list(printf('BR-%03d', i))), ',') AS rule_ids FROM r GROUP BY program, priority")
def m20(spark, sf_dir):
    return gt.rule_groups(sc.business_rules(_statements(spark, sf_dir)), "priority").withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("c19_error_handlers", f"{_S} SELECT program, 'MAIN-LOGIC' AS paragraph, {HEAD_LINES + 2} + 2 * n AS line_no, 'program_termination' AS type FROM p UNION ALL SELECT program, 'STEP-' || k, {_AT} + 1, 'end_of_file' FROM s WHERE kind = 6")
def c19(spark, sf_dir):
    return sc.error_handlers(_statements(spark, sf_dir))


@query("c20_calls", f"{_S} SELECT program, 'STEP-' || k AS paragraph, {_AT} + 1 AS line_no, CASE kind WHEN 4 THEN 'SUBP' || k ELSE 'WS-PGM' END AS callee, kind = 5 AS is_dynamic, CASE kind WHEN 4 THEN 'WS-AREA,WS-FLD-' || k ELSE 'WS-AREA' END AS parameters, CASE WHEN kind = 5 THEN 'unverifiable' WHEN k <= 2 THEN 'in_scope' ELSE 'external' END AS class FROM s WHERE kind IN (4, 5)")
def c20(spark, sf_dir):
    rows = sc.calls(_statements(spark, sf_dir)).withColumn("parameters", F.array_join("parameters", ","))
    return rows.withColumn("class", sc.call_class(F.col("callee"), F.col("is_dynamic"), F.col("callee").isin("SUBP1", "SUBP2")))


@query("c23_files", f"{_S} SELECT program, 'CUST-FILE' AS file, true AS selected, false AS has_fd, (SELECT count(*) FROM s WHERE s.program = p.program AND kind = 6) AS reads FROM p")
def c23(spark, sf_dir):
    rows = programs(spark, sf_dir)
    reads = gt.file_operations(sc.statements(sc.paragraphs(rows))).filter("operation = 'READ'").groupBy("program", "file").agg(F.count("*").alias("reads"))
    return gt.file_dependencies(sc.divisions(rows)).join(shuffled(reads), ["program", "file"], "left").fillna(0, ["reads"])


@query("c26_dependency_graph", f"{_S}, e AS (SELECT program, CASE kind WHEN 4 THEN 'SUBP' || k ELSE 'WS-PGM' END AS dst FROM s WHERE kind IN (4, 5) UNION SELECT program, 'COMMON' || (program % 4) FROM p UNION SELECT program, 'CUST-FILE' FROM p) SELECT program, dst AS node FROM e UNION ALL SELECT program, program::VARCHAR FROM p")
def c26(spark, sf_dir):
    rows = programs(spark, sf_dir)
    edge = lambda frame, name, kind: frame.select("program", F.col(name).alias("dst"), F.lit(kind).alias("type"))
    books = rows.select("program", F.explode(gt.copy_books("source")).alias("book"))
    return gt.dependency_graph(edge(sc.calls(sc.statements(sc.paragraphs(rows))), "callee", "call"), edge(books, "book", "copy"), edge(gt.file_dependencies(sc.divisions(rows)), "file", "file"))[1]


@query("c29_ground_truth", f"{_T}, s AS (SELECT program, (program + k) % 10 AS kind FROM (SELECT program, unnest(range(1, n + 1)) AS k FROM t)), c AS (SELECT program, count(*) FILTER (WHERE kind <= 3) AS rules, count(*) FILTER (WHERE kind IN (4, 5)) AS calls FROM s GROUP BY program) SELECT program, len(string_split(source, chr(10))) AS lines, sha256(source) AS source_hash, n + 1 AS paragraphs, n + 1 AS fields, rules, calls FROM t JOIN c USING (program)")
def c29(spark, sf_dir):
    rows = programs(spark, sf_dir)
    paragraphs = sc.paragraphs(rows)
    statements = sc.statements(paragraphs)
    return gt.assembled(rows, paragraphs=paragraphs, fields=sc.data_fields(rows), rules=sc.business_rules(statements), calls=sc.calls(statements))


@query("c34_detected_calls", f"{_S} SELECT program, unnest(CASE kind WHEN 4 THEN [{{type: 'CALL_STATIC', category: 'CALL', target: 'SUBP' || k}}] WHEN 5 THEN [{{type: 'CALL_DYNAMIC', category: 'CALL', target: 'WS-PGM'}}] WHEN 6 THEN [{{type: 'FILE_READ', category: 'FILE', target: 'CUST-FILE'}}] WHEN 8 THEN [{{type: 'EXEC_SQL_SELECT', category: 'SQL', target: 'NAME INTO :WS-N FROM CUSTOMERS'}}] ELSE [] END, recursive := true) FROM s")
def c34(spark, sf_dir):
    return gt.detected_calls(programs(spark, sf_dir))


@query("c35_call_summary", f"{_S} SELECT program, count(*) FILTER (WHERE kind IN (4, 5, 6, 8)) AS calls, count(*) FILTER (WHERE kind = 8) AS sql, 0 AS cics, count(*) FILTER (WHERE kind IN (4, 5)) AS call, count(*) FILTER (WHERE kind = 6) AS file, count(*) FILTER (WHERE kind IN (4, 5, 8)) AS evaluable FROM s GROUP BY program")
def c35(spark, sf_dir):
    rows = programs(spark, sf_dir)
    return gt.call_summary(rows, gt.detected_calls(rows))


@query("c37_line_of_call", f"{_T} SELECT program, strpos(source, 'PERFORM') - 1 AS place, len(string_split(source[:strpos(source, 'PERFORM') - 1], chr(10))) AS line FROM t")
def c37(spark, sf_dir):
    place = F.instr("source", "PERFORM") - 1
    return programs(spark, sf_dir).select("program", place.alias("place"), gt.line_of("source", place).alias("line"))


@query("g1_paragraph_classes", f"{_S} SELECT program, 'MAIN-LOGIC' AS name, 'INFRASTRUCTURE' AS class FROM p UNION ALL SELECT program, 'STEP-' || k, CASE WHEN kind IN (0, 1, 2) THEN 'PURE' ELSE 'INFRASTRUCTURE' END FROM s")
def g1(spark, sf_dir):
    return sc.paragraphs(programs(spark, sf_dir)).select("program", "name", sc.paragraph_class("name", "content").alias("class"))


@query("g38_perform_closure", f"{_S}, e AS (SELECT program, 'MAIN-LOGIC' AS src, 'STEP-' || k AS dst FROM s UNION SELECT program, 'STEP-' || k, 'STEP-1' FROM s WHERE kind = 2) SELECT program, src, dst FROM e UNION SELECT a.program, a.src, b.dst FROM e a JOIN e b ON a.program = b.program AND a.dst = b.src")
def g38(spark, sf_dir):
    return sc.perform_closure(sc.flow_edges(_statements(spark, sf_dir)))


@query("g6_call_coverage", f"{_T}, s AS (SELECT program, document, k, (program + k) % 10 AS kind FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM t)), c AS (SELECT program, contains(upper(document), CASE kind WHEN 4 THEN 'SUBP' || k WHEN 5 THEN 'WS-PGM' WHEN 6 THEN 'CUST' ELSE 'CUSTOMERS' END) AND (kind IN (4, 5) OR (kind = 6 AND (contains(lower(document), 'read') OR contains(lower(document), 'input') OR contains(lower(document), 'file')))) AS hit FROM s WHERE kind IN (4, 5, 6, 8)) SELECT t.program, count(hit) AS total, count(*) FILTER (WHERE hit) AS matched FROM t LEFT JOIN c USING (program) GROUP BY t.program")
def g6(spark, sf_dir):
    rows = programs(spark, sf_dir)
    return behaviour.call_coverage(behaviour.external_calls(rows), rows, "program", "document").select("program", "total", "matched")


# Claims held against code

_CLAIMS = (
    ("calculation", "'WS-FLD-' || CAST(1 + program % n AS STRING)", "'WS-FLD-1'", "''"), ("conditional", "NULL", "'WS-FLD-' || CAST(1 + program % n AS STRING)", "'moves one to a flag'"), ("assignment", "'WS-FLAG'", "'WS-X'", "''"),
    ("error", "'WS-EOF'", "NULL", "''"), ("range", "'WS-FLD-' || CAST(1 + program % n AS STRING)", "NULL", "''"), ("other", "'WS-AREA'", "'WS-NONE'", "''"), ("conditional", "NULL", "'WS-CODE'", "'shows a warning'"), ("calculation", "'WS-NONE'", "NULL", "''"), ("calculation", "NULL", "'WS-AREA'", "''"),
)


def program_claims(spark, sf_dir):
    """A claim of each kind for every program."""
    rows = programs(spark, sf_dir)
    claim = lambda i, c: F.struct(F.lit(i).alias("claim_id"), F.lit(c[0]).alias("claim_type"), F.lit("a claim").alias("text"), F.expr(c[1]).cast("string").alias("output_var"), F.filter(F.array(F.expr(c[2]).cast("string")), lambda v: v.isNotNull()).alias("input_vars"), F.expr(c[3]).alias("action"))
    return rows.select("program", F.inline(F.array(*[claim(i, c) for i, c in enumerate(_CLAIMS)])))


_VERDICTS = """k AS (SELECT program, n, 1 + program % n AS k, (program + 1 + program % n) % 10 AS kind, (program + 1) % 10 AS first FROM p),
x AS (SELECT k.program, k.kind, k.first, bool_or(s.kind = 1) AS flag, bool_or(s.kind = 6) AS eof, bool_or(s.kind = 2) AS code FROM k JOIN s USING (program) GROUP BY ALL),
v AS (SELECT program, unnest([
  {claim_id: 0, status: CASE WHEN kind = 0 THEN 'verified' ELSE 'partial' END, confidence: CASE kind WHEN 0 THEN 1.0e0 WHEN 9 THEN 0.5e0 ELSE 0.3e0 END},
  {claim_id: 1, status: CASE WHEN kind = 1 THEN 'verified' ELSE 'partial' END, confidence: CASE kind WHEN 1 THEN 1.0e0 ELSE 0.3e0 END},
  {claim_id: 2, status: CASE WHEN flag THEN 'partial' ELSE 'failed' END, confidence: CASE WHEN flag THEN 0.7e0 ELSE 0.0e0 END},
  {claim_id: 3, status: CASE WHEN eof THEN 'partial' ELSE 'unverified' END, confidence: CASE WHEN eof THEN 0.5e0 ELSE 0.2e0 END},
  {claim_id: 4, status: 'partial', confidence: CASE kind WHEN 1 THEN 0.6e0 ELSE 0.3e0 END},
  {claim_id: 5, status: 'partial', confidence: 0.3e0},
  {claim_id: 6, status: CASE WHEN code THEN 'partial' ELSE 'failed' END, confidence: CASE WHEN code THEN 0.6e0 ELSE 0.0e0 END},
  {claim_id: 7, status: 'failed', confidence: 0.0e0},
  {claim_id: 8, status: 'partial', confidence: 0.4e0}], recursive := true) FROM x)"""


def _verified(spark, sf_dir):
    rows = programs(spark, sf_dir)
    return verifier.verified_claims(program_claims(spark, sf_dir), rows, sc.paragraphs(rows))


@query("g24_code_verdicts", f"{_S}, {_VERDICTS} SELECT program, claim_id, status, confidence FROM v")
def g24(spark, sf_dir):
    return _verified(spark, sf_dir).drop("method")


@query("g31_code_scores", f"{_S}, {_VERDICTS}, c AS (SELECT program, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) AS claims FROM v GROUP BY program) SELECT program, verified, partial, claims, {sql_fixed('least(1.0e0, (verified + 0.5e0 * partial) / 6.0e0)')} AS score FROM c")
def g31(spark, sf_dir):
    count = lambda x: F.count_if(F.col("status") == x).alias(x)
    rows = _verified(spark, sf_dir).groupBy("program").agg(count("verified"), count("partial"), F.count("*").alias("claims"))
    return rows.withColumn("score", fixed(scoring.hybrid_claim_score(F.col("verified"), F.col("partial"), F.col("claims"))))


@query("g32_computations", f"{_S} SELECT program, CASE kind WHEN 1 THEN 'WS-FLAG' WHEN 3 THEN 'WS-TOTAL' WHEN 6 THEN 'WS-EOF' ELSE 'WS-FLD-' || k END AS variable, CASE kind WHEN 0 THEN 'compute' WHEN 3 THEN 'add' ELSE 'move' END AS operation, CASE kind WHEN 0 THEN 'WS-FLD-1' WHEN 3 THEN 'WS-FLD-' || k ELSE '' END AS operands FROM s WHERE kind IN (0, 1, 3, 6, 9)")
def g32(spark, sf_dir):
    return verifier.computations(programs(spark, sf_dir)).withColumn("operands", F.array_join("operands", ","))


@query("g34_conditionals", f"{_S}, e AS (SELECT program, list_distinct(flatten(list(CASE kind WHEN 0 THEN ['compute'] WHEN 1 THEN ['move'] WHEN 2 THEN ['perform'] WHEN 3 THEN ['compute'] WHEN 4 THEN ['call'] WHEN 5 THEN ['call'] WHEN 6 THEN ['read', 'move'] WHEN 9 THEN ['move'] ELSE [] END))) AS first FROM s WHERE k = 1 GROUP BY program) SELECT program, CASE kind WHEN 1 THEN 'WS-FLD-' || k ELSE 'WS-CODE' END AS variable, CASE kind WHEN 1 THEN 'if_greater' ELSE 'if_equals' END AS type, CASE kind WHEN 1 THEN 'move' ELSE array_to_string(list_sort(list_distinct(list_append(CASE WHEN k > 1 THEN first ELSE first END, 'perform'))), ',') END AS deep FROM s JOIN e USING (program) WHERE kind IN (1, 2)")
def g34(spark, sf_dir):
    rows = programs(spark, sf_dir)
    found = verifier.deep_conditionals(verifier.conditionals(rows), verifier.paragraph_actions(sc.paragraphs(rows)))
    return found.select("program", "variable", "type", F.array_join(F.array_sort("deep_actions"), ",").alias("deep"))


@query("g42_usages", f"{_T} SELECT program, array_to_string(list_filter(range(1, len(string_split(source, chr(10))) + 1), lambda i: regexp_matches(string_split(source, chr(10))[i], '\\bWS-FLD-1\\b')), ',') AS lines, contains(source, 'WS-FLAG') AS flag FROM t")
def g42(spark, sf_dir):
    return programs(spark, sf_dir).select("program", F.array_join(verifier.usage_lines("source", F.lit("WS-FLD-1")), ",").alias("lines"), verifier.variable_exists("source", F.lit("ws-flag")).alias("flag"))


# Full evaluation

_EVALUATED = f"""
x AS (SELECT program, n, program % 2 = 0 AS even, count(*) FILTER (WHERE kind <= 1) AS high, count(*) FILTER (WHERE kind = 2) AS mid, count(*) FILTER (WHERE kind = 3) AS low, count(*) FILTER (WHERE kind <= 2) AS pure,
  count(*) FILTER (WHERE kind = 4) AS static, count(*) FILTER (WHERE kind = 4 AND program % 7 = k) AS static_hit, count(*) FILTER (WHERE kind = 6) AS reads, count(*) FILTER (WHERE kind = 6 AND (program % 2 = 0 OR program % 3 = 0 OR program % 9 = k)) AS reads_hit,
  count(*) FILTER (WHERE kind IN (4, 5, 6, 8)) AS calls, count(*) FILTER (WHERE (kind = 4 AND program % 7 = k) OR (kind = 6 AND program % 3 = 0)) AS matched, CASE WHEN program % 2 = 0 THEN n ELSE 0 END + (program % 5 = 0)::INT AS claims FROM s GROUP BY program, n),
y AS (SELECT *, CASE WHEN high + mid + low = 0 THEN 1e0 WHEN even THEN (3 * high + low) / (3 * high + 2 * mid + low) ELSE 0e0 END AS rules, (CASE WHEN even THEN n ELSE 0 END + (program % 5 = 0)::INT) / (n + 1) AS fields,
  (CASE WHEN even THEN n ELSE (program % 9 BETWEEN 1 AND n)::INT END) / (n + 1) AS flow, (static_hit + (program % 3 = 0)::INT) / (static + 1) AS external, CASE WHEN calls = 0 THEN 1e0 ELSE matched / calls END AS bsm, CASE WHEN claims >= 5 THEN 0.6e0 ELSE 0.4e0 END AS w FROM x),
z AS (SELECT *, 0.40e0 * rules + 0.25e0 * fields + 0.20e0 * flow + 0.15e0 * external AS sc, CASE WHEN claims < 1 THEN 0e0 ELSE (pure * 1e0 + (n + 1 - pure) * (w + (1 - w) * bsm)) / (n + 1) END AS bf,
  list_filter([CASE WHEN high > 0 AND NOT even THEN 'CF-01' END, CASE WHEN reads_hit < greatest(1, (1 + reads) // 2) THEN 'CF-04' END, CASE WHEN calls >= 5 AND claims > 0 AND matched / calls < 0.30 THEN 'CF-05' END], lambda c: c IS NOT NULL) AS failures FROM y)"""


_QUALITY = f"""q AS (WITH {scored_sql(Lexicon(), "SELECT program AS doc_id, document AS text, lower(document) AS low, regexp_replace(document, '[^A-Za-z0-9_. ]', ' ', 'g') AS plain, len(string_split(source, chr(10))) AS n_lines FROM t")} SELECT doc_id AS program, dq FROM scored)"""
_MISSED = lambda k, least: f"CASE WHEN {k} < {least}e0 THEN '{k.upper()} (' || printf('%.0f', 100 * {k}) || '% < {100 * least:.0f}%)' END"
#: From ``program, sc, dq, bf, failures`` of ``w``.
_FINAL = f"""missed AS (SELECT *, concat_ws(', ', {', '.join(_MISSED(k, v) for k, v in THRESHOLDS.items())}) AS missed FROM w), final AS (SELECT *, CASE WHEN len(failures) > 0 THEN 0e0 ELSE {sql_fixed('100 * (0.30e0 * sc + 0.20e0 * dq + 0.50e0 * bf)')} END AS lcb, len(failures) = 0 AND missed = '' AS passed,
  CASE WHEN len(failures) > 0 THEN 'Critical failure: ' || failures[1] WHEN missed = '' THEN 'All thresholds met' ELSE 'Failed thresholds: ' || missed END AS reason FROM missed)"""
_TRACKS = {"business_rules": "rules", "data_structures": "fields", "control_flow": "flow", "external_calls": "external", "sc": "sc", "dq": "dq", "bf": "bf", "lcb": "lcb"}
_FIXED = ", ".join(f"{sql_fixed(c)} AS {c}" for c in ("sc", "dq", "bf"))


@query("i21_full_evaluation", f"WITH {STEPS_SQL}, {TEXTS_SQL}, {_EVALUATED}, {_QUALITY}, w AS (SELECT z.*, q.dq FROM z JOIN q USING (program)), {_FINAL} SELECT program, claims, {sql_fixed('rules')} AS rules, {sql_fixed('fields')} AS fields, {sql_fixed('flow')} AS flow, {sql_fixed('external')} AS external, {_FIXED}, lcb, array_to_string(failures, ',') AS failures, passed, reason FROM final")
def i21(spark, sf_dir):
    out = evaluated(programs(spark, sf_dir))
    return out.select("program", "claims", *[fixed(F.col(k)).alias(v) for k, v in _TRACKS.items()], F.array_join("failures", ",").alias("failures"), "passed", "reason")


#: Tests of the claims of a report: two for each rule, one more for the sentence on data; a test's run fails for one in three.
_TESTED = """k AS (SELECT program, n, CASE WHEN program % 2 = 0 THEN n ELSE 0 END AS rules, (program % 5 = 0)::INT AS other FROM p), j AS (SELECT *, unnest(range(1, 2 * rules + other + 1)) AS test_no FROM k),
r AS (SELECT program, count(*) FILTER (WHERE test_no <> 5 AND (program + test_no) % 3 <> 0) AS ran, count(*) FILTER (WHERE test_no <> 5 AND (program + test_no) % 3 = 0) AS fell FROM j GROUP BY program)"""


def _runs(spark, sf_dir):
    """A run for each test number but 5."""
    rows = programs(spark, sf_dir).select("program", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4, *range(6, 16))])).alias("test_no"))
    fine = (F.col("program") + F.col("test_no")) % 3 != 0
    return rows.select("program", "test_no", fine.alias("success"), F.lit("nothing to see").alias("stdout"), F.when(~fine, "abend S0C7").alias("error"))


_EXECUTED = f"""x2 AS (SELECT z.*, coalesce(ran, 0) AS ran, coalesce(fell, 0) AS fell, pure, n + 1 - pure AS infra FROM z LEFT JOIN r USING (program)),
y2 AS (SELECT *, CASE WHEN claims = 0 THEN 1e0 WHEN ran = 0 AND z_skipped + fell > 0 THEN 1e0 WHEN ran + fell = 0 THEN 0.5e0 ELSE ran / (ran + fell) END AS score, ran = 0 AND z_skipped + fell > 0 AS by_form FROM (SELECT x2.*, (SELECT count(*) FROM j WHERE j.program = x2.program AND test_no = 5) AS z_skipped FROM x2)),
w AS (SELECT program, claims, sc, dq, CASE WHEN claims = 0 THEN 0e0 ELSE (pure * score + infra * (w + (1 - w) * bsm)) / (n + 1) END AS bf,
  list_filter([CASE WHEN high > 0 AND NOT even THEN 'CF-01' END, CASE WHEN claims > 0 AND pure > 0 AND NOT by_form AND fell >= 0.5 * (ran + fell + infra_claims) THEN 'CF-03' END, CASE WHEN reads_hit < greatest(1, (1 + reads) // 2) THEN 'CF-04' END, CASE WHEN calls >= 5 AND claims > 0 AND matched / calls < 0.30 THEN 'CF-05' END], lambda c: c IS NOT NULL) AS failures
  FROM (SELECT *, CASE WHEN infra > 0 THEN claims ELSE 0 END AS infra_claims FROM y2 JOIN q USING (program)))"""


@query("i21_with_executions", f"WITH {STEPS_SQL}, {TEXTS_SQL}, {_EVALUATED}, {_QUALITY}, {_TESTED}, {_EXECUTED}, {_FINAL} SELECT program, claims, {_FIXED}, lcb, array_to_string(failures, ',') AS failures, passed, reason FROM final")
def i21_executed(spark, sf_dir):
    out = evaluated(programs(spark, sf_dir), executions=_runs(spark, sf_dir))
    return out.select("program", "claims", *[fixed(F.col(k)).alias(k) for k in ("sc", "dq", "bf", "lcb")], F.array_join("failures", ",").alias("failures"), "passed", "reason")


def _compilations(spark, sf_dir):
    """First runs: fine, a missing book, none, a compiler's error; and for some a failure after compiling."""
    kind = F.col("program") % 4
    rows = programs(spark, sf_dir).filter(kind != 2)
    error = F.when(F.col("program") % 8 == 4, "abend S0C7").when(kind == 1, "error: copybook COMMON1 not found").when(kind == 3, "fatal error near STEP-1")
    return rows.select("program", error.isNull().alias("success"), error.alias("error"))


_MENTIONED = lambda t, kind: f"(contains(upper(document), {t}) OR contains(upper(document), substr({t}, 1, 6))) AND (" + " OR ".join(f"contains(lower(document), '{w}')" for w in KIND_WORDS[kind]) + ")"
_ROUTED = f"""m AS (SELECT program, count(*) FILTER (WHERE kind IN (4, 5, 6, 8)) AS all_calls, count(*) FILTER (WHERE CASE kind WHEN 4 THEN {_MENTIONED("'SUBP' || k", 'call')} WHEN 5 THEN {_MENTIONED("'WS-PGM'", 'call')} WHEN 6 THEN {_MENTIONED("'CUST'", 'file')} WHEN 8 THEN {_MENTIONED("'CUSTOMERS'", 'sql')} ELSE false END) AS said FROM s JOIN (SELECT program, document FROM t) USING (program) GROUP BY program),
v AS (SELECT k.program, k.rules + k.other AS claims, 2 * k.rules + k.other AS tests, CASE WHEN k.rules > 0 THEN (SELECT count(*) FROM s WHERE s.program = k.program AND kind = 1) ELSE 0 END AS verified, CASE WHEN all_calls = 0 THEN 1e0 ELSE said / all_calls END AS call_score, all_calls, said, coalesce(ran, 0) AS ran FROM k JOIN m USING (program) LEFT JOIN r USING (program)),
o AS (SELECT *, CASE WHEN claims = 0 THEN 'error' WHEN program % 4 = 0 THEN 'executed' ELSE 'static' END AS mode, CASE WHEN claims = 0 THEN 'silence_penalty' WHEN program % 4 = 0 THEN 'compiled' WHEN program % 4 = 1 THEN 'copybook_missing' WHEN program % 4 = 2 THEN 'execution_disabled' ELSE 'other' END AS mode_reason, CASE program % 4 WHEN 1 THEN true WHEN 3 THEN false END AS fixable FROM v),
w AS (SELECT o.program, o.claims, o.tests, o.mode, o.mode_reason, o.fixable, o.all_calls, o.said, z.sc, q.dq, CASE o.mode WHEN 'error' THEN 0e0 WHEN 'executed' THEN 0.6e0 * (ran / tests) + 0.4e0 * call_score ELSE 0.6e0 * least(1e0, (verified + 0.5e0 * (o.claims - verified)) / 6e0) + 0.4e0 * call_score END AS bf,
  list_filter(list_concat(z.failures, [CASE WHEN o.mode = 'error' THEN 'CF-03' END]), lambda c: c IS NOT NULL AND c <> 'CF-05') AS failures FROM o JOIN z USING (program) JOIN q USING (program))"""


@query("i22_routed_evaluation", f"WITH {STEPS_SQL}, {TEXTS_SQL}, {_EVALUATED}, {_QUALITY}, {_TESTED}, {_ROUTED}, {_FINAL} SELECT program, claims, tests, mode, mode_reason, fixable, all_calls AS calls, said AS matched, {_FIXED}, lcb, array_to_string(failures, ',') AS failures, passed, reason FROM final")
def i22(spark, sf_dir):
    out = routed_evaluation(programs(spark, sf_dir), _compilations(spark, sf_dir), _runs(spark, sf_dir))
    return out.select("program", "claims", "tests", "mode", "mode_reason", "fixable", "calls", "matched", *[fixed(F.col(k)).alias(k) for k in ("sc", "dq", "bf", "lcb")], F.array_join("failures", ",").alias("failures"), "passed", "reason")


@query("g7_names_in_other_words", f"{_S} SELECT program, k, k = 1 OR k >= 5 AS named FROM s WHERE k <= 6")
def g7(spark, sf_dir):
    cases = [("The CUSTOMERS.DAT file", "customer-file", "file"), ("The STOCK list", "CUSTOMER-FILE", "file"), ("the account list", "ACCTUPD", "program"), ("a message", "MQOPEN", "middleware"), ("See ACCOUNT-UPDATE and more", "ACCTUPDP", "program"), ("It opens the queue", "'MQOPEN'", "middleware")]
    cases[4] = ("See ACCOUNTUPD and more", "ACCTUPDP", "program")
    rows = programs(spark, sf_dir).select("program", F.posexplode(F.slice(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("dtc", c, strict=True)]) for c in cases]), F.lit(1), F.col("n").cast("int"))).alias("i", "x"))
    return rows.select("program", (F.col("i") + 1).alias("k"), ev.target_named("x.d", "x.t", "x.c").alias("named"))


@query("i2_invented_names", f"{_S} SELECT program, 'WS-GHOST-' || program AS name FROM p WHERE program % 3 = 0")
def i2(spark, sf_dir):
    from docmeter.operators import claims

    rows = programs(spark, sf_dir)
    number = F.col("program").cast("string")
    text = F.concat(F.lit("WS-FLD-1 is read from the file. Non-Zero is sent to it, and END-IF is read from there. It writes PROCESS-ROUTINE to disk. "), F.when(F.col("program") % 3 == 0, F.concat(F.lit("It returns WS-GHOST-"), number)).otherwise("It returns WS-FLD-2"))
    moved = ev.moved_names(rows.select("program", text.alias("text")), "program", "text")
    return claims.unknown_names(moved, sc.data_fields(rows).select("program", "name"), "program")

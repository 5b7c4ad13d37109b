"""Further queries over programs made of orders: source metrics, outputs, bounds, normal texts, copy books, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docmeter.functions import text as t
from docmeter.lexicons import SYNONYMS, WHAT, WHY
from docmeter.operators import behaviour, board, claims, compare, selection, similarity
from docmeter.operators import ground_truth as gt
from docmeter.operators import source_code as sc
from docmeter.operators import unit_tests as ut
from docmeter.operators.ranges import shuffled
from docmeter.plans.programs import STEPS_SQL, TEXTS_SQL, programs
from docmeter.registry import fixed, query, sql_fixed, table
from docmeter.sources import results as rs

_T, _S = f"WITH {TEXTS_SQL}", f"WITH {STEPS_SQL}"
_W = selection.SCORE_WEIGHTS
_STEP = lambda x, steps, beyond: "CASE " + " ".join(f"WHEN {x} < {b} THEN {v}e0" for b, v in steps) + f" ELSE {beyond}e0 END"
_HARD = (
    f"30 * ({_STEP('loc', [(300, 0.0)], 0.2)}) + 30 * (0.7e0 * ({_STEP('complexity', [(5, 0.0), (10, 0.3)], 0.6)}) + 0.3e0 * ({_STEP('nesting', [(2, 0.0), (4, 0.5)], 1.0)})) + 20 * ({_STEP('deps', [(1, 0.0), (3, 0.3)], 0.6)}) + 20 * ({_STEP('rules', [(3, 0.0), (8, 0.4)], 0.7)}) + least(rules / 15e0, 1e0) * 10"
)


@query("k4_source_metrics", f"{_S}, m AS (SELECT program, 12 + 4 * n AS loc, count(*) FILTER (WHERE kind IN (1, 2)) AS nesting, 1 + count(*) FILTER (WHERE kind IN (1, 2)) AS complexity, count(*) FILTER (WHERE kind = 4) AS deps, count(*) FILTER (WHERE kind = 6) AS files, count(*) FILTER (WHERE kind = 7) AS gotos, count(*) FILTER (WHERE kind = 8) AS sql, count(*) FILTER (WHERE kind <= 3) AS rules FROM s GROUP BY program, n) SELECT program, loc, complexity, nesting, deps, gotos, sql, round({_HARD}, 2) AS difficulty, CASE WHEN {_HARD} < 30 THEN 'easy' ELSE 'medium' END AS level, {sql_fixed(f'''{_W['business_logic']}e0 * least(rules / 10e0, 1e0) + {_W['dependencies']}e0 * least(deps / 5e0, 1e0) + CASE WHEN files > 0 THEN {_W['file_io']}e0 ELSE 0e0 END + 0e0 + {_W['has_comments']}e0 + {_W['complexity']}e0 * least(complexity / 20e0, 1e0)''')} AS interest FROM m")
def k4(spark, sf_dir):
    rows = programs(spark, sf_dir)
    count = lambda p: selection.count_of("source", p)
    rules = sc.business_rules(sc.statements(sc.paragraphs(rows))).groupBy("program").agg(F.count("*").alias("rules"))
    m = rows.select(
        "program", selection.code_lines("source").alias("loc"), selection.cyclomatic("source").alias("complexity"), selection.nesting_depth("source").alias("nesting"), F.size(selection.distinct_names("source", r"CALL '(\w+)'", 20)).alias("deps"),
        count(r"(?i)\bREAD\s+\S+").alias("files"), count(r"(?i)\bGO\s+TO\b").alias("gotos"), count(r"(?i)EXEC\s+SQL").alias("sql"), F.expr("source rlike '(?m)^ {6}[*]'").alias("comments"),
    ).join(shuffled(rules), "program", "left").fillna(0, ["rules"])
    c = F.col
    hard = selection.difficulty(c("loc"), c("complexity"), c("nesting"), c("deps"), c("rules"))
    interest = selection.interestingness(c("rules"), c("deps"), c("files"), c("loc"), c("comments"), c("complexity"))
    return m.select("program", "loc", "complexity", "nesting", "deps", "gotos", "sql", hard.alias("difficulty"), selection.difficulty_level(hard).alias("level"), fixed(interest).alias("interest"))


@query("h3_picture_bounds", f"{_S} SELECT program, 'WS-FLD-' || k AS name, 0.01e0 AS least, {sql_fixed('(10e0 ** (k + 3) - 1) / 100e0 / 2')} AS middle, {sql_fixed('(10e0 ** (k + 3) - 1) / 100e0')} AS greatest FROM s")
def h3(spark, sf_dir):
    bounds = behaviour.picture_bounds("picture")
    return sc.data_fields(programs(spark, sf_dir)).filter("level > 1").select("program", "name", *[fixed(bounds[k]).alias(k) for k in ("least", "middle", "greatest")])


_RATIO = "CASE program % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 0e0 ELSE 2e0 * (3 + program % 9) / (2 * (3 + program % 9) + 5) END"


@query("h19_output_similarity", f"{_T} SELECT program, {sql_fixed(_RATIO)} AS similarity, program % 4 <= 1 AS numbers_equal, {sql_fixed(f'0.5e0 * ({_RATIO}) + CASE WHEN program % 4 <= 1 THEN 0.4e0 ELSE 0e0 END + 0.1e0')} AS score, {sql_fixed('CASE program % 4 WHEN 0 THEN 0e0 ELSE 1 / 3 END')} AS gaps, program % 4 <> 2 AS tolerated FROM t")
def h19(spark, sf_dir):
    pick = lambda *xs: F.get(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (F.col("program") % 4).cast("int"))
    run = F.repeat(F.lit("q"), (3 + F.col("program") % 9).cast("int"))
    a, b = pick("x  y\r\nz 1", "A LONG LINE WITH A TOTAL OF 10.001", "abc 1", F.concat(run, F.lit("2"))), pick("x y\nz 1", "A LONG LINE WITH A TOTAL OF 10.002", "xyzwvu", F.concat(F.lit("wv"), run, F.lit("zy")))
    rows = programs(spark, sf_dir).select("program", a.alias("a"), b.alias("b"), pick("3.5", "1.00001", "1.0", " Yes").alias("x"), pick("3.50", "1.0", "1.1", "yes ").alias("y"), pick("MOVE A\n* c", "A\n[GAP: b]\nC", "A\n[GAP: b]\nC", "A\n[GAP: b]\nC").alias("code"))
    out = compare.text_similarity(rows, "a", "b")
    files = F.when(F.col("program") % 4 <= 1, 1.0).otherwise(0.0)
    return out.select("program", fixed(F.col("similarity")).alias("similarity"), compare.numerically_equal("a", "b").alias("numbers_equal"), fixed(compare.output_score(F.col("similarity"), files, F.lit(1.0))).alias("score"), fixed(compare.gap_share("code")).alias("gaps"), behaviour.tolerant_match(F.col("x"), F.col("y")).alias("tolerated"))


def _sql_normal(x: str) -> str:
    out = reduce(lambda s, kv: f"regexp_replace({s}, '\\b(?:{'|'.join(kv[1])})\\b', '{kv[0]}', 'g')", SYNONYMS.items(), f"lower({x})")
    return rf"regexp_replace(trim(regexp_replace({out}, '[\x20\x09-\x0D]+', ' ', 'g')), '[^A-Za-z0-9_\x20\x09-\x0D-]', '', 'g')"


_PRESENT = lambda terms: "(" + " + ".join(f"contains(low, '{x}')::INT" for x in terms) + ")"


@query("e2_normal_texts", f"{_T}, l AS (SELECT *, lower(document) AS low FROM t) SELECT program, md5({_sql_normal('document')}) AS digest, {sql_fixed(f'{_PRESENT(WHY)} / ({_PRESENT(WHY)} + {_PRESENT(WHAT)})')} AS presence, {sql_fixed('CASE WHEN rules = 0 THEN 0e0 WHEN rules < 5 THEN rules / 5e0 ELSE least(1e0, rules / 12e0) END')} AS density FROM (SELECT *, CASE WHEN program % 2 = 0 THEN 3 * n ELSE 0 END + CASE WHEN program % 3 = 0 THEN 2 ELSE 0 END AS rules FROM l)")
def e2(spark, sf_dir):
    density = t.indicator_density("document", (r"(?m)^\d+\.\s+", r"(?m)^[-*]\s+", r"when\s+", r"(?m)rule\s+\d+"))
    return programs(spark, sf_dir).select("program", F.md5(t.normalised("document", SYNONYMS).cast("binary")).alias("digest"), fixed(t.presence_share("document", WHY, WHAT)).alias("presence"), fixed(density).alias("density"))


@query("b25_copy_closure", f"{_S} SELECT program, 'COMMON' || ((program + i) % 4) AS name, (program + i) % 4 = 2 AS is_missing FROM (SELECT program, unnest([0, 1, 2]) AS i FROM p)")
def b25(spark, sf_dir):
    rows = programs(spark, sf_dir)
    roots = rows.select(F.col("program").alias("root"), F.explode(gt.copy_books("source")).alias("name"))
    uses = spark.createDataFrame([(f"COMMON{i}", f"COMMON{(i + 1) % 4}") for i in range(4)], "src string, dst string")
    reached = sc.copy_closure(roots, uses, depth=2)
    missing = gt.missing_books(reached, spark.createDataFrame([("COMMON0",), ("COMMON1",), ("COMMON3",)], "name string")).withColumn("is_missing", F.lit(True))
    return reached.join(shuffled(missing), ["root", "name"], "left").select(F.col("root").alias("program"), "name", F.coalesce("is_missing", F.lit(False)).alias("is_missing"))


@query("m61_answers_without_marks", f"{_T} SELECT program, CASE program % 3 WHEN 0 THEN 'MOVE ' || program WHEN 1 THEN 'ADD ' || program ELSE 'as it is' END AS code, program AS score FROM t")
def m61(spark, sf_dir):
    number = F.col("program").cast("string")
    answer = F.when(F.col("program") % 3 == 0, F.concat(F.lit("Here:\n```cobol\nMOVE "), number, F.lit("\n```\nDone"))).when(F.col("program") % 3 == 1, F.concat(F.lit("x\n```\nADD "), number, F.lit("\n```"))).otherwise("as it is")
    judged = F.concat(F.when(F.col("program") % 2 == 0, "```json\n").otherwise(" "), F.lit('{"score": '), number, F.lit("}"), F.when(F.col("program") % 2 == 0, "\n```").otherwise(""))
    return programs(spark, sf_dir).select("program", rs.code_block(answer).alias("code"), F.get_json_object(rs.without_fences(judged), "$.score").cast("long").alias("score"))


@query("g22_printed_values", f"{_T} SELECT program, 2 AS found, program % 3 <> 2 AS matches FROM t")
def g22(spark, sf_dir):
    number = F.col("program").cast("string")
    printed = F.concat(F.lit("WS-TOTAL: "), number, F.lit("\nnothing here\n  ws_flag = Y \n"))
    expected = F.create_map(F.lit("WS_TOTAL"), F.when(F.col("program") % 3 == 2, F.lit("-7")).otherwise(F.concat(number, F.lit(".0"))), F.lit("WS-FLAG"), F.lit("y"))
    values = ut.printed_values(printed)
    return programs(spark, sf_dir).select("program", F.size(values).alias("found"), ut.values_match(printed, expected).alias("matches"))


@query("j2_model_keys", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'model' WHEN l_suppkey % 3 = 1 THEN 'maker' ELSE 'unknown' END AS model, CASE WHEN l_partkey % 2 = 0 THEN 'T' || (1 + l_linenumber % 4) ELSE 'T1' END AS tier, array_to_string(CASE WHEN l_linenumber = 1 OR l_tax >= 0.2 THEN ['CF-01'] ELSE ['CF-05: x', 'CF-01'] END, ',') AS failures FROM lineitem")
def j2(spark, sf_dir):
    c, key = F.col, F.col("l_suppkey") % 3
    task = F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("LCB-T"), (1 + c("l_linenumber") % 4).cast("string"), F.lit("-001"))).otherwise("LCB")
    model = board.model_key(F.when(key == 0, "model").when(key == 1, "unknown"), F.when(key == 1, "maker").otherwise("Unknown"))
    failures = board.drop_call_failures(F.array(F.lit("CF-05: x"), F.lit("CF-01")), F.when(c("l_linenumber") == 1, 0).otherwise(3), c("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", model.alias("model"), board.tier_of(task).alias("tier"), F.array_join(failures, ",").alias("failures"))


@query("h1_claim_tests", f"{_S}, c AS (SELECT program, printf('CLM-%03d', k) AS claim_id, 'conditional' AS kind FROM s WHERE program % 2 = 0 UNION ALL SELECT program, printf('CLM-%03d', CASE WHEN program % 2 = 0 THEN n + 1 ELSE 1 END), 'assignment' FROM p WHERE program % 5 = 0) SELECT program, claim_id, unnest(CASE kind WHEN 'conditional' THEN [{{test_type: 'true', value: 100e0, priority: 1}}, {{test_type: 'false', value: 0e0, priority: 2}}] ELSE [{{test_type: 'behaviour', value: 50e0, priority: 3}}] END, recursive := true) FROM c")
def h1(spark, sf_dir):
    rows = programs(spark, sf_dir)
    found = claims.claims(rows.select("program", "document"), "program", "document")
    return behaviour.boundary_tests(found, sc.data_fields(rows), "program").select("program", "claim_id", "test_type", "value", "priority")


@query("l3_section_overlap", f"{_T} SELECT program, {sql_fixed('(CASE WHEN program % 7 <> 0 THEN 1e0 WHEN program % 2 = 1 AND program % 3 <> 0 AND program % 5 <> 0 THEN 32 / 35 ELSE 16 / 19 END + (program % 3 = 0)::INT + (program % 5 = 0)::INT) / (1 + (program % 3 = 0)::INT + (program % 5 = 0)::INT)')} AS score FROM t")
def l3(spark, sf_dir):
    other = F.replace("document", F.lit("## Business rules"), F.lit("## Remarks"))
    other = F.when(F.col("program") % 7 == 0, F.replace(other, F.lit(" It prevents errors."), F.lit(""))).otherwise(other)
    return programs(spark, sf_dir).select("program", fixed(similarity.section_overlap("document", other)).alias("score"))


_GRAMS = lambda x, n: f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' '))"
_HITS = lambda n: f"coalesce(list_sum(list_transform(list_distinct(c{n}), lambda x: least(len(list_filter(c{n}, lambda y: y = x)), len(list_filter(r{n}, lambda y: y = x))))), 0)"
_LOG = lambda n: f"ln(CASE WHEN {_HITS(n)} > 0 THEN {_HITS(n)}::DOUBLE ELSE 0.1e0 END / greatest(1, len(c{n})))"


@query("l2_bleu", rf"{_T}, w AS (SELECT program, list_filter(regexp_split_to_array(lower(document), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS r FROM t), c AS (SELECT program, r, list_transform(list_filter(range(1, len(r) + 1), lambda i: i % 5 <> 0), lambda i: r[i]) AS c FROM w), g AS (SELECT program, len(r) AS nr, len(c) AS nc, {', '.join(f'{_GRAMS(x, n)} AS {x}{n}' for x in 'rc' for n in (1, 2, 3, 4))} FROM c) SELECT program, {sql_fixed(f'exp(({" + ".join(_LOG(n) for n in (1, 2, 3, 4))}) / 4 + 1 - nr / nc)')} AS bleu FROM g")
def l2_bleu(spark, sf_dir):
    rows = programs(spark, sf_dir).select("program", t.words(F.lower("document")).alias("r"))
    rows = rows.select("program", F.array_join("r", " ").alias("r"), F.array_join(F.filter("r", lambda x, i: (i + 1) % 5 != 0), " ").alias("c"))
    return rows.select("program", fixed(similarity.bleu("c", "r")).alias("bleu"))

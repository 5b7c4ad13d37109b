"""Queries of scores, gates and routes over marks that line items give, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmeter.operators import generations as g
from docmeter.operators import scoring
from docmeter.registry import fixed, query, sql_fixed, table

#: Marks in 0 to 1 (a to e), counts (m to s) and flags (t, u, v) of a line item: the same text in both dialects.
MARKS = {
    "a": "l_discount * 1e1", "b": "l_tax * 12.5e0", "c": "l_quantity / 5e1", "d": "(l_partkey % 101) / 1e2", "e": "(l_suppkey % 41) / 4e1",
    "m": "l_partkey % 4", "n": "l_suppkey % 5", "o": "l_orderkey % 6", "p": "l_linenumber % 3", "s": "l_orderkey % 9",
    "t": "l_returnflag = 'R'", "u": "l_linestatus = 'O'", "v": "l_suppkey % 7 = 0",
}
_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_M = f"m AS (SELECT {', '.join(_KEYS)}, {', '.join(f'{x} AS {k}' for k, x in MARKS.items())}, CASE WHEN l_suppkey % 7 = 0 THEN ['CF-03: mismatch'] ELSE []::VARCHAR[] END AS cf FROM lineitem)"


def marks(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_KEYS, *[f"{x} AS {k}" for k, x in MARKS.items()])
    return rows.withColumn("cf", F.when(F.col("v"), F.array(F.lit("CF-03: mismatch"))).otherwise(F.array().cast("array<string>")))


def _over_marks(name: str, **columns: str):
    """Register a query whose result has the keys and the given SQL columns over marks."""
    sql = f"WITH {_M} SELECT {', '.join(_KEYS)}, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM m"

    def add(f):
        return query(name, sql)(lambda spark, sf_dir: marks(spark, sf_dir).select(*_KEYS, *[x.alias(k) for k, x in f(F.col).items()]))

    return add


_PENALTY = "CASE WHEN {x} <= {t} THEN 0.0e0 ELSE least({m}, ({x} - {t}) / (1 - {t}) * {m}) END"
_P1, _P2, _P3 = _PENALTY.format(x="a", t="0.30e0", m="0.20e0"), _PENALTY.format(x="b", t="0.50e0", m="0.30e0"), "CASE WHEN c < 0.40e0 THEN 0.20e0 ELSE 0.0e0 END"


@_over_marks(
    "i13_weighted_generations",
    v1=sql_fixed("0.5e0 * d + 0.5e0 * e"),
    v2=f"CASE WHEN len(cf) > 0 THEN 0.0e0 ELSE {sql_fixed('greatest(0.0e0, least(100.0e0, (a * 120 * 0.30e0 + b * 120 * 0.35e0 + c * 120 * 0.25e0 + d * 120 * 0.10e0)))')} END",
    v21=sql_fixed("a * 100 * 0.25e0 + b * 100 * 0.35e0 + c * 100 * 0.25e0 + d * 100 * 0.15e0"),
)
def i13(c):
    percent = lambda x, n: {"sc": c("a") * n, "bf": c("b") * n, "sq": c("c") * n, "tr": c("d") * n}
    return {"v1": fixed(g.total({"documentation": c("d"), "understanding": c("e")}, g.WEIGHTS_V1)), "v2": F.when(F.size("cf") > 0, 0.0).otherwise(fixed(g.gated_total(percent("", 120), g.WEIGHTS_V2, c("cf")))), "v21": fixed(g.total(percent("", 100), g.WEIGHTS_V21))}


@_over_marks(
    "i15_penalised_verdict",
    stuffing=sql_fixed(_P1),
    parroting=sql_fixed(_P2),
    comprehension=sql_fixed(f"greatest(0.0e0, least(1.0e0, d * (1 - ({_P1})) * (1 - ({_P2})) * (1 - ({_P3}))))"),
    lcb=f"CASE WHEN len(cf) > 0 THEN 0.0e0 ELSE {sql_fixed('(d * 0.40e0 + e * 0.25e0 + a * 0.35e0) * 100')} END",
    passed="len(cf) = 0 AND d >= 0.70e0 AND e >= 0.60e0 AND a >= 0.50e0",
    reasons="CASE WHEN len(cf) > 0 THEN 'Critical failure detected' ELSE array_to_string(list_filter([CASE WHEN d < 0.70e0 THEN printf('Comprehension %.1f%% < 70.0%%', d * 100) END, CASE WHEN e < 0.60e0 THEN printf('Documentation %.1f%% < 60.0%%', e * 100) END, CASE WHEN a < 0.50e0 THEN printf('Behavioral %.1f%% < 50.0%%', a * 100) END], lambda x: x IS NOT NULL), '; ') END",
)
def i15(c):
    penalties = g.gaming_penalties(c("a"), c("b"), c("c"))
    verdict = g.penalised_verdict({"comprehension": c("d"), "documentation": c("e"), "behavioral": c("a")}, c("cf"))
    return {"stuffing": fixed(penalties["stuffing"]), "parroting": fixed(penalties["parroting"]), "comprehension": fixed(g.after_penalties(c("d"), penalties)), "lcb": F.when(F.size("cf") > 0, 0.0).otherwise(fixed(verdict["lcb"])), "passed": verdict["passed"], "reasons": F.array_join(verdict["reasons"], "; ")}


_QUALITY = "CASE WHEN a >= 0.5e0 AND c >= 0.5e0 AND d >= 0.5e0 AND len(cf) = 0 THEN 0.4e0 * a + 0.4e0 * c + 0.2e0 * d ELSE 0.0e0 END"


def _status(mode, least_bf, least_quality):
    q, bf = f"({_QUALITY})", "b"
    low_bf, low_q = f"'Execution: BF ' || printf('%.1f%%', {bf} * 100) || ' < {least_bf * 100:.0f}%'", f"'Quality: ' || printf('%.1f%%', {q} * 100) || ' < {least_quality * 100:.0f}%'"
    resolved, good = f"(NOT t AND {bf} >= {least_bf}e0)", f"({q} >= {least_quality}e0)"
    passed = f"CASE WHEN t OR {mode == 'quality'} THEN {q} >= 0.60e0 ELSE {resolved} AND ({good} OR {mode == 'execution'}) END"
    why = {
        "execution": f"CASE WHEN NOT {resolved} THEN {low_bf} ELSE 'Execution criteria not met' END", "quality": f"CASE WHEN NOT {good} THEN {low_q} ELSE 'Quality criteria not met' END",
        "balanced": f"CASE WHEN NOT {resolved} AND NOT {good} THEN 'Both below threshold: BF ' || printf('%.1f%%', {bf} * 100) || ', Quality ' || printf('%.1f%%', {q} * 100) WHEN NOT {resolved} THEN {low_bf} WHEN NOT {good} THEN {low_q} ELSE 'Criteria not met' END",
    }[mode]
    return passed, f"CASE WHEN len(cf) > 0 THEN 'Critical failure: ' || cf[1] WHEN {passed} THEN 'All criteria met' ELSE {why} END"


_MODES = {"execution": (0.70, 0.55), "balanced": (0.60, 0.55), "quality": (0.70, 0.60)}


@_over_marks("i20_pass_reasons", quality=sql_fixed(_QUALITY), **{f"{m}_{x}": s for m, least in _MODES.items() for x, s in zip(("passed", "reason"), _status(m, *least), strict=True)})
def i20(c):
    quality = g.strict_quality(c("a"), c("c"), c("d"), c("cf"))
    status = {m: g.pass_status(c("b"), quality, c("t"), c("cf"), m) for m in _MODES}
    return {"quality": fixed(quality)} | {f"{m}_{x}": s[x] for m, s in status.items() for x in ("passed", "reason")}


def _sql_fired(**gates: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{k.upper().replace('_', '-')}' END" for k, x in gates.items()) + "], lambda x: x IS NOT NULL), ',')"


@_over_marks(
    "i9_generic_gates",
    failures=_sql_fired(cf_01="l_orderkey % 3 = 0 AND l_partkey % 2 = 0", cf_02="l_suppkey % 6 = 1", cf_03="b >= 0.10e0", cf_04="o > 0 AND m / greatest(o, 1) > 0.5", cf_05="d >= 0.20e0", cf_06="c >= 0.95e0 AND n > 0", cf_07="p > 0 AND s = 0", cf_08="e * 100 < 50"),
)
def i9(c):
    rules = F.when(c("l_orderkey") % 3 == 0, F.array(F.lit("checks"), F.when(c("l_partkey") % 2 == 0, "Computes the INTEREST").otherwise("prints a line"))).otherwise(F.array().cast("array<string>"))
    types = F.array(F.lit("variable"), F.when(c("l_suppkey") % 6 == 1, "fabricated").otherwise("line"))
    return {"failures": F.array_join(g.generic_gates(rules, types, c("b"), c("m"), c("o"), c("d"), c("c"), c("n"), c("p"), c("s"), c("e") * 100), ",")}


@_over_marks(
    "i8_second_gates",
    failures=_sql_fired(cf_01="CASE WHEN m > 0 AND a < 0.30e0 THEN n = m ELSE o > 0 AND a < 0.20e0 AND s = o END", cf_02="s > 3", cf_03="NOT t AND p > 0 AND b < 0.90e0", cf_04="n > 0 AND m = n", cf_05="o > 0 AND d < 0.20e0", cf_06="u"),
)
def i8(c):
    return {"failures": F.array_join(g.second_gates(c("m"), c("n"), c("o"), c("s"), c("a"), c("s"), c("t"), c("p"), c("b"), c("n"), c("m"), c("o"), c("d"), F.when(c("u"), 1)), ",")}


@_over_marks(
    "i10_third_gates",
    failures=_sql_fired(cf_01="m > 0 AND a = 0", cf_02="n > 3", cf_03="b > 0.5e0", cf_04="o > 0 AND NOT t", cf_05="c < 0.5e0 OR coalesce(CASE WHEN u THEN d END < 0.5e0, false)", cf_06="s > 6"),
    kept=f"CASE WHEN l_suppkey % 2 = 0 THEN array_to_string(list_filter(string_split({_sql_fired(cf_01='m > 0 AND a = 0', cf_02='n > 3', cf_03='b > 0.5e0')}, ','), lambda x: x <> 'CF-02' AND x <> 'CF-03'), ',') ELSE {_sql_fired(cf_01='m > 0 AND a = 0', cf_02='n > 3', cf_03='b > 0.5e0')} END",
)
def i10(c):
    zero = F.lit(0)
    few = g.third_gates(c("m"), c("a"), F.when(c("n") > 3, c("n")).otherwise(0), c("b"), zero, c("t"), F.lit(1.0), F.lit(None).cast("double"), zero)
    language = F.when(c("l_suppkey") % 2 == 0, "unibasic").otherwise("cobol")
    return {
        "failures": F.array_join(g.third_gates(c("m"), c("a"), F.when(c("n") > 3, c("n")).otherwise(0), c("b"), c("o"), c("t"), c("c"), F.when(c("u"), c("d")), F.when(c("s") > 6, 1).otherwise(0)), ","),
        "kept": F.array_join(g.enabled(few, language, {"unibasic": ("CF-02", "CF-03")}), ","),
    }


_W = "CASE WHEN s >= 5 THEN 0.6e0 ELSE 0.4e0 END"
_HEUR = "least(1.0e0, coalesce(CASE WHEN s > 0 THEN a END, 0.5e0) + 0.2e0 * coalesce(m / nullif(s, 0), 0.0e0))"


@_over_marks(
    "g16_class_scores",
    heuristic=sql_fixed(_HEUR),
    pure=sql_fixed("CASE WHEN n = 0 THEN 1.0e0 ELSE d END"),
    mixed=sql_fixed(f"CASE WHEN n = 0 THEN 1.0e0 ELSE ({_W}) * d + (1 - ({_W})) * e END"),
    infrastructure=sql_fixed(f"CASE WHEN p = 0 THEN 1.0e0 ELSE ({_W}) * ({_HEUR}) + (1 - ({_W})) * e END"),
    program=sql_fixed(f"({_W}) * d + (1 - ({_W})) * e"),
)
def g16(c):
    heuristic = g.heuristic_claim_score(F.when(c("s") > 0, c("a")), c("s"), c("m"))
    return {
        "heuristic": fixed(heuristic), "pure": fixed(g.class_score(c("n"), c("s"), c("d"))), "mixed": fixed(g.class_score(c("n"), c("s"), c("d"), c("e"))),
        "infrastructure": fixed(g.class_score(c("p"), c("s"), heuristic, c("e"))), "program": fixed(g.program_score(c("s"), c("d"), c("e"))),
    }


@_over_marks(
    "g45_routes_and_scores",
    mode="CASE WHEN s < 1 THEN 'error' WHEN t AND u THEN 'executed' ELSE 'static' END",
    executed=sql_fixed("0.6e0 * coalesce(m / nullif(m + n, 0), 0.0e0) + (1 - 0.6e0) * d"),
    static=sql_fixed("0.6e0 * least(1.0e0, (m + 0.5e0 * n) / 6.0e0) + (1 - 0.6e0) * d"),
    score=sql_fixed("CASE WHEN s < 1 THEN 0.0e0 WHEN t AND u THEN 0.6e0 * coalesce(m / nullif(m + n, 0), 0.0e0) + (1 - 0.6e0) * d ELSE 0.6e0 * least(1.0e0, (m + 0.5e0 * n) / 6.0e0) + (1 - 0.6e0) * d END"),
    keywords=sql_fixed("CASE WHEN v THEN 0.3e0 ELSE 0.0e0 END + 0.7e0 * (least(m, n) / greatest(n, 1))"),
)
def g45(c):
    executed, static = g.executed_score(c("m"), c("n"), c("d")), g.two_part(scoring.hybrid_claim_score(c("m"), c("n"), c("s") + 1), c("d"))
    mode = g.route(c("s"), c("t"), c("u"))
    return {"mode": mode, "executed": fixed(executed), "static": fixed(static), "score": fixed(g.routed_score(mode, executed, static)), "keywords": fixed(g.keyword_score(c("v"), F.least("m", "n"), c("n")))}


@_over_marks(
    "g55_units_and_types",
    combined="CASE WHEN m = 0 AND n = 0 THEN 0.75e0 WHEN m = 0 THEN " + sql_fixed("d") + " WHEN n = 0 OR o = 0 THEN " + sql_fixed("e") + " ELSE round((4e0 / 7) * e + (1 - 4e0 / 7) * d, 4) END",
    kind="CASE WHEN v THEN CASE WHEN d * 100 > 30 THEN 'CICS with compute logic' ELSE 'CICS transaction' END WHEN t THEN CASE WHEN d * 100 > 30 THEN 'DB2 with compute logic' ELSE 'DB2 batch' END WHEN u THEN CASE WHEN d * 100 > 50 THEN 'Mixed with subroutines' ELSE 'Subroutine-heavy' END WHEN d * 100 > 90 THEN 'Pure compute' WHEN d * 100 > 50 THEN 'Mostly compute' ELSE 'File I/O heavy' END",
)
def g55(c):
    combined = g.combined_units(F.when(c("m") > 0, c("e")), F.when(c("n") > 0, c("d")), c("o"))
    return {"combined": fixed(combined), "kind": g.program_type(c("d") * 100, c("t"), c("v"), c("u"))}


_LEVEL = "CASE WHEN {x} >= 0.95e0 THEN 'definitive' WHEN {x} >= 0.80e0 THEN 'high' WHEN {x} >= 0.60e0 THEN 'medium' ELSE 'low' END"
_RULES, _CALLS = "(CASE WHEN m > 0 THEN d ELSE 1.0e0 END)", "(1.0e0 - 0.2e0 * coalesce(least(n, o) / nullif(o, 0), 0.0e0))"


@_over_marks(
    "c27_ground_truth_confidence",
    confidence=sql_fixed(f"1.0e0 * 0.25e0 + 1.0e0 * 0.25e0 + {_RULES} * 0.30e0 + 1.0e0 * 0.10e0 + {_CALLS} * 0.10e0"),
    rules_level=_LEVEL.format(x=_RULES),
    calls_level=_LEVEL.format(x=_CALLS),
    automation=sql_fixed("coalesce((s + 0.9e0 * m + 0.7e0 * n) / nullif(s + m + n, 0), 1.0e0)"),
)
def c27(c):
    found = g.ground_truth_confidence(c("m"), c("d"), c("o"), F.least("n", "o"))
    return {"confidence": fixed(found["confidence"]), "rules_level": found["rules_level"], "calls_level": found["calls_level"], "automation": fixed(g.automation(c("s"), c("m"), c("n")))}


@_over_marks(
    "e19_element_weights",
    v2=sql_fixed("a * 0.25e0 + b * 0.30e0 + c * 0.20e0 + d * 0.10e0 + e * 0.08e0 + a * 0.07e0"),
    v23=sql_fixed("b * 0.40e0 + a * 0.25e0 + c * 0.20e0 + d * 0.15e0"),
    rubric=sql_fixed("(a * 100) / 100.0e0 * 0.5e0 + (b * 100) / 100.0e0 * 0.3e0 + (c * 100) / 100.0e0 * 0.2e0"),
    escalates="d * 100 < 70",
    judge="CASE WHEN l_suppkey % 3 = l_partkey % 3 THEN 'spare' ELSE 'JUDGE-' || (l_suppkey % 3) END",
)
def e19(c):
    elements = dict(zip(g.ELEMENT_WEIGHTS_V2, (c(x) for x in "abcdea"), strict=True))
    comprehension = dict(zip(g.COMPREHENSION_WEIGHTS, (c(x) for x in "bacd"), strict=True))
    judge = lambda name, key: F.concat(F.lit(name), (c(key) % 3).cast("string"))
    return {
        "v2": fixed(g.total(elements, g.ELEMENT_WEIGHTS_V2)), "v23": fixed(g.total(comprehension, g.COMPREHENSION_WEIGHTS)), "rubric": fixed(g.rubric_score({x: c(x) * 100 for x in "abc"}, {"a": 0.5, "b": 0.3, "c": 0.2})),
        "escalates": g.escalates(c("d") * 100), "judge": g.other_judge(judge("JUDGE-", "l_suppkey"), judge("judge-", "l_partkey"), F.lit("spare")),
    }


@_over_marks(
    "i4_gates",
    failures=_sql_fired(cf_01="m > 0 AND n = 0", cf_03="s + o > 0 AND o / (s + o) >= 0.5", cf_04="n > 0 AND p < greatest(1, floor(n / 2))", cf_05="s >= 5 AND o > 0 AND m / s < 0.30e0"),
)
def i4(c):
    return {"failures": F.array_join(scoring.gates(scoring.undocumented_rules_gate(c("m"), c("n")), scoring.contradiction_gate(c("s"), c("o")), scoring.missing_handlers_gate(c("n"), c("p")), scoring.external_call_gate(c("m"), c("s"), c("o"))), ",")}


@_over_marks(
    "g21_behavioural_score",
    score=sql_fixed("CASE WHEN s < 1 THEN 0.0e0 ELSE coalesce((m * a + n * d + p * e) / nullif(m + n + p, 0), 1.0e0) END"),
    mixed=sql_fixed(f"({_W}) * d + (1 - ({_W})) * e"),
    hybrid=sql_fixed("CASE WHEN s = 0 THEN 1.0e0 ELSE least(1.0e0, (m + 0.5e0 * n) / 6.0e0) END"),
)
def g21(c):
    score = scoring.behavioural_score(c("s"), {"PURE": (c("m"), c("a")), "MIXED": (c("n"), c("d")), "INFRASTRUCTURE": (c("p"), c("e"))})
    return {"score": fixed(score), "mixed": fixed(scoring.mixed_score(c("d"), c("e"), c("s"))), "hybrid": fixed(scoring.hybrid_claim_score(c("m"), c("n"), c("s")))}

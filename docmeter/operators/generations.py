"""Scores, gates, reasons and routes of the earlier and later evaluator generations, as Column expressions.

All weights, thresholds and targets are parameters; track scores lie in 0 to 1 unless a function says percent.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.functions.text import scaled_penalty
from docmeter.operators.ranges import shuffled
from docmeter.operators.scoring import PASS_MODES, claim_weight

# Weights and thresholds by generation.
WEIGHTS_V1 = {"documentation": 0.50, "understanding": 0.50}
WEIGHTS_V2 = {"sc": 0.30, "bf": 0.35, "sq": 0.25, "tr": 0.10}
WEIGHTS_V21 = {"sc": 0.25, "bf": 0.35, "sq": 0.25, "tr": 0.15}
WEIGHTS_V23 = {"comprehension": 0.40, "documentation": 0.25, "behavioral": 0.35}
THRESHOLDS_V23 = {"comprehension": 0.70, "documentation": 0.60, "behavioral": 0.50}
COMPREHENSION_WEIGHTS = {"business_rules": 0.40, "data_flow": 0.25, "abstraction": 0.20, "dependencies": 0.15}
ELEMENT_WEIGHTS_V2 = {"data_structures": 0.25, "business_rules": 0.30, "control_flow": 0.20, "file_operations": 0.10, "external_calls": 0.08, "error_handlers": 0.07}
CONFIDENCE_WEIGHTS = {"data_structures": 0.25, "control_flow": 0.25, "business_rules": 0.30, "error_handlers": 0.10, "dependencies": 0.10}
STUFFING = (0.30, 0.20)
PARROTING = (0.50, 0.30)
LEAST_ABSTRACTION, ABSTRACTION_PENALTY = 0.40, 0.20
PRIMARY_WORDS = ("calculate", "compute", "total", "sum", "interest", "balance")
# End of fixed values.


def total(tracks: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of named tracks."""
    return reduce(add, [tracks[k] * w for k, w in weights.items()])


def gated_total(tracks: dict[str, Column], weights: dict[str, float], failures: Column, most: float = 100.0) -> Column:
    """The weighted sum of percent tracks in 0 to ``most``; 0 with any critical failure."""
    return F.when(F.size(failures) > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), total(tracks, weights))))


def gaming_penalties(stuffing: Column, parroting: Column, abstraction: Column) -> Column:
    """Struct of the three anti-gaming penalties, each 0 on the right side of its threshold."""
    low = F.when(abstraction < LEAST_ABSTRACTION, ABSTRACTION_PENALTY).otherwise(0.0)
    return F.struct(scaled_penalty(stuffing, *STUFFING).alias("stuffing"), scaled_penalty(parroting, *PARROTING).alias("parroting"), low.alias("abstraction"))


def after_penalties(score: Column, penalties: Column) -> Column:
    """A score after multiplicative penalties, in 0 to 1."""
    left = reduce(lambda s, k: s * (1 - penalties[k]), ("stuffing", "parroting", "abstraction"), score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))


def missed_thresholds(tracks: dict[str, Column], thresholds: dict[str, float] = THRESHOLDS_V23) -> Column:
    """A sentence for each track under its threshold, in the order of the thresholds."""
    said = [F.when(tracks[k] < least, F.format_string(f"{k.capitalize()} %.1f%% < {least * 100}%%", tracks[k] * 100)) for k, least in thresholds.items()]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def penalised_verdict(tracks: dict[str, Column], failures: Column, weights: dict[str, float] = WEIGHTS_V23, thresholds: dict[str, float] = THRESHOLDS_V23) -> Column:
    """Struct of ``lcb`` (0 to 100), ``passed`` and ``reasons`` of three tracks; a critical failure zeroes and fails."""
    missed, failed = missed_thresholds(tracks, thresholds), F.size(failures) > 0
    reasons = F.when(failed, F.array(F.lit("Critical failure detected"))).otherwise(missed)
    return F.struct(F.when(failed, 0.0).otherwise(total(tracks, weights) * 100).alias("lcb"), (~failed & (F.size(missed) == 0)).alias("passed"), reasons.alias("reasons"))


def strict_quality(sc: Column, sq: Column, tr: Column, failures: Column, least: float = 0.50) -> Column:
    """.4 structure + .4 semantics + .2 traceability if all reach a minimum and nothing failed critically, else 0."""
    enough = (sc >= least) & (sq >= least) & (tr >= least) & (F.size(failures) == 0)
    return F.when(enough, 0.4 * sc + 0.4 * sq + 0.2 * tr).otherwise(0.0)


def pass_status(bf: Column, quality: Column, placeholder: Column, failures: Column, mode: str = "balanced") -> Column:
    """Struct of ``resolved, has_quality, passed, reason`` under a mode; a placeholder score is never resolved and
    sends the decision to the quality mode; a critical failure is the reason whatever else holds."""
    mode = mode if mode in PASS_MODES else "balanced"
    least_bf, least_quality = (least if least is not None else default for least, default in zip(PASS_MODES[mode], (0.70, 0.55), strict=True))
    resolved, good = ~placeholder & (bf >= least_bf), quality >= least_quality
    by_quality = quality >= PASS_MODES["quality"][1]
    passed = F.when(placeholder | F.lit(mode == "quality"), by_quality).otherwise(resolved & (good | F.lit(mode == "execution")))
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    low_bf = F.concat(F.lit("Execution: BF "), percent(bf), F.lit(f" < {least_bf * 100:.0f}%"))
    low_quality = F.concat(F.lit("Quality: "), percent(quality), F.lit(f" < {least_quality * 100:.0f}%"))
    if mode == "execution":
        why = F.when(~resolved, low_bf).otherwise("Execution criteria not met")
    elif mode == "quality":
        why = F.when(~good, low_quality).otherwise("Quality criteria not met")
    else:
        both = F.concat(F.lit("Both below threshold: BF "), percent(bf), F.lit(", Quality "), percent(quality))
        why = F.when(~resolved & ~good, both).when(~resolved, low_bf).when(~good, low_quality).otherwise("Criteria not met")
    reason = F.when(F.size(failures) > 0, F.concat(F.lit("Critical failure: "), F.get(failures, F.lit(0)))).when(passed, "All criteria met").otherwise(why)
    return F.struct(resolved.alias("resolved"), good.alias("has_quality"), passed.alias("passed"), reason.alias("reason"))


# Gates


def _fired(*gates: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in gates]), lambda x: x.isNotNull())


def missing_primary(missing_rules: Column) -> Column:
    """Whether a missing rule's description speaks of a primary calculation."""
    return F.exists(missing_rules, lambda d: reduce(lambda a, b: a | b, [F.contains(F.lower(d), F.lit(w)) for w in PRIMARY_WORDS]))


def fabricated(reference_types: Column) -> Column:
    """Whether any invalid reference is a fabricated one."""
    return F.exists(reference_types, lambda t: t == "fabricated")


def handlers_missing(missing: Column, handlers: Column) -> Column:
    """Whether over half of the handlers there are is missing."""
    return (handlers > 0) & (missing / F.greatest(handlers, F.lit(1)) > 0.5)


def undeclared_files(missing: Column, declared: Column) -> Column:
    """Whether files are missing while none is declared."""
    return (missing > 0) & (declared == 0)


def generic_gates(missing_rules: Column, reference_types: Column, mismatch_rate: Column, missing_handlers: Column, handlers: Column, broken_rate: Column, passed_rate: Column, gap_markers: Column, missing_files: Column, declared_files: Column, accuracy: Column) -> Column:
    """CF-01 to CF-08 of the common result layout, in order. ``accuracy`` is a percentage."""
    return _fired(
        ("CF-01", missing_primary(missing_rules)), ("CF-02", fabricated(reference_types)), ("CF-03", mismatch_rate >= 0.10), ("CF-04", handlers_missing(missing_handlers, handlers)),
        ("CF-05", broken_rate >= 0.20), ("CF-06", (passed_rate >= 0.95) & (gap_markers > 0)), ("CF-07", undeclared_files(missing_files, declared_files)), ("CF-08", accuracy < 50),
    )


def second_gates(critical: Column, missing_critical: Column, rules: Column, missing_rules: Column, sc: Column, invalid_names: Column, placeholder: Column, tests: Column, bf: Column, handlers: Column, missing_handlers: Column, references: Column, tr: Column, gap_markers: Column) -> Column:
    """CF-01 to CF-06 of the second generation: all critical rules missing at a very low structural score (all rules where
    none is critical), over three invented names, failed execution, no handler documented, broken references, gaps."""
    none_critical = (critical > 0) & (sc < 0.30)
    cf01 = F.when(none_critical, missing_critical == critical).otherwise((rules > 0) & (sc < 0.20) & (missing_rules == rules))
    return _fired(
        ("CF-01", cf01), ("CF-02", invalid_names > 3), ("CF-03", ~placeholder & (tests > 0) & (bf < 0.90)), ("CF-04", (handlers > 0) & (missing_handlers == handlers)),
        ("CF-05", (references > 0) & (tr < 0.20)), ("CF-06", gap_markers.isNotNull()),
    )


def third_gates(critical: Column, critical_rate: Column, hallucinations: Column, failure_rate: Column, handlers: Column, handlers_documented: Column, call_score: Column, mixed_call_score: Column, contradictions: Column) -> Column:
    """CF-01 to CF-06 of the third generation."""
    return _fired(
        ("CF-01", (critical > 0) & (critical_rate == 0)), ("CF-02", hallucinations > 0), ("CF-03", failure_rate > 0.5), ("CF-04", (handlers > 0) & ~handlers_documented),
        ("CF-05", (call_score < 0.5) | F.coalesce(mixed_call_score < 0.5, F.lit(False))), ("CF-06", contradictions > 0),
    )


def enabled(failures: Column, language: Column, disabled: dict[str, tuple[str, ...]]) -> Column:
    """Failures without those that a language switches off."""
    off = F.array().cast("array<string>")
    for name, codes in disabled.items():
        off = F.when(language == name, F.array(*[F.lit(c) for c in codes])).otherwise(off)
    return F.filter(failures, lambda x: ~F.array_contains(off, F.split_part(x, F.lit(":"), F.lit(1))))


# Behaviour


def heuristic_claim_score(mean_confidence: Column, claims: Column, specific: Column) -> Column:
    """Mean confidence (.5 without claims) and a fifth of the share of claims with an output, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(mean_confidence, F.lit(0.5)) + 0.2 * F.coalesce(F.try_divide(specific, claims), F.lit(0.0)))


def class_score(paragraphs: Column, claims: Column, claim_score: Column, call_score: Column | None = None) -> Column:
    """Score of a paragraph class: 1 without paragraphs; of claims alone, or of claims and external calls."""
    w = claim_weight(claims)
    own = claim_score if call_score is None else w * claim_score + (1 - w) * call_score
    return F.when(paragraphs == 0, 1.0).otherwise(own)


def program_score(claims: Column, claim_score: Column, call_score: Column) -> Column:
    """Claims and external calls of a program without any paragraph."""
    return claim_weight(claims) * claim_score + (1 - claim_weight(claims)) * call_score


def two_part(first: Column, second: Column, share: float = 0.60) -> Column:
    return share * first + (1 - share) * second


def executed_score(passed: Column, failed: Column, call_score: Column) -> Column:
    """.6 of the share of passed tests (0 without tests) and .4 of the external calls."""
    return two_part(F.coalesce(F.try_divide(passed, passed + failed), F.lit(0.0)), call_score)


def keyword_score(mentioned: Column, found: Column, keywords: Column) -> Column:
    """.3 for a paragraph's name and .7 for the share of its logic keywords."""
    return F.when(mentioned, 0.3).otherwise(0.0) + 0.7 * (found / F.greatest(keywords, F.lit(1)))


# Operations that reports are searched for; patterns of external blocks and the topics a report has to name.
OPERATIONS = r"(?i)\b(COMPUTE|IF|EVALUATE|ADD|SUBTRACT|MULTIPLY|DIVIDE)\b"
KEYWORDS = r"(?i)\b(COMPUTE|IF|EVALUATE)\b"
LEAST_TOPICS = 0.7
BLOCK_TOPICS = {
    "SQL_SELECT": (r"EXEC\s+SQL\s+SELECT\s+(.+?)\s+INTO\s+:(.+?)\s+FROM\s+(\w+)", ("table_name", "columns", "target_variables", "where_conditions")),
    "SQL_INSERT": (r"EXEC\s+SQL\s+INSERT\s+INTO\s+(\w+)", ("table_name", "columns", "source_variables")),
    "SQL_UPDATE": (r"EXEC\s+SQL\s+UPDATE\s+(\w+)", ("table_name", "columns_updated", "where_conditions")),
    "SQL_DELETE": (r"EXEC\s+SQL\s+DELETE\s+FROM\s+(\w+)", ("table_name", "where_conditions")),
    "SQL_CURSOR_DECLARE": (r"EXEC\s+SQL\s+DECLARE\s+(\w+)\s+CURSOR", ("cursor_name", "select_statement")),
    "SQL_CURSOR_OPEN": (r"EXEC\s+SQL\s+OPEN\s+(\w+)", ("cursor_name",)),
    "SQL_CURSOR_FETCH": (r"EXEC\s+SQL\s+FETCH\s+(\w+)", ("cursor_name", "into_variables")),
    "SQL_CURSOR_CLOSE": (r"EXEC\s+SQL\s+CLOSE\s+(\w+)", ("cursor_name",)),
    "CICS_READ": (r"EXEC\s+CICS\s+READ\s+FILE\s*\(\s*['\"]?(\w+)", ("file_name", "ridfld", "into_variable")),
    "CICS_WRITE": (r"EXEC\s+CICS\s+WRITE\s+FILE\s*\(\s*['\"]?(\w+)", ("file_name", "from_variable", "ridfld")),
    "CICS_REWRITE": (r"EXEC\s+CICS\s+REWRITE\s+FILE\s*\(\s*['\"]?(\w+)", ("file_name", "from_variable")),
    "CICS_DELETE": (r"EXEC\s+CICS\s+DELETE\s+FILE\s*\(\s*['\"]?(\w+)", ("file_name", "ridfld")),
    "CICS_SEND": (r"EXEC\s+CICS\s+SEND\s+(MAP|TEXT)", ("map_name", "from_variable")),
    "CICS_RECEIVE": (r"EXEC\s+CICS\s+RECEIVE\s+MAP", ("map_name", "into_variable")),
    "CALL_STATIC": (r"CALL\s+['\"](\w+)['\"]", ("program_name", "parameters", "return_values")),
    "CALL_DYNAMIC": (r"CALL\s+(WS-\w+)", ("program_variable", "parameters", "dispatch_reason")),
}
# End of fixed values.


def _said(low: Column, code: Column, pattern: str) -> Column:
    """How many of a code's operations there are, and how many of them a (lower-case) report has, repetitions included."""
    found = F.regexp_extract_all(code, F.lit(pattern), 1)
    return F.struct(F.size(found).alias("found"), F.size(F.filter(found, lambda x: F.contains(low, F.lower(x)))).alias("said"))


def paragraph_keyword_score(document: Column, name: Column, content: Column) -> Column:
    """A pure paragraph against a report: .3 for its name and .7 for the share of its keywords that the report has."""
    low = F.lower(F.coalesce(document, F.lit("")))
    said = _said(low, content, KEYWORDS)
    return keyword_score(F.contains(low, F.lower(name)), said["said"], said["found"])


def mixed_paragraphs(blocks: DataFrame, documents: DataFrame, patterns: dict[str, tuple[str, tuple[str, ...]]] = BLOCK_TOPICS, key: str = "program", text: str = "document") -> DataFrame:
    """``logic`` and ``calls`` scores of mixed paragraphs by program, and ``mixed``, .6 of the first and .4 of the second.

    A paragraph's logic is the share of operations in its logic blocks that the report has (.5 without operations); its
    calls, the share of patterns found in its external blocks of which the report names .7 of the topics (1 without any).
    Paragraphs without such blocks don't count; programs without any score 1.
    """
    rows = blocks.join(shuffled(documents.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))), key)
    said = _said(F.col("_low"), F.col("content"), OPERATIONS)
    logic = rows.filter("type = 'logic'").groupBy(key, "name").agg(F.sum(said["found"]).alias("found"), F.sum(said["said"]).alias("said"))
    logic = logic.select(key, "name", F.coalesce(F.try_divide("said", "found"), F.lit(0.5)).alias("logic"))
    topics = lambda names: reduce(add, [reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(w)) for w in n.split("_")]).cast("int") for n in names])
    hits = [F.when(F.col("content").rlike(f"(?is){p}"), F.lit(1.0) if not names else (topics(names) / float(len(names)) >= LEAST_TOPICS).cast("double")) for p, names in patterns.values()]
    calls = rows.filter("type = 'external'").withColumn("hits", F.filter(F.array(*hits), lambda h: h.isNotNull())).groupBy(key, "name")
    calls = calls.agg(F.sum(F.size("hits")).alias("n"), F.sum(F.aggregate("hits", F.lit(0.0), lambda a, b: a + b)).alias("hit")).select(key, "name", F.coalesce(F.try_divide("hit", "n"), F.lit(1.0)).alias("calls"))
    of = logic.join(shuffled(calls), [key, "name"], "full").groupBy(key).agg(F.avg("logic").alias("logic"), F.avg("calls").alias("calls"))
    out = documents.select(key).join(shuffled(of), key, "left").fillna(1.0, ["logic", "calls"])
    return out.withColumn("mixed", two_part(F.col("logic"), F.col("calls")))


def combined_units(units: Column, call_score: Column, calls: Column, units_share: float = 4 / 7) -> Column:
    """Isolated units and external calls by weight; either alone where the other is missing, .75 without both."""
    both = F.round(units_share * units + (1 - units_share) * call_score, 4)
    return F.when(units.isNull() & call_score.isNull(), 0.75).when(units.isNull(), call_score).when(call_score.isNull() | (calls == 0), units).otherwise(both)


def program_type(isolated: Column, has_sql: Column, has_cics: Column, has_calls: Column) -> Column:
    """A program's kind by its external calls and the percentage of its isolated units."""
    by = lambda least, high, low: F.when(isolated > least, high).otherwise(low)
    rest = F.when(isolated > 90, "Pure compute").when(isolated > 50, "Mostly compute").otherwise("File I/O heavy")
    return F.when(has_cics, by(30, "CICS with compute logic", "CICS transaction")).when(has_sql, by(30, "DB2 with compute logic", "DB2 batch")).when(has_calls, by(50, "Mixed with subroutines", "Subroutine-heavy")).otherwise(rest)


def route(claims: Column, has_executor: Column, compiled: Column, least_claims: int = 1) -> Column:
    """How behaviour is judged: ``error`` for silence, ``executed`` if the program compiled, else ``static``."""
    return F.when(claims < least_claims, "error").when(has_executor & compiled, "executed").otherwise("static")


def routed_score(mode: Column, executed: Column, static: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(mode == "error", 0.0).when(mode == "executed", executed).otherwise(static)))


# Ground truth


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "definitive").when(confidence >= 0.80, "high").when(confidence >= 0.60, "medium").otherwise("low")


def ground_truth_confidence(rules: Column, mean_confidence: Column, calls: Column, dynamic_calls: Column) -> Column:
    """Weighted confidence of what was parsed: rules by their own, calls less a fifth of the dynamic share, the rest 1."""
    of_rules = F.when(rules > 0, mean_confidence).otherwise(1.0)
    of_calls = 1.0 - 0.2 * F.coalesce(F.try_divide(dynamic_calls, calls), F.lit(0.0))
    parts = {k: F.lit(1.0) for k in CONFIDENCE_WEIGHTS} | {"business_rules": of_rules, "dependencies": of_calls}
    return F.struct(total(parts, CONFIDENCE_WEIGHTS).alias("confidence"), confidence_level(of_rules).alias("rules_level"), confidence_level(of_calls).alias("calls_level"))


def automation(definitive: Column, high: Column, medium: Column) -> Column:
    """Share of elements that need no review: all definitive ones, .9 of high and .7 of medium ones; 1 without any."""
    return F.coalesce(F.try_divide(definitive + 0.9 * high + 0.7 * medium, definitive + high + medium), F.lit(1.0))


def escalates(confidence: Column, least: float = 70.0) -> Column:
    """Whether a judge's confidence (percent) is too low to stand alone."""
    return confidence < least


def rubric_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted judge scores in percent, as 0 to 1."""
    return reduce(add, [scores[k] / 100.0 * w for k, w in weights.items()])


def other_judge(judge: Column, evaluated: Column, replacement: Column) -> Column:
    """The judge, unless it is the evaluated model itself."""
    return F.when(F.lower(judge) == F.lower(evaluated), replacement).otherwise(judge)

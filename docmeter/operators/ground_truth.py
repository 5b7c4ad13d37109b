"""What is known of programs: loops, conditions, complexity, rule descriptions and totals, files, graphs, isolated units."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmeter.functions import blocks
from docmeter.functions.text import as_column, let, lines
from docmeter.operators.ranges import shuffled
from docmeter.operators.source_code import any_in, in_batches, leads

# Patterns of the source language and their names.
LOOPS = {"varying": r"PERFORM\s+VARYING\s+(.+)", "until": r"PERFORM\s+UNTIL\s+(.+)", "times": r"PERFORM\s+(\d+)\s+TIMES"}
CONDITIONS = {"if": r"IF\s+(.+?)\s+THEN", "evaluate": r"EVALUATE\s+(.+?)(?:\s+WHEN|$)"}
RULE_NAMES = {
    "complex_formula": "Mathematical calculation", "threshold_check": "Threshold comparison", "range_check": "Value range validation", "validation_rule": "Value validation",
    "conditional_assignment": "Conditional value assignment", "status_check": "Status/error code check", "accumulation": "Running total/accumulation", "date_formatting": "Date calculation",
}
BLOCKING = {
    r"EXEC\s+SQL": "Database operation (EXEC SQL)",
    r"EXEC\s+CICS": "Transaction operation (EXEC CICS)",
    r"EXEC\s+DLI": "IMS database operation (EXEC DLI)",
    r"CALL\s+": "External program call (CALL)",
    r"\bREAD\s+\w+": "File read operation",
    r"\bWRITE\s+\w+": "File write operation",
    r"\bOPEN\s+": "File open operation",
    r"\bCLOSE\s+": "File close operation",
    r"\bREWRITE\s+": "File rewrite operation",
    r"\bDELETE\s+": "File delete operation",
    r"\bSTART\s+": "File start operation",
}
COMPUTATION = ("COMPUTE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "MOVE", "IF", "EVALUATE")
LOOP_WORDS = ("VARYING", "UNTIL", "TIMES", "THRU", "THROUGH", "WITH", "TEST")
RESERVED_LINES = (
    "END-IF", "END-EXEC", "END-PERFORM", "END-EVALUATE", "END-CALL", "END-READ", "END-WRITE", "END-REWRITE", "END-DELETE", "END-START", "END-RETURN", "END-SEARCH", "END-STRING", "END-UNSTRING",
    "END-MULTIPLY", "END-DIVIDE", "END-ADD", "END-SUBTRACT", "END-COMPUTE", "END-ACCEPT", "END-DISPLAY", "STOP", "GOBACK", "CONTINUE", "EXIT", "ELSE", "WHEN", "OTHER", "NOT", "AND", "OR", "TRUE", "FALSE",
    "ZERO", "ZEROS", "ZEROES", "SPACE", "SPACES", "HIGH-VALUE", "HIGH-VALUES", "LOW-VALUE", "LOW-VALUES",
)
CALL_KINDS = {
    **{f"EXEC_SQL_{x}": (rf"EXEC\s+SQL\s+{x}(.+?)END-EXEC", "SQL") for x in ("SELECT", "INSERT", "UPDATE", "DELETE", "OPEN", "FETCH", "CLOSE", "DECLARE")},
    **{f"EXEC_CICS_{x}": (rf"EXEC\s+CICS\s+{x}(.+?)END-EXEC", "CICS") for x in ("SEND", "RECEIVE", "READ", "WRITE", "REWRITE", "DELETE", "LINK", "XCTL", "RETURN", "HANDLE")},
    "CALL_STATIC": (r"CALL\s+['\"]([A-Za-z0-9-]+)['\"](?:.+?)(?:\.|END-CALL)", "CALL"),
    "CALL_DYNAMIC": (r"CALL\s+([A-Z][A-Z0-9-]+)(?:\s+USING)?(?:.+?)(?:\.|END-CALL)", "CALL"),
    "FILE_READ": (r"\bREAD\s+([A-Z][A-Z0-9-]+)", "FILE"),
    "FILE_WRITE": (r"\bWRITE\s+([A-Z][A-Z0-9-]+)", "FILE"),
}
# End of fixed values.


def _matches(rows: DataFrame, patterns: dict[str, str], value: str, *keep: str) -> DataFrame:
    """A row for every pattern that a statement matches, with what its first group caught."""
    hits = [F.when(F.col("statement").rlike(f"(?i){p}"), F.struct(F.lit(k).alias("type"), F.trim(F.regexp_extract("statement", f"(?i){p}", 1)).alias(value))) for k, p in patterns.items()]
    return rows.select(*keep, F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def loops(statements_: DataFrame) -> DataFrame:
    """``program, paragraph, type, condition`` of counted, conditional and varying loops."""
    return _matches(statements_, LOOPS, "condition", "program", "paragraph")


def conditions(statements_: DataFrame) -> DataFrame:
    """``program, paragraph, line_no, type, condition`` of IF and EVALUATE."""
    return _matches(statements_, CONDITIONS, "condition", "program", "paragraph", "line_no")


def complexity(statements_: DataFrame) -> DataFrame:
    """Conditions, performed steps and jumps of each program, together, counted in its statements as they are read."""
    up = F.upper("statement")
    conditions_ = [F.when(F.contains(up, F.lit(core)) & F.col("statement").rlike(f"(?i){CONDITIONS[k]}"), 1).otherwise(0) for k, core in (("if", "THEN"), ("evaluate", "EVALUATE"))]
    leads_ = F.when(any_in(up, "PERFORM", "GO"), F.size(leads("statement"))).otherwise(0)
    return statements_.groupBy("program").agg(F.sum(reduce(lambda a, b: a + b, [*conditions_, leads_])).alias("complexity"))


def rule_description(rule_type: Column, statement: Column, names: dict[str, str] = RULE_NAMES) -> Column:
    """A sentence on a rule: its name, and what it compares, adds or computes; formulas are cut at 50 characters."""
    text = F.regexp_replace(F.upper(statement), r"\s+", " ")
    part = lambda p, i: F.regexp_extract(text, p, i)
    formula, threshold, equal, adding = r"COMPUTE\s+([A-Z0-9-]+)\s*=\s*(.+)", r"IF\s+([A-Z0-9-]+)\s*([<>=]+)\s*([0-9]+)", r"IF\s+([A-Z0-9-]+)\s+(NOT\s+)?=\s*['\"]?([A-Z0-9]+)", r"(ADD|COMPUTE)\s+(.+?)\s+TO\s+([A-Z0-9-]+)"
    short = lambda x: F.when(F.length(x) > 50, F.concat(F.substr(x, F.lit(1), F.lit(47)), F.lit("..."))).otherwise(x)
    join = lambda *x: F.concat_ws(" ", *x)
    said = {
        "complex_formula": join(part(formula, 1), F.lit("="), short(part(formula, 2))), "threshold_check": join(*[part(threshold, i) for i in (1, 2, 3)]),
        "validation_rule": F.concat(part(equal, 1), F.lit(" "), part(equal, 2), F.lit("= "), part(equal, 3)), "accumulation": join(part(adding, 1), part(adding, 2), F.lit("TO"), part(adding, 3)),
    }
    out = F.lit(None).cast("string")
    for kind, name in names.items():
        out = F.when(rule_type == kind, F.concat(F.lit(name + ": "), said[kind]) if kind in said else F.lit(name)).otherwise(out)
    return out


def rule_totals(rules: DataFrame) -> DataFrame:
    """Rules of each program by priority and confidence, their mean confidence, their types and all keywords."""
    count = lambda c: F.count_if(c)
    confidence = F.col("confidence")
    return rules.groupBy("program").agg(
        F.count("*").alias("rules"), *[count(F.col("priority") == p).alias(p.lower()) for p in ("CRITICAL", "IMPORTANT", "TRIVIAL")],
        count(confidence >= 0.90).alias("high_confidence"), count((confidence >= 0.70) & (confidence < 0.90)).alias("medium_confidence"), F.avg("confidence").alias("mean_confidence"),
        F.array_sort(F.collect_set("rule_type")).alias("rule_types"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"),
    )


def rule_groups(rules: DataFrame, by: str) -> DataFrame:
    """Rule ids of each program under each type or priority, in order."""
    return rules.groupBy("program", F.lower(by).alias("rule_group")).agg(F.array_sort(F.collect_list("rule_id")).alias("rule_ids"))


def file_dependencies(divisions_: DataFrame) -> DataFrame:
    """Files of SELECT and FD entries, one row for each program and name, with whether each declares it."""
    found = lambda name, pattern: F.when(F.col("name") == name, F.regexp_extract_all(F.upper("content"), F.lit(pattern), 1))
    files = F.coalesce(found("ENVIRONMENT", r"SELECT\s+([A-Z0-9-]+)\s+ASSIGN"), found("DATA", r"(?m)^\s*FD\s+([A-Z0-9-]+)"))
    rows = divisions_.filter(F.col("name").isin("ENVIRONMENT", "DATA")).select("program", F.col("name").alias("where"), F.explode(files).alias("file"))
    return rows.groupBy("program", "file").agg(F.bool_or(F.col("where") == "ENVIRONMENT").alias("selected"), F.bool_or(F.col("where") == "DATA").alias("has_fd"))


def file_operations(statements_: DataFrame) -> DataFrame:
    """``program, paragraph, line_no, operation, file`` of reads, writes, opens and closes."""
    pattern = r"(OPEN|CLOSE|READ|WRITE|REWRITE|DELETE)\s+([A-Z0-9-]+)"
    text = F.upper("statement")
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("operation"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("file"))
    return statements_.select("program", "paragraph", "line_no", F.inline(both))


def dependency_graph(*edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct ``program, dst, type`` edges, and the distinct nodes at either end."""
    # Dealt by program before: what is distinct is found where it stands, and both ends are taken from one row.
    out = reduce(DataFrame.unionByName, edges).repartition("program").distinct()
    ends = F.array(F.col("dst"), F.col("program").cast("string"))
    return out, out.select("program", F.explode(ends).alias("node")).distinct()


def assembled(programs: DataFrame, **counts: DataFrame) -> DataFrame:
    """One row for each program with how many elements of each kind it has, its size and its text's hash."""
    out = programs.select("program", F.size(lines("source")).alias("lines"), F.sha2("source", 256).alias("source_hash"))
    for name, rows in counts.items():
        out = out.join(shuffled(rows.groupBy("program").agg(F.count("*").alias(name))), "program", "left")
    return out.fillna(0, list(counts))


def copy_books(source: str | Column) -> Column:
    """Distinct upper-cased names of COPY, ++INCLUDE and -INC entries and SQL includes, without comments."""
    text = F.upper(F.regexp_replace(F.regexp_replace(as_column(source), r"(?dm)^.{6}[*/].*$", ""), r"\*>[^\n]*", ""))
    none = F.array().cast("array<string>")
    patterns = {r"\bCOPY\s+['\"]?([A-Z0-9_-]+)": "COPY", r"\+\+INCLUDE\s+([A-Z0-9_-]+)": "++INCLUDE", r"(?m)^\s*-INC\s+([A-Z0-9_-]+)": "-INC", r"EXEC\s+SQL\s+INCLUDE\s+([A-Z0-9_-]+)": "INCLUDE"}
    found = lambda t: F.flatten(F.array(*[F.when(F.contains(t, F.lit(word)), F.regexp_extract_all(t, F.lit(p), 1)).when(t.isNotNull(), none) for p, word in patterns.items()]))
    return F.array_distinct(let(text, found))


def missing_books(used: DataFrame, index: DataFrame, key: str = "root", name: str = "name") -> DataFrame:
    """Books that are used and that no index row has."""
    return used.select(key, name).distinct().join(index.select(name).distinct(), name, "left_anti").select(key, name)


# Units


def unit_paragraphs(programs: DataFrame) -> DataFrame:
    """Paragraphs for unit tests: ``program, name, line_start, line_end`` (from 1), ``body``; names may begin with digits,
    comments count as text, and reserved words on a line of their own begin none."""
    return in_batches(programs, blocks.unit_cutter(RESERVED_LINES), "name string, line_start int, line_end int, body string")


def performed(body: str | Column) -> Column:
    """Upper-cased names after PERFORM that are no loop words, in order."""
    return F.filter(F.regexp_extract_all(F.upper(as_column(body)), F.lit(r"PERFORM\s+([A-Z0-9-]+)"), 1), lambda x: ~x.isin(*LOOP_WORDS))


def variables_read(body: str | Column) -> Column:
    """Sources of MOVE and ADD, compared names of IF, and names on the right of COMPUTE, sorted; a name ends at a hyphen
    where a word does."""
    text = F.upper(as_column(body))
    simple = [F.regexp_extract_all(text, F.lit(p), 1) for p in (r"MOVE\s+(\w+)\s+TO", r"IF\s+(\w+)\s*[<>=]", r"ADD\s+(\w+)\s+TO")]
    right = F.regexp_extract_all(text, F.lit(r"(?s)COMPUTE\s+\w+\s*=\s*(.+?)(?:\.|$)"), 1)
    names = F.flatten(F.transform(right, lambda x: F.regexp_extract_all(x, F.lit("([A-Z][A-Z0-9-]*)"), 1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*simple, names), lambda x: ~x.rlike(r"^\d+$"))))


def variables_written(body: str | Column) -> Column:
    """Targets of MOVE, COMPUTE, ADD and SUBTRACT, sorted."""
    text = F.upper(as_column(body))
    moved = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)MOVE\s+.+?\s+TO\s+(.+?)(?:\.|$)"), 1), lambda x: F.regexp_extract_all(x, F.lit("([A-Z][A-Z0-9-]+)"), 1)))
    others = [F.regexp_extract_all(text, F.lit(p), 1) for p in (r"COMPUTE\s+([A-Z][A-Z0-9-]*)\s*=", r"ADD\s+.+?\s+TO\s+([A-Z][A-Z0-9-]+)", r"SUBTRACT\s+.+?\s+FROM\s+([A-Z][A-Z0-9-]+)")]
    return F.array_sort(F.array_distinct(F.concat(moved, *others)))


def blocking_reason(body: str | Column, patterns: dict[str, str] = BLOCKING) -> Column:
    """Why a paragraph cannot run alone: the first pattern that it matches."""
    body = as_column(body)
    return F.coalesce(*[F.when(_begun(F.upper(body), p) & body.rlike(f"(?i){p}"), F.lit(reason)) for p, reason in patterns.items()])


def _begun(up: Column, pattern: str) -> Column:
    """Whether an upper-case text holds the word that a pattern begins with; true for patterns that begin with none."""
    word = re.match(r"(?:\\b)?([A-Z]+)(?=\\s\+[^|]*$)", pattern)
    return F.contains(up, F.lit(word[1])) if word else F.lit(True)


def isolation_score(body: str | Column, performs: Column, read: Column, written: Column) -> Column:
    """How pure a paragraph is: .5, more for computation, outputs and displays, less for many performs and variables."""
    body = as_column(body)
    kinds = reduce(lambda a, b: a + b, [(F.contains(F.upper(body), F.lit(w)) & body.rlike(rf"(?i)\b{w}\s+")).cast("int") for w in COMPUTATION])
    step = lambda x, *cuts: reduce(lambda out, c: F.when(x >= c[0], c[1]).otherwise(out), reversed(cuts), F.lit(0.0))
    score = 0.5 + step(kinds, (3, 0.3), (1, 0.15)) - step(F.size(performs), (6, 0.3), (3, 0.15)) + step(F.size(written), (1, 0.1)) - step(F.size(read) + F.size(written), (16, 0.2), (11, 0.1))
    score = score + F.when(F.contains(F.upper(body), F.lit("DISPLAY")), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def isolated_units(paragraphs_: DataFrame) -> DataFrame:
    """Unit paragraphs with what they perform, read and write, whether and why they are blocked, and their score."""
    none = F.array().cast("array<string>")
    where = lambda found, *cores: F.when(~any_in(F.upper("body"), *cores), none).otherwise(found("body"))
    found = {"performs": where(performed, "PERFORM"), "inputs": where(variables_read, "MOVE", "IF", "ADD", "COMPUTE"), "outputs": where(variables_written, "MOVE", "COMPUTE", "ADD", "SUBTRACT")}
    rows = paragraphs_.withColumns(found | {"blocking_reason": blocking_reason("body")})
    score = F.when(F.col("blocking_reason").isNull(), isolation_score("body", F.col("performs"), F.col("inputs"), F.col("outputs"))).otherwise(0.0)
    return rows.withColumn("isolation_score", score)


def unit_totals(units: DataFrame) -> DataFrame:
    """Paragraphs, lines, performs, and isolated units of each program with their share, mean score and class."""
    free = F.col("blocking_reason").isNull()
    size = F.col("line_end") - F.col("line_start") + 1
    out = units.groupBy("program").agg(
        F.count("*").alias("paragraphs"), F.sum(size).alias("lines"), F.avg(size).alias("mean_lines"), F.count_if(F.size("performs") > 0).alias("performing"), F.sum(F.size("performs")).alias("performs"),
        F.count_if(free).alias("isolated"), F.coalesce(F.avg(F.when(free, F.col("isolation_score"))), F.lit(0.0)).alias("mean_score"),
    )
    share = F.col("isolated") / F.col("paragraphs") * 100
    return out.withColumn("isolated_percent", share).withColumn("class", F.when(share >= 95, "FULLY_EXECUTABLE").when(share > 0, "PARTIALLY_EXECUTABLE").otherwise("NON_EXECUTABLE"))


def blockers(units: DataFrame) -> DataFrame:
    """How many paragraphs each reason blocks, by program."""
    return units.filter("blocking_reason is not null").groupBy("program", "blocking_reason").agg(F.count("*").alias("n"))


# External calls


def without_sequence_numbers(source: str | Column) -> Column:
    """Source without numbers in columns 1 to 6 and without comment lines; blank lines stay."""
    number = lambda x: F.when((F.length(x) > 6) & F.trim(F.substr(x, F.lit(1), F.lit(6))).rlike(r"^\d+$"), F.concat(F.lit("      "), F.substr(x, F.lit(7)))).otherwise(x)
    kept = F.filter(F.transform(lines(source), number), lambda x: (F.trim(x) == "") | ~((F.length(x) > 6) & F.substr(x, F.lit(7), F.lit(1)).isin("*", "/", "-")))
    return F.array_join(kept, "\n")


def detected_calls(programs: DataFrame, kinds: dict[str, tuple[str, str]] = CALL_KINDS) -> DataFrame:
    """``program, type, category, target`` of every match of every pattern, over line ends."""
    rows = programs.select("program", without_sequence_numbers("source").alias("text"))
    hits = [F.transform(F.regexp_extract_all("text", F.lit(f"(?is){p}"), 1), _call(kind, category)) for kind, (p, category) in kinds.items()]
    return rows.select("program", F.inline(F.flatten(F.array(*hits))))


def _call(kind: str, category: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.trim(x).alias("target"))


def call_summary(programs: DataFrame, calls_: DataFrame, categories: tuple[str, ...] = ("SQL", "CICS", "CALL", "FILE")) -> DataFrame:
    """Calls of each program in all and by category, and how many a document can be held against (all but files)."""
    by = calls_.groupBy("program").agg(F.count("*").alias("calls"), *[F.count_if(F.col("category") == c).alias(c.lower()) for c in categories], F.count_if(F.col("category") != "FILE").alias("evaluable"))
    names = ["calls", *[c.lower() for c in categories], "evaluable"]
    return programs.select("program").join(shuffled(by), "program", "left").fillna(0, names)


def line_of(source: str | Column, place: Column) -> Column:
    """Line number, from 1, of a character position (from 0)."""
    return F.size(lines(F.substr(as_column(source), F.lit(1), place)))

"""The second source language: subroutines, arrays, calls, handlers and rules of labelled line-oriented BASIC programs.

Everything is cut inside the row's array of lines, without a shuffle; only rule numbers are counted by program.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.functions.text import as_column, let, lines

# Patterns and words of the language.
COMMENT = r"^\s*(?:\*|!|[Rr][Ee][Mm]\s)"
LABEL = r"^\s*([A-Za-z0-9_.]+)\s*:\s*$"
RETURN = r"(?i)^\s*RETURN\s*$"
ARRAY = r"(?i)^\s*DIM\s+(\w+)\s*\(\s*(.+?)\s*\)"
CALL = r"(?i)^\s*CALL\s+(\w+)"
EXECUTE = r"(?i)^\s*EXECUTE\s+(.+)"
GOSUB = r"(?i)^\s*GOSUB\s+(\w+)"
FILE_WORDS = ("OPEN ", "CLOSE ", "READ ", "WRITE ", "MATREAD", "MATWRITE")
LOGIC_WORDS = ("IF ", "FOR ", "LOOP", "BEGIN CASE", "GOSUB ")
NO_KEYWORDS = ("IF", "THEN", "ELSE", "END", "BEGIN", "CASE", "FOR", "TO", "NEXT", "LOOP", "WHILE", "UNTIL", "REPEAT", "RETURN", "GOSUB", "GOTO", "AND", "OR", "NOT", "EQ", "NE", "LT", "GT", "LE", "GE")
# End of fixed values.


def is_comment(line: Column) -> Column:
    """A line that begins with ``*``, ``!`` or REM."""
    return line.rlike(COMMENT)


def _code_lines(source: str | Column) -> Column:
    """Array of ``at`` (from 0) and ``line`` of the lines that are no comments."""
    rows = F.transform(lines(source), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    return F.filter(rows, lambda r: ~is_comment(r["line"]))


def _found(rows: Column, pattern: str, group: int = 1) -> Column:
    """Array of ``at`` and ``value`` of the lines that match."""
    return F.transform(F.filter(rows, lambda r: r["line"].rlike(pattern)), lambda r: F.struct(r["at"].alias("at"), F.regexp_extract(r["line"], pattern, group).alias("value")))


def split_statements(code: Column) -> Column:
    """Statements of an array of lines, cut at semicolons."""
    parts = F.flatten(F.transform(code, lambda x: F.split(x, ";")))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: (s != "") & ~is_comment(s))


def subroutines(programs: DataFrame) -> DataFrame:
    """``program, name, start_line, end_line`` (from 1), ``content, statements, class`` of each label's lines up to its
    RETURN, the next label or the end."""

    def blocks(rows: Column) -> Column:
        heads = _found(rows, LABEL)

        def block(hs: Column, h: Column, j: Column) -> Column:
            after = F.coalesce(F.get(hs, j + 1)["at"], F.size(lines("source")))
            own = F.filter(rows, lambda r: (r["at"] > h["at"]) & (r["at"] < after))
            end = F.coalesce(F.get(F.filter(own, lambda r: r["line"].rlike(RETURN)), F.lit(0))["at"] + 1, after)
            code = F.transform(F.filter(own, lambda r: r["at"] < end), lambda r: r["line"])
            return F.struct(F.upper(h["value"]).alias("name"), (h["at"] + 1).alias("start_line"), end.alias("end_line"), F.array_join(code, "\n").alias("content"), split_statements(code).alias("statements"))

        return let(heads, lambda hs: F.transform(hs, lambda h, j: block(hs, h, j)))

    out = programs.select("program", F.inline(let(_code_lines("source"), blocks)))
    return out.withColumn("class", subroutine_class("content"))


def subroutine_class(content: str | Column) -> Column:
    """MIXED with calls, INFRASTRUCTURE with file access and no logic, else PURE."""
    upper = F.upper(as_column(content))
    has = lambda found: reduce(lambda a, b: a | b, [F.contains(upper, F.lit(x)) for x in found])
    return F.when(has(("CALL ", "EXECUTE ")), "MIXED").when(has(FILE_WORDS) & ~has(LOGIC_WORDS), "INFRASTRUCTURE").otherwise("PURE")


def arrays(programs: DataFrame) -> DataFrame:
    """``program, name, dimensions, line_no`` (from 1) of each DIM; of arrays of one name the first counts."""
    rows = F.filter(_code_lines("source"), lambda r: r["line"].rlike(ARRAY))
    found = F.transform(rows, lambda r: F.struct(F.upper(F.regexp_extract(r["line"], ARRAY, 1)).alias("name"), F.regexp_extract(r["line"], ARRAY, 2).alias("dimensions"), (r["at"] + 1).alias("line_no")))
    first = let(found, lambda fs: F.filter(fs, lambda f, i: ~F.exists(F.slice(fs, F.lit(1), i), lambda g: g["name"] == f["name"])))
    return programs.select("program", F.inline(first))


def external_calls(programs: DataFrame) -> DataFrame:
    """``program, type, target, line_no`` of CALL and EXECUTE lines; of a quoted command its first word."""
    target = lambda x: F.when(x.rlike(r"^['\"]"), F.get(F.split(F.regexp_replace(x, r"^['\"]+|['\"]+$", ""), r"\s+"), F.lit(0))).otherwise(x)
    row = lambda kind, value, at: F.struct(F.lit(kind).alias("type"), value.alias("target"), (at + 1).alias("line_no"))
    rows = _code_lines("source")
    both = F.concat(F.transform(_found(rows, CALL), lambda f: row("CALL", F.upper(f["value"]), f["at"])), F.transform(_found(rows, EXECUTE), lambda f: row("EXECUTE", target(F.trim(f["value"])), f["at"])))
    return programs.select("program", F.inline(both))


def gosub_targets(source: str | Column) -> Column:
    """Upper-cased labels of the lines that begin with GOSUB, in order."""
    return F.transform(_found(F.transform(lines(source), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), GOSUB), lambda f: F.upper(f["value"]))


def error_handlers(programs: DataFrame) -> DataFrame:
    """``program, type, target, line_no`` of ON ERROR jumps and LOCKED clauses; a line may have both."""
    rows = F.transform(lines("source"), lambda x, i: F.struct(i.alias("at"), F.upper(x).alias("line")))
    pattern = r"ON\s+ERROR\s+(GOTO|GOSUB)\s+(\w+)"
    jumps = F.transform(F.filter(rows, lambda r: r["line"].rlike(pattern)), lambda r: F.struct(F.concat(F.lit("ON_ERROR_"), F.regexp_extract(r["line"], pattern, 1)).alias("type"), F.regexp_extract(r["line"], pattern, 2).alias("target"), (r["at"] + 1).alias("line_no")))
    locks = F.transform(F.filter(rows, lambda r: F.contains(r["line"], F.lit("LOCKED"))), lambda r: F.struct(F.lit("LOCKED").alias("type"), F.lit("").alias("target"), (r["at"] + 1).alias("line_no")))
    return programs.select("program", F.inline(F.concat(jumps, locks)))


def keywords(line: str | Column) -> Column:
    """Distinct names of a line that are no words of the language, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(as_column(line), F.lit(r"\b([A-Za-z][A-Za-z0-9_.]*)\b"), 1), lambda w: ~F.upper(w).isin(*NO_KEYWORDS)))


def business_rules(programs: DataFrame) -> DataFrame:
    """``program, rule_id, rule_type, priority, line_no, paragraph, keywords`` of conditions, case blocks and calculations.

    ``paragraph`` is the first subroutine whose lines hold the rule: a search within the program's own subroutines.
    """
    rows = F.transform(lines("source"), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    code = F.filter(rows, lambda r: (r["line"] != "") & ~r["line"].rlike(r"^[*!]"))

    def rule(r: Column) -> Column:
        upper = F.upper(r["line"])
        parts = F.split(r["line"], "=")
        right = F.trim(F.get(parts, F.lit(1)))
        computes = (F.size(parts) == 2) & ~upper.startswith("IF ") & right.rlike(r"[-+*/(]") & ~right.startswith('"')
        kind = F.when(upper.startswith("IF ") & F.contains(upper, F.lit(" THEN")), "condition").when(F.contains(upper, F.lit("BEGIN CASE")), "case").when(computes, "calculation")
        words = F.when(kind == "case", F.array(F.lit("case"), F.lit("switch"), F.lit("conditional"))).otherwise(keywords(r["line"]))
        return F.struct(kind.alias("rule_type"), F.when((kind == "calculation") & upper.rlike("TOTAL|SUM"), "CRITICAL").otherwise("IMPORTANT").alias("priority"), (r["at"] + 1).alias("line_no"), words.alias("keywords"))

    found = programs.select("program", F.inline(F.filter(F.transform(code, rule), lambda r: r["rule_type"].isNotNull())))
    found = found.withColumn("rule_id", F.format_string("BR-%03d", F.row_number().over(Window.partitionBy("program").orderBy("line_no"))))
    return containing(found, subroutines(programs))


def containing(rows: DataFrame, blocks: DataFrame, key: str = "program") -> DataFrame:
    """Rows with the name of the first block of their key whose lines hold ``line_no``, empty without any.

    A key's blocks are gathered into one array of names and bounds, so that rows are not multiplied by them.
    """
    own = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("blocks"))
    inside = F.filter(F.coalesce("blocks", F.array().cast("array<struct<start_line:int,end_line:int,name:string>>")), lambda b: F.col("line_no").between(b["start_line"], b["end_line"]))
    return rows.join(own, key, "left").withColumn("paragraph", F.coalesce(F.get(inside, F.lit(0))["name"], F.lit(""))).drop("blocks")

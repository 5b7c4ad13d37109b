"""Tests made from pictures, conditions and handlers, and the comparison of what programs put out."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from docmeter.functions.text import as_column, let, lines
from docmeter.operators.behaviour import tolerant_match
from docmeter.operators.verifier import case_blocks

# Inputs that bring an error about, and constructs that cannot run.
CANNED_INPUTS = {"file": ("FILE-STATUS", "35"), "zero": ("DIVISOR", "0"), "overflow": ("AMOUNT", "999999999"), "other": ("ERROR-FLAG", "Y")}
NOT_RUNNABLE = (r"EXEC\s+CICS", r"EIBCALEN", r"DFHCOMMAREA", r"DFHRESP", r"COPY\s+DFHAID", r"COPY\s+DFHBMSCA")
FORMULA_WORDS = {
    "product": ("multiply", "multiplied", "product", "times", " * "),
    "quotient": ("divide", "divided", "quotient", " / "),
    "difference": ("subtract", "minus", "difference", " - "),
    "sum": ("add", "sum", "total", "plus", " + ", "combined"),
    "percentage": ("percent", "%"),
    "plain": ("calculate", "compute", "determine"),
}
# End of fixed values.


def picture_range(picture: str | Column) -> Column:
    """Struct of ``kind, least, greatest``: the bounds of a numeric picture's integer part, or the length of a text one.

    Editing characters count as digits; a bracket's number replaces the digits beside it. Other pictures have a null kind.
    """
    pic = F.regexp_replace(F.regexp_replace(F.upper(F.trim(as_column(picture))), r"^PIC(?:TURE)?\s+", ""), r"\.$", "")
    struct = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("least"), b.alias("greatest"))

    def parts(pic: Column) -> Column:
        clean = F.regexp_replace(pic, r"[Z+\-.$,]", "9")
        return F.struct(pic.alias("pic"), clean.alias("clean"), F.replace(F.get(F.split(clean, "V"), F.lit(0)), F.lit("S"), F.lit("")).alias("whole"))

    def counted(p: Column) -> Column:
        bracket = F.regexp_extract(p["whole"], r"9\((\d+)\)", 1)
        digits = F.when(bracket != "", F.nullif(bracket, F.lit("")).cast("int")).otherwise(F.regexp_count(p["whole"], F.lit("9")))
        return F.struct(p["pic"].alias("pic"), p["clean"].alias("clean"), digits.alias("digits"))

    def bounds(p: Column) -> Column:
        most = F.pow(F.lit(10.0), p["digits"]) - 1
        signed = p["clean"].startswith("S") | p["pic"].rlike(r"[+-]")
        length = F.when(p["pic"].rlike(r"\("), F.regexp_extract(p["pic"], r"\((\d+)\)", 1).try_cast("double")).otherwise(F.length(p["pic"]).cast("double"))
        numeric = p["clean"].rlike(r"^S?(?:9+|\d*9\(\d+\))(?:V(?:9+|\d*9\(\d+\)))?$") & (p["digits"] > 0)
        out = F.when(numeric, struct("numeric", F.when(signed, -most).otherwise(0.0), most)).when(p["pic"].rlike(r"^X+(?:\(\d+\))?$"), struct("alphanumeric", F.lit(0.0), length))
        return out.when(p["pic"].rlike(r"^A+(?:\(\d+\))?$"), struct("alphabetic", F.lit(0.0), length)).otherwise(struct(None, F.lit(None).cast("double"), F.lit(None).cast("double")))

    return let(let(let(pic, parts), counted), bounds)


def boundary_cases(fields: DataFrame, key: str = "program") -> DataFrame:
    """``field, variant, value`` at the bounds of every elementary field: least, greatest and zero, or empty and full."""
    rows = fields.filter("picture is not null and level > 1").withColumn("r", picture_range("picture"))
    case = lambda name, value: F.struct(F.lit(name).alias("variant"), value.alias("value"))
    low, high = F.col("r.least"), F.col("r.greatest")
    numeric = F.array_compact(F.array(case("minimum", low), case("maximum", high), F.when(F.lit(0.0).between(low, high), case("zero", F.lit(0.0)))))
    cases = F.when(F.col("r.kind") == "numeric", numeric).when(F.col("r.kind") == "alphanumeric", F.array(case("empty", F.lit(0.0)), case("full", high)))
    return rows.select(key, F.col("name").alias("field"), F.inline(cases))


def condition_inputs(condition: str | Column, holds: bool) -> Column:
    """Struct of ``variable, value`` that makes a comparison true or false, null where there is none."""
    text, pattern = as_column(condition), r"(\w+)\s*(>=|<=|>|<|=)\s*['\"]?(\w+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    op, value, number = part(2), part(3), part(3).try_cast("long")
    step = F.when(op == ">", 1).when(op == "<", -1).otherwise(0) if holds else F.when(op == ">", -1).when(op == "<", 1).when(op == ">=", -1).otherwise(1)
    other = value if holds else F.when(op == "=", "DIFFERENT")
    return F.when(op != "", F.struct(part(1).alias("variable"), F.coalesce((number + step).cast("string"), other).alias("value")))


def branch_cases(conditions_: DataFrame, key: str = "program") -> DataFrame:
    """A true and a false case of every comparison."""
    both = F.array(*[F.struct(F.lit(str(h).lower()).alias("variant"), condition_inputs("condition", h).alias("i")) for h in (True, False)])
    return conditions_.select(key, "condition", F.inline(both)).filter("i is not null").select(key, "condition", "variant", "i.variable", "i.value")


def evaluate_cases(programs: DataFrame, key: str = "program", most_cases: int = 3) -> DataFrame:
    """``key, nth, variable, value`` of the first few cases of every EVALUATE (``nth``): inputs that take each branch.

    Cases are what follows WHEN; OTHER is none.
    """
    values = lambda b: F.filter(F.regexp_extract_all(b, F.lit(r"\bWHEN\s+['\"]?([^\s'\"]+)"), 1), lambda v: v != "OTHER")
    found = F.transform(case_blocks(F.upper("source")), lambda m: F.struct(m["v"].alias("variable"), F.slice(values(m["b"]), 1, most_cases).alias("values")))
    return programs.select(key, F.posexplode(found).alias("nth", "c")).select(key, "nth", F.col("c.variable").alias("variable"), F.explode("c.values").alias("value"))


def error_input(kind: str | Column, condition: str | Column) -> Column:
    """Struct of ``variable, value`` that should bring a handler's error about."""
    kind, text = F.lower(as_column(kind)), F.upper(as_column(condition))
    case = lambda x: F.struct(F.lit(CANNED_INPUTS[x][0]).alias("variable"), F.lit(CANNED_INPUTS[x][1]).alias("value"))
    return F.when(F.contains(text, F.lit("FILE STATUS")) | (kind == "file_status"), case("file")).when(F.contains(text, F.lit("ZERO")) | F.contains(kind, F.lit("div")), case("zero")).when(F.contains(text, F.lit("OVERFLOW")), case("overflow")).otherwise(case("other"))


def typical_inputs(fields: DataFrame, key: str = "program", most: int = 5) -> DataFrame:
    """The middle of the range of each of a program's first few elementary fields."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    rows = fields.filter("picture is not null and level > 1").withColumn("nth", nth).filter(F.col("nth") <= most).withColumn("r", picture_range("picture"))
    return rows.select(key, F.col("name").alias("field"), F.floor((F.col("r.least") + F.col("r.greatest")) / 2).cast("double").alias("value"))


def first_tests(tests: DataFrame, key: str, most: int, priority: str = "priority", *order: str) -> DataFrame:
    """The tests of highest priority (1 first) of each key; ties go by a hash of ``order``, the same in every run."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(priority, F.xxhash64(*order), *order))
    return tests.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def formula_value(claim: str | Column, values: Column, found: dict[str, tuple[str, ...]] = FORMULA_WORDS) -> Column:
    """What a claim's first kind of formula words makes of its inputs; null without enough of them."""
    low = F.lower(as_column(claim))
    kind = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in words]), F.lit(name)) for name, words in found.items()])
    n, first, second = F.size(values), F.get(values, F.lit(0)), F.get(values, F.lit(1))
    fold = lambda start, f: F.aggregate(values, F.lit(start), f)
    total = fold(0.0, lambda a, b: a + b)
    by = {
        "product": F.when(n >= 2, fold(1.0, lambda a, b: a * b)), "quotient": F.when((n >= 2) & (second != 0), F.try_divide(first, second)), "difference": F.when(n >= 2, first - second), "sum": total,
        "percentage": F.when(n >= 2, first / 100.0 * second).otherwise(first / 100.0), "plain": total,
    }
    return F.when(n >= 1, reduce(lambda out, k: F.when(kind == k, by[k]).otherwise(out), by, F.lit(None).cast("double")))


def can_run(source: str | Column) -> Column:
    """Whether a program holds none of the constructs that need a transaction monitor."""
    return ~as_column(source).rlike("(?i)" + "|".join(NOT_RUNNABLE))


def gap_list(code: str | Column) -> Column:
    """Array of ``line_no, description`` of gap markers."""
    found = F.transform(lines(code), lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(F.regexp_extract(x, r"\[GAP:\s*([^\]]+)\]", 1)).alias("description")))
    return F.filter(found, lambda g: g["description"] != "")


def file_similarity(left: Column, right: Column, similar) -> Column:
    """Share of common files of two maps, times the mean similarity of their contents; 1 if both are empty."""
    common = F.array_intersect(F.map_keys(left), F.map_keys(right))
    coverage = F.size(common) / F.greatest(F.size(left), F.size(right), F.lit(1))
    total = F.aggregate(common, F.lit(0.0), lambda s, n: s + similar(left[n], right[n]))
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).otherwise(coverage * F.coalesce(F.try_divide(total, F.size(common)), F.lit(0.0)))


def batch_verdict(runs: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Matches of runs paired by their number (``left_ok, right_ok, similarity, gaps``; null where a side has no such run).

    Sides of unequal length score 0 with one error. ``failures`` has CF-03 from a tenth of mismatches and errors on, and
    CF-06 where nearly all pass although gap markers are left.
    """
    fine = F.col("left_ok") & F.col("right_ok")
    match = F.coalesce(fine & (F.col("similarity") >= least), F.lit(False))
    unequal = F.max(F.col("left_ok").isNull() | F.col("right_ok").isNull())
    out = runs.groupBy(key).agg(F.count("*").alias("tests"), F.count_if(match).alias("matches"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("errors"), F.bool_or(F.coalesce("gaps", F.lit(False))).alias("gaps"), unequal.alias("unequal"))
    rate, share = (F.col("tests") - F.col("matches")) / F.col("tests"), F.col("matches") / F.col("tests")
    failures = F.filter(F.array(F.when(rate >= 0.10, "CF-03"), F.when((share >= least) & F.col("gaps"), "CF-06")), lambda x: x.isNotNull())
    failures = F.when(F.col("unequal"), F.array(F.lit("Result count mismatch"))).otherwise(failures)
    return out.select(key, "tests", F.when(F.col("unequal"), 0).otherwise(F.col("matches")).alias("matches"), F.when(F.col("unequal"), 1).otherwise(F.col("errors")).alias("errors"), F.when(F.col("unequal"), 0.0).otherwise(share).alias("score"), failures.alias("failures"))


def printed_values(stdout: str | Column) -> Column:
    """Array of ``name`` (upper case, hyphens for underscores) and ``value`` of lines that print ``NAME: value`` or ``NAME = value``."""
    pattern = r"(?m)^[ \t]*([A-Za-z][A-Za-z0-9_-]*)[ \t]*[:=][ \t]*(\S.*?)[ \t]*$"
    both = F.arrays_zip(F.regexp_extract_all(as_column(stdout), F.lit(pattern), 1).alias("name"), F.regexp_extract_all(as_column(stdout), F.lit(pattern), 2).alias("value"))
    return F.transform(both, lambda v: F.struct(F.translate(F.upper(v["name"]), "_", "-").alias("name"), v["value"].alias("value")))


def values_match(stdout: str | Column, expected: Column) -> Column:
    """Whether a program printed every expected value (a map by name): under its name within the tolerance, or, where that
    name is not printed, under any name or anywhere in the output."""
    text = as_column(stdout)

    def printed(values: Column, name: Column, value: Column) -> Column:
        own = F.filter(values, lambda v: v["name"] == F.translate(F.upper(name), "_", "-"))
        anywhere = F.exists(values, lambda v: tolerant_match(value, v["value"])) | F.contains(text, value)
        return F.when(F.size(own) > 0, tolerant_match(value, F.get(own, F.lit(0))["value"])).otherwise(anywhere)

    return let(printed_values(text), lambda values: F.forall(F.map_entries(expected), lambda e: printed(values, e["key"], e["value"])))


# Sequence overlap


@F.pandas_udf(LongType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays, by bits of one integer for a row of the table."""
    return pd.Series([_common(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def _common(a: list[str], b: list[str]) -> int:
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def f_measure(common: Column, reference: Column, candidate: Column) -> Column:
    """Harmonic mean of common over either size, 0 where nothing is common."""
    return F.coalesce(F.try_divide(2.0 * common, reference + candidate), F.lit(0.0))

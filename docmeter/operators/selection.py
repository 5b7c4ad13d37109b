"""File metrics, difficulty, tiers and stratified selection of candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.functions.text import as_column, lines

SIZE_CUTS = (20_000, 40_000, 80_000)
SCORE_WEIGHTS = {"business_logic": 10.0, "dependencies": 5.0, "file_io": 5.0, "in_loc_range": 10.0, "has_comments": -5.0, "complexity": 3.0}
# Domain keywords.
DOMAINS = {
    "banking": ("account", "balance", "deposit", "withdrawal", "transaction", "card", "atm", "branch", "customer", "savings", "checking"),
    "finance": ("interest", "loan", "payment", "credit", "debit", "rate", "principal", "amortization", "portfolio", "investment"),
    "insurance": ("policy", "claim", "premium", "coverage", "underwriting", "beneficiary", "insured", "risk", "liability"),
    "retail": ("inventory", "order", "customer", "product", "sale", "purchase", "price", "quantity", "warehouse", "shipment"),
    "hr": ("employee", "payroll", "salary", "department", "hire", "benefit", "time", "attendance", "leave", "pension"),
}
# End of fixed values.


def code_lines(text: str | Column) -> Column:
    """Lines that are neither blank nor begin with ``*`` or ``/``."""
    return F.regexp_count(as_column(text), F.lit(r"(?dm)^[ \t\x0B\f\r]*+[^\s*/]"))


_BY_WORD = re.compile(r"\(\?i\)\\b([A-Za-z]+)(?![?*+{])([^|]*)")


def _word_first(pattern: str) -> str:
    """A pattern that looks for its first word before the word's bound, which would else be tried at each character."""
    found = _BY_WORD.fullmatch(pattern)
    return rf"(?i){found[1]}(?<=\b{found[1]}){found[2]}" if found else pattern


def _holds(text: Column, pattern: str) -> Column:
    """Whether a text matches; a pattern that begins with a word is tried only where the word is."""
    found = _BY_WORD.fullmatch(pattern)
    return F.contains(F.upper(text), F.lit(found[1].upper())) & text.rlike(_word_first(pattern)) if found else text.rlike(pattern)


def count_of(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(as_column(text), F.lit(_word_first(pattern)))


def cyclomatic(text: str | Column, branch: str = r"(?i)\bIF\b", switch: str = r"(?i)\bEVALUATE\b", loop: str = r"(?i)\bPERFORM\s+.*\bUNTIL\b") -> Column:
    return 1 + count_of(text, branch) + count_of(text, switch) + count_of(text, loop)


def nesting_depth(text: str | Column, opens: str = r"(?i)\bIF\b", closes: str = r"(?i)\bEND-IF\b") -> Column:
    """Greatest depth of lines that open less lines that close; the depth never falls below 0."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    marks = F.transform(lines(text), lambda x: F.struct(_holds(x, opens).cast("int").alias("opens"), _holds(x, closes).alias("closes")))

    def step(s: Column, mark: Column) -> Column:
        up = s["now"] + mark["opens"]
        return F.struct(F.when(mark["closes"], F.greatest(F.lit(0), up - 1)).otherwise(up).alias("now"), F.greatest(s["most"], up).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def distinct_names(text: str | Column, pattern: str, most: int | None = None) -> Column:
    """First occurrences of a pattern's group in order."""
    found = F.array_distinct(F.regexp_extract_all(as_column(text), F.lit(pattern), 1))
    return F.slice(found, 1, most) if most else found


def stepped(value: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The first step's score whose bound is above the value."""
    out = F.lit(beyond)
    for bound, score in reversed(steps):
        out = F.when(value < bound, score).otherwise(out)
    return out


def difficulty(loc: Column, complexity: Column, nesting: Column, dependencies: Column, rules: Column) -> Column:
    """0 to 110: buckets of size (.3), complexity (.3), dependencies (.2) and rules (.2), and a bonus for rules."""
    by_loc = stepped(loc, [(300, 0.0), (500, 0.2), (800, 0.4), (1200, 0.6), (1800, 0.8)], 1.0)
    by_complexity = 0.7 * stepped(complexity, [(5, 0.0), (10, 0.3), (20, 0.6), (40, 0.8)], 1.0) + 0.3 * stepped(nesting, [(2, 0.0), (4, 0.5)], 1.0)
    by_dependencies = stepped(dependencies, [(1, 0.0), (3, 0.3), (6, 0.6), (10, 0.8)], 1.0)
    by_rules = stepped(rules, [(3, 0.0), (8, 0.4), (15, 0.7)], 1.0)
    bonus = F.least(rules / 15.0, F.lit(1.0)) * 10
    return F.round(30 * by_loc + 30 * by_complexity + 20 * by_dependencies + 20 * by_rules + bonus, 2)


def difficulty_level(score: Column, easy: float = 30, medium: float = 60) -> Column:
    return F.when(score < easy, "easy").when(score < medium, "medium").otherwise("hard")


def interestingness(rules: Column, dependencies: Column, file_operations: Column, loc: Column, comments: Column, complexity: Column, weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    capped = lambda c, n: F.least(c / float(n), F.lit(1.0))
    size = F.when(loc.between(500, 2000), 1.0).when(loc.between(300, 3000), 0.5).otherwise(0.0)
    return (
        weights["business_logic"] * capped(rules, 10)
        + weights["dependencies"] * capped(dependencies, 5)
        + F.when(file_operations > 0, weights["file_io"]).otherwise(0.0)
        + weights["in_loc_range"] * size
        + F.when(comments, weights["has_comments"]).otherwise(0.0)
        + weights["complexity"] * capped(complexity, 20)
    )


def domain(text: str | Column, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """The domain with most distinct keywords in the text, the first on ties; ``general`` without any."""
    low = F.lower(as_column(text))
    counts = [F.struct((-sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0))).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, keys) in enumerate(domains.items())]
    best = F.array_min(F.array(*counts))
    return F.when(best["n"] < 0, best["name"]).otherwise("general")


def size_tier(size: Column, boost: Column, cuts: tuple[int, int, int] = SIZE_CUTS) -> Column:
    """T1 to T4 by size, raised by whole steps of the boost."""
    base = sum(((size >= c).cast("int") for c in cuts), F.lit(0))
    return F.concat(F.lit("T"), (F.least(F.lit(3), base + F.floor(boost).cast("int")) + 1).cast("string"))


def code_boost(cics: Column, sql: Column, gotos: Column, calls: Column) -> Column:
    jumps = F.when(gotos > 10, 1.0).when(gotos > 5, 0.5).otherwise(0.0)
    return F.when(cics > 0, 2.0).otherwise(0.0) + F.when(sql > 0, 1.0).otherwise(0.0) + jumps + F.when(calls > 5, 0.5).otherwise(0.0)


def tier_targets(total: int) -> dict[str, int]:
    return {"T1": int(total * 0.25), "T2": int(total * 0.205) + 1, "T3": int(total * 0.205), "T4": int(total * 0.34)}


def round_robin(candidates: DataFrame, targets: dict[str, int], tier: str = "tier", dataset: str = "dataset", score: str = "score", tie: str = "tie") -> DataFrame:
    """Each tier's target, taken in turns from its datasets by name, each dataset's best first.

    A row is in round r if it is its dataset's r-th; rounds go by dataset name. Only rows of the first ``target`` rounds
    can be chosen: tasks keep no more of a dataset before they pass its rows on, nor of a tier for the second window.
    """
    top = max([0, *targets.values()])
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col(tier)], F.lit(0))
    turn = F.row_number().over(Window.partitionBy(tier, dataset).orderBy(F.desc(score), tie))
    rows = candidates.withColumn("round", turn).filter(F.col("round") <= top).filter(F.col("round") <= most)
    place = F.row_number().over(Window.partitionBy(tier).orderBy("round", dataset))
    return rows.withColumn("place", place).filter(F.col("place") <= top).filter(F.col("place") <= most)


def representative(tasks: DataFrame, limit: int, tier: str = "tier", key: str = "task_id", offset: int = 0) -> DataFrame:
    """One of each tier first, then the rest tier by tier: ``limit`` rows from ``offset`` on.

    No more than the first ``offset + limit`` rows of a tier can be among them; tasks keep no more before they pass rows on.
    """
    first = F.row_number().over(Window.partitionBy(tier).orderBy(key))
    rows = tasks.withColumn("nth", first).filter(F.col("nth") <= offset + limit)
    return rows.orderBy((F.col("nth") > 1).cast("int"), tier, "nth").offset(offset).limit(limit)


def free_numbers(rows: DataFrame, taken: DataFrame, tier: str = "tier", order: str = "score", start: int = 1) -> DataFrame:
    """Rows numbered within their tier with numbers from ``start`` that ``taken`` (tier, number) doesn't hold."""
    nth = F.row_number().over(Window.partitionBy(tier).orderBy(order))
    wanted = rows.withColumn("nth", nth)
    need = wanted.groupBy(tier).agg(F.max("nth").alias("need"))
    used = taken.groupBy(tier).agg(F.collect_set("number").alias("used"))
    free = need.join(used, tier, "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = free.select(tier, F.array_sort(F.array_except(F.sequence(F.lit(start), F.lit(start) + F.col("need") + F.size("used")), F.col("used"))).alias("free"))
    return wanted.join(free, tier).withColumn("number", F.element_at("free", F.col("nth"))).drop("free", "nth")

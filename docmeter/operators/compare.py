"""Comparison of program outputs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docmeter.functions.text import as_column, lines, numbers


def normal_output(text: str | Column) -> Column:
    """Line ends unified, white space within lines collapsed, ends stripped."""
    unified = F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\r\n?", "\n")
    rows = F.transform(lines(unified), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")))
    return F.regexp_replace(F.array_join(rows, "\n"), r"\A\s+|\s+\z", "")


def numerically_equal(a: str | Column, b: str | Column, tolerance: float = 0.01) -> Column:
    """As many numbers in both texts, pairwise within the tolerance."""
    x, y = numbers(a), numbers(b)
    near = F.forall(F.zip_with(x, y, lambda u, v: F.coalesce(F.abs(u - v) <= tolerance, F.lit(False))), lambda ok: ok)
    return (F.size(x) == F.size(y)) & near


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters (longest matching blocks, recursively); null for nulls."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity", tolerance: float = 0.01) -> DataFrame:
    """1 for equal normal outputs, and for close ones with equal numbers; else the matching ratio.

    The Python function gets nulls for rows that do not differ.
    """
    rows = pairs.withColumns({"_a": normal_output(a), "_b": normal_output(b)})
    same = F.col("_a") == F.col("_b")
    rows = rows.withColumn(out, matching_ratio(F.when(~same, F.col("_a")), F.when(~same, F.col("_b"))))
    close = (F.col(out) > 0.90) & numerically_equal(a, b, tolerance)
    return rows.withColumn(out, F.when(same | close, 1.0).otherwise(F.col(out))).drop("_a", "_b")


def output_score(stdout: Column, files: Column, stderr: Column) -> Column:
    return 0.5 * stdout + 0.4 * files + 0.1 * stderr


def batch(compared: DataFrame, group: str, similarity: str = "similarity", error: str = "error", least: float = 0.95) -> DataFrame:
    """Matches over all tests of a group, and the critical failures of the batch."""
    match = ~F.col(error) & (F.col(similarity) >= least)
    out = compared.groupBy(group).agg(F.count("*").alias("tests"), F.count_if(match).alias("matches"), F.count_if(~F.col(error) & ~match).alias("mismatches"), F.count_if(F.col(error)).alias("errors"))
    return out.withColumns({"score": F.col("matches") / F.col("tests"), "failure": F.when((F.col("mismatches") + F.col("errors")) / F.col("tests") >= 0.10, "CF-03")})


def gap_share(code: str | Column) -> Column:
    """Lines with a gap marker over lines that are no comments."""
    kept = F.filter(lines(code), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("*"))
    gaps = F.filter(lines(code), lambda x: F.contains(x, F.lit("[GAP")))
    return F.coalesce(F.try_divide(F.size(gaps), F.size(kept)), F.lit(0.0))

"""Registered queries by name, the SQL that gives their rows, and what both share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query under a name together with its SQL."""

    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(x: Column) -> Column:
    """Six decimals by the same arithmetic as in SQL, where functions that round differ in ties."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def sql_fixed(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"

"""Programs and their documents, made of the rows of ``orders``: work for the operators on source code.

The given tables hold no programs. One is written for each order, with as many steps and fields as its key says, so that
queries on programs grow with the table; the texts are the same expressions in Spark's and DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmeter.plans.spread import dealt

#: Statement of step ``k`` by kind.
STATEMENTS = (
    "'COMPUTE WS-FLD-' || CAST(k AS STRING) || ' = WS-FLD-1 * 3'",
    "'IF WS-FLD-' || CAST(k AS STRING) || ' > 100 MOVE 1 TO WS-FLAG'",
    "'IF WS-CODE = ''A'' PERFORM STEP-1'",
    "'ADD WS-FLD-' || CAST(k AS STRING) || ' TO WS-TOTAL'",
    "'CALL ''SUBP' || CAST(k AS STRING) || ''' USING WS-AREA WS-FLD-' || CAST(k AS STRING)",
    "'CALL WS-PGM USING BY REFERENCE WS-AREA'",
    "'READ CUST-FILE AT END MOVE 1 TO WS-EOF'",
    "'GO TO STEP-1'",
    "'EXEC SQL SELECT NAME INTO :WS-N FROM CUSTOMERS END-EXEC'",
    "'MOVE ZEROS TO WS-FLD-' || CAST(k AS STRING)",
)
KEY, STEPS, KIND = "o_orderkey", "(2 + o_orderkey % 5)", f"((o_orderkey + k) % {len(STATEMENTS)})"
_NUMBER = "CAST(o_orderkey AS STRING)"
_STATEMENT = f"CASE {KIND} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(STATEMENTS)) + " END"
_HEAD = (
    "'       IDENTIFICATION DIVISION.'", f"'       PROGRAM-ID. PRG-' || {_NUMBER} || '.'", f"'      * totals of batch ' || {_NUMBER}", "'       ENVIRONMENT DIVISION.'", "'       INPUT-OUTPUT SECTION.'",
    "'           SELECT CUST-FILE ASSIGN TO ''CUSTDAT''.'", "'       DATA DIVISION.'", "'       WORKING-STORAGE SECTION.'", "'       COPY COMMON' || CAST(o_orderkey % 4 AS STRING) || '.'", "'       01  WS-AREA.'",
)
_FIELD = "'           05  WS-FLD-' || CAST(k AS STRING) || ' PIC 9(' || CAST(k + 1 AS STRING) || ')V99' || CASE WHEN k % 2 = 0 THEN ' COMP-3' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' OCCURS ' || CAST(k AS STRING) || ' TIMES' ELSE '' END || '.'"
_STEP = f"'       STEP-' || CAST(k AS STRING) || '.' || chr(10) || '           ' || {_STATEMENT} || '.'"
#: Lines before the fields, and before the first step where there are no fields and calls of steps.
HEAD_LINES, FIXED_LINES = len(_HEAD), len(_HEAD) + 3
_RULE = "'- Rule ' || CAST(k AS STRING) || ': when `WS-FLD-' || CAST(k AS STRING) || '` exceeds 100, STEP-' || CAST(k AS STRING) || ' moves 1 to WS-FLAG.'"


def _source(each) -> str:
    parts = [*_HEAD, each(_FIELD), "'       PROCEDURE DIVISION.'", "'       MAIN-LOGIC.'", each("'           PERFORM STEP-' || CAST(k AS STRING) || '.'"), "'           STOP RUN.'", each(_STEP)]
    return " || chr(10) || ".join(parts)


def _document(each) -> str:
    return " || ".join([
        "'# Overview' || chr(10) || chr(10) || 'This program calculates the balance because totals matter. It prevents errors.' || chr(10) || chr(10)",
        f"CASE WHEN o_orderkey % 2 = 0 THEN '## Business rules' || chr(10) || chr(10) || {each(_RULE)} || chr(10) || chr(10) ELSE '' END",
        "CASE WHEN o_orderkey % 3 = 0 THEN '## Edge cases' || chr(10) || chr(10) || '1. The CUST-FILE is empty at the end of file.' || chr(10) || '2. Invalid key errors are displayed.' || chr(10) || chr(10) ELSE '' END",
        "CASE WHEN o_orderkey % 5 = 0 THEN '## Data structures' || chr(10) || chr(10) || '`WS-AREA` holds the fields. See lines ' || CAST(o_orderkey % 60 AS STRING) || '-' || CAST(o_orderkey % 60 + 3 AS STRING) || ' and line ' || CAST(o_orderkey % 97 AS STRING) || '.' || chr(10) || chr(10) ELSE '' END",
        "'Paragraph STEP-' || CAST(o_orderkey % 9 AS STRING) || ' calls SUBP' || CAST(o_orderkey % 7 AS STRING) || ' and multiplies by ' || CAST(o_orderkey % 11 AS STRING) || '.' || chr(10)",
    ])


BASIC_STATEMENTS = (
    "'  TOTAL = QTY * PRICE'", "'  IF QTY > 10 THEN CALL BIGORD'", "'  CALL SUBR' || CAST(k AS STRING)", "'  EXECUTE \"LIST ORDERS\"'", "'  OPEN FILE TO F'", "'  BEGIN CASE'", "'  ON ERROR GOTO STEP1'", "'  X = A + B; Y = 2'",
)


def _basic(each) -> str:
    kind = f"((o_orderkey + k) % {len(BASIC_STATEMENTS)})"
    statement = f"CASE {kind} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(BASIC_STATEMENTS)) + " END"
    parts = [f"'* totals of ' || {_NUMBER}", "'DIM TOTALS(10,2)'", "'DIM totals(5)'", "'MAIN:'", each("'  GOSUB STEP' || CAST(k AS STRING)"), "'  RETURN'", each(f"'STEP' || CAST(k AS STRING) || ':' || chr(10) || {statement} || chr(10) || '  RETURN'")]
    return " || chr(10) || ".join(parts)


def _spark_each(line: str) -> str:
    return f"array_join(transform(sequence(1, cast({STEPS} AS int)), k -> {line}), chr(10))"


def _duck_each(line: str) -> str:
    return f"array_to_string(list_transform(range(1, {STEPS} + 1), lambda k: {line}), chr(10))"


#: Common table expressions: ``p`` has a program and its number of steps ``n``, ``s`` a row for each step ``k`` with its kind.
STEPS_SQL = f"p AS (SELECT o_orderkey AS program, {STEPS} AS n FROM orders), s AS (SELECT program, n, k, (program + k) % {len(STATEMENTS)} AS kind FROM (SELECT program, n, unnest(range(1, n + 1)) AS k FROM p))"
TEXTS_SQL = f"t AS (SELECT o_orderkey AS program, {STEPS} AS n, {_source(_duck_each)} AS source, {_document(_duck_each)} AS document FROM orders)"


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``program, n, source, document`` for every order."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return orders.selectExpr("o_orderkey AS program", f"{STEPS} AS n", f"{_source(_spark_each)} AS source", f"{_document(_spark_each)} AS document")


#: Like STEPS_SQL, with the statement kinds of the second language.
BASIC_SQL = f"p AS (SELECT o_orderkey AS program, {STEPS} AS n FROM orders), s AS (SELECT program, n, k, (program + k) % {len(BASIC_STATEMENTS)} AS kind, 6 + n + 3 * (k - 1) AS label FROM (SELECT program, n, unnest(range(1, n + 1)) AS k FROM p))"


def basic_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``program, n, source`` in the second language for every order."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return orders.selectExpr("o_orderkey AS program", f"{STEPS} AS n", f"{_basic(_spark_each)} AS source")

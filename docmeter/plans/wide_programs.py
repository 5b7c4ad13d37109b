"""A second form of programs made of the rows of ``orders``: long and nested EVALUATEs, negated tests, ranges of paragraphs,
forward jumps, condition names, mixed paragraphs, several calls in a statement, and reports with excerpts of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmeter.plans.spread import dealt

#: Statement of part ``k`` by kind; one stands on lines of its own.
STATEMENTS = (
    "'IF NOT WS-OUT = 5 MOVE 1 TO WS-OUT'",
    "'IF WS-OUT NOT = 5 DISPLAY ''ODD'''",
    "'EXEC SQL SELECT BAL, RATE INTO :WS-BAL FROM ACCTS WHERE ID = :WS-ID END-EXEC'",
    "'COMPUTE WS-OUT = WS-BAL * ' || CAST(k AS STRING)",
    "'EXEC CICS SEND MAP(''MENU1'') MAPSET(''MSET1'') END-EXEC'",
    "'CALL ''SUB' || CAST(k AS STRING) || ''' USING WS-AREA CALL ''LAST'''",
    "'PERFORM PART-1'",
    "'IF WS-OUT > ' || CAST(k AS STRING) || ' COMPUTE WS-BAL = WS-OUT + 1' || chr(10) || '           EXEC SQL DELETE FROM ACCTS WHERE ID = :WS-ID END-EXEC' || chr(10) || '           MULTIPLY WS-OUT BY WS-BAL'",
    "'EXEC SQL UPDATE ACCTS SET RATE = 2 WHERE ID = :WS-ID END-EXEC'",
    "'CALL WS-PGM USING WS-OUT'",
)
PARTS, THROUGH, CASES = "(3 + o_orderkey % 4)", "(1 + o_orderkey % 3)", "(4 + o_orderkey % 25)"
_NUMBER = "CAST(o_orderkey AS STRING)"
_STATEMENT = f"CASE ((o_orderkey + k) % {len(STATEMENTS)}) " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(STATEMENTS)) + " END"
_HEAD = (
    "'       IDENTIFICATION DIVISION.'", f"'       PROGRAM-ID. WIDE-' || {_NUMBER} || '.'", "'       DATA DIVISION.'", "'       WORKING-STORAGE SECTION.'", "'       01  WS-AREA.'", "'           05  WS-CODE PIC 99.'",
    "'               88  CODE-OK VALUE 1.'", "'           05  WS-OUT PIC 9(4).'", "'       PROCEDURE DIVISION.'", "'       MAIN-PARA.'", f"'           PERFORM PART-1 THROUGH PART-' || CAST({THROUGH} AS STRING) || '.'",
    f"CASE WHEN o_orderkey % 3 = 0 THEN '           GO TO PART-' || CAST({PARTS} AS STRING) || '.' ELSE '           GO TO MAIN-PARA.' END", "'           STOP RUN.'",
)
_PART = f"'       PART-' || CAST(k AS STRING) || '.' || chr(10) || '           ' || {_STATEMENT} || '.'"
_CASE = "'             WHEN ' || CAST(k AS STRING) || ' MOVE ' || CAST(k AS STRING) || ' TO WS-OUT'"
_NESTED = "'             WHEN 98 EVALUATE WS-SUB WHEN 1 PERFORM PART-1 WHEN OTHER GOBACK END-EVALUATE' || chr(10)"
_TAIL = (
    "'       TAIL-PARA.'", "'           EVALUATE WS-CODE'", None, f"CASE WHEN o_orderkey % 3 = 2 THEN {_NESTED} ELSE '' END || '             WHEN OTHER DISPLAY ''UNKNOWN CODE'' STOP RUN' || CASE WHEN o_orderkey % 3 = 1 THEN '.' ELSE chr(10) || '           END-EVALUATE.' END",
    "'       LAST-PARA.'", "'           EXIT.'",
)
#: Excerpts by ``o_orderkey % 4``: as in the source, with a wrong letter, lines in another order, made up.
EXCERPTS = (
    "'01 ws-area.' || chr(10) || '  05 ws-code  pic 99.'",
    "'01  WS-AREA.' || chr(10) || '    05  WS-CODX PIC 99.'",
    "'PROCEDURE DIVISION.' || chr(10) || '05  WS-OUT PIC 9(4).' || chr(10) || '01  WS-AREA.' || chr(10) || 'WORKING-STORAGE SECTIONS.'",
    "'READ NOTHING-LIKE-IT INTO ELSEWHERE' || chr(10) || 'AT END QUIT'",
)
WAYS = ("exact", "window", "lines", None)
_EXCERPT = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(EXCERPTS)) + " END"
DOCUMENT = " || ".join([
    "'# Program' || chr(10) || chr(10)",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'The ACCTS table holds balances where the key matches. ' ELSE '' END",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'The screen shows input fields; each response is checked. ' ELSE '' END",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'Program LAST gets WS-AREA as a parameter. ' ELSE '' END",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'It computes and multiplies the outcome if needed; BAL and RATE are read. ' ELSE '' END",
    "chr(10) || '```cobol' || chr(10)", _EXCERPT, "chr(10) || '```' || chr(10)",
])


def _source(each) -> str:
    parts = [*_HEAD, each(_PART, PARTS), *(each(_CASE, CASES) if x is None else x for x in _TAIL)]
    return " || chr(10) || ".join(parts)


def _spark_each(line: str, n: str) -> str:
    return f"array_join(transform(sequence(1, cast({n} AS int)), k -> {line}), chr(10))"


def _duck_each(line: str, n: str) -> str:
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda k: {line}), chr(10))"


#: ``p`` has a program, its parts ``n``, its range's end ``m`` and its cases; ``s`` a row for each part ``k`` with its kind.
STEPS_SQL = f"p AS (SELECT o_orderkey AS program, {PARTS} AS n, {THROUGH} AS m, {CASES} AS cases FROM orders), s AS (SELECT *, (program + k) % {len(STATEMENTS)} AS kind FROM (SELECT program, n, m, unnest(range(1, n + 1)) AS k FROM p))"
TEXTS_SQL = f"t AS (SELECT o_orderkey AS program, {PARTS} AS n, {_source(_duck_each)} AS source, {DOCUMENT} AS document FROM orders)"


def wide_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``program, n, source, document`` for every order."""
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return orders.selectExpr("o_orderkey AS program", f"{PARTS} AS n", f"{_source(_spark_each)} AS source", f"{DOCUMENT} AS document")

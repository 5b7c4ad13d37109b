"""Queries over programs of the second language made of orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmeter.operators import second_language as b
from docmeter.plans.programs import BASIC_SQL, basic_programs
from docmeter.registry import query

_S = f"WITH {BASIC_SQL}"


@query("b16_subroutines", f"{_S} SELECT program, 'MAIN' AS name, 4 AS start_line, 5 + n AS end_line, n + 1 AS statements, 'PURE' AS class FROM p UNION ALL SELECT program, 'STEP' || k, label, label + 2, CASE kind WHEN 7 THEN 3 ELSE 2 END, CASE WHEN kind IN (1, 2, 3) THEN 'MIXED' WHEN kind = 4 THEN 'INFRASTRUCTURE' ELSE 'PURE' END FROM s")
def b16(spark, sf_dir):
    return b.subroutines(basic_programs(spark, sf_dir)).select("program", "name", "start_line", "end_line", F.size("statements").alias("statements"), "class")


@query("b17_arrays", f"{_S} SELECT program, 'TOTALS' AS name, '10,2' AS dimensions, 2 AS line_no FROM p")
def b17(spark, sf_dir):
    return b.arrays(basic_programs(spark, sf_dir))


@query("b18_calls", f"{_S} SELECT program, CASE kind WHEN 2 THEN 'CALL' ELSE 'EXECUTE' END AS type, CASE kind WHEN 2 THEN 'SUBR' || k ELSE 'LIST' END AS target, label + 1 AS line_no FROM s WHERE kind IN (2, 3)")
def b18(spark, sf_dir):
    return b.external_calls(basic_programs(spark, sf_dir))


@query("b20_gosubs_and_handlers", f"{_S} SELECT program, n AS gosubs, 'STEP1' AS first, (SELECT count(*) FROM s WHERE s.program = p.program AND kind = 6) AS handlers FROM p")
def b20(spark, sf_dir):
    rows = basic_programs(spark, sf_dir)
    handlers = b.error_handlers(rows).filter("type = 'ON_ERROR_GOTO' and target = 'STEP1'").groupBy("program").agg(F.count("*").alias("handlers"))
    targets = b.gosub_targets("source")
    return rows.select("program", F.size(targets).alias("gosubs"), F.get(targets, F.lit(0)).alias("first")).join(handlers, "program", "left").fillna(0, ["handlers"])


@query("c30_second_language_rules", f"{_S}, r AS (SELECT program, label + 1 AS line_no, 'STEP' || k AS paragraph, CASE kind WHEN 0 THEN 'calculation' WHEN 1 THEN 'condition' ELSE 'case' END AS rule_type, CASE kind WHEN 0 THEN 'CRITICAL' ELSE 'IMPORTANT' END AS priority, CASE kind WHEN 0 THEN 'TOTAL,QTY,PRICE' WHEN 1 THEN 'QTY,CALL,BIGORD' ELSE 'case,switch,conditional' END AS keywords FROM s WHERE kind IN (0, 1, 5)) SELECT *, printf('BR-%03d', row_number() OVER (PARTITION BY program ORDER BY line_no)) AS rule_id FROM r")
def c30(spark, sf_dir):
    return b.business_rules(basic_programs(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", ","))

"""Queries on selection, tasks, boards and sinks over rows that the given tables yield, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmeter.operators import board, ranges, selection, tasks
from docmeter.plans.programs import TEXTS_SQL, programs
from docmeter.registry import fixed, query, sql_fixed, table
from docmeter.sources import results as rs
from docmeter.sources.folders import fresh_folder

_T = f"WITH {TEXTS_SQL}"
_PARTS = "c AS (SELECT p_partkey, p_name, p_brand AS dataset, p_size * 100 AS loc, p_partkey % 5 AS rules, CASE WHEN p_partkey % 3 = 0 THEN 'unibasic' ELSE 'cobol' END AS language, p_retailprice AS price FROM part)"


def _files(spark, sf_dir):
    language = F.when(F.col("p_partkey") % 3 == 0, "unibasic").otherwise("cobol")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("dataset"), (F.col("p_size") * 100).alias("loc"), (F.col("p_partkey") % 5).alias("rules"), language.alias("language"), F.col("p_retailprice").alias("price"))


@query("c31_containing_order", "WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 60 DAY AS hi FROM orders) SELECT a.o_orderkey, min(b.o_orderkey) AS first_open, count(*) AS n_open FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.lo BETWEEN b.lo AND b.hi GROUP BY a.o_orderkey")
def c31(spark, sf_dir):
    day = F.unix_date(F.to_date("o_orderdate"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("at"))
    open_ = orders.select("o_custkey", F.col("o_orderkey").alias("open"), F.col("at").alias("lo"), (F.col("at") + 60).alias("hi"))
    found = ranges.containing_ranges(orders, open_, ["o_custkey"], "at", "lo", "hi", 60)
    return found.groupBy("o_orderkey").agg(F.min("open").alias("first_open"), F.count("*").alias("n_open"))


@query("a10_dataset_stats", f"WITH {_PARTS} SELECT dataset, count(*) FILTER (WHERE language = 'cobol') AS programs, count(*) FILTER (WHERE language <> 'cobol') AS copybooks, sum(loc)::BIGINT AS loc, (sum(loc) FILTER (WHERE language = 'cobol') // greatest(count(*) FILTER (WHERE language = 'cobol'), 1))::BIGINT AS mean_loc FROM c GROUP BY dataset")
def a10(spark, sf_dir):
    return tasks.dataset_stats(_files(spark, sf_dir).withColumn("is_copybook", F.col("language") != "cobol"))


@query("k13_candidates", f"WITH {_PARTS} SELECT p_partkey, CASE WHEN language = 'unibasic' THEN 5e0 ELSE {sql_fixed('least(10e0, rules * 1.5e0 + loc / 1000e0)')} END AS score FROM c WHERE loc BETWEEN 300 AND 3000 AND (rules >= 1 OR language = 'unibasic')")
def k13(spark, sf_dir):
    score = fixed(F.least(F.lit(10.0), F.col("rules") * 1.5 + F.col("loc") / 1000.0))
    return tasks.candidates(_files(spark, sf_dir), score).select("p_partkey", "score")


@query("m14_tasks", f"WITH {_PARTS}, t AS (SELECT *, 'T' || (1 + p_partkey % 4) AS tier FROM c) SELECT p_partkey, CASE language WHEN 'unibasic' THEN 'LCB-UB-' ELSE 'LCB-' END || tier || '-' || printf('%03d', row_number() OVER (PARTITION BY language, tier ORDER BY p_partkey)) AS task_id, CASE WHEN tier = 'T1' THEN 'easy' WHEN tier IN ('T2', 'T3') THEN 'medium' ELSE 'hard' END AS difficulty, language, tier FROM t WHERE p_partkey <> 7")
def m14(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumns({"tier": F.concat(F.lit("T"), (1 + F.col("p_partkey") % 4).cast("string")), "path": F.col("p_partkey").cast("string")})
    frozen = rows.filter("p_partkey = 7").select("path")
    made = tasks.made_tasks(tasks.not_frozen(rows, frozen, "path"), "p_partkey")
    return made.select("p_partkey", "task_id", "difficulty", F.lower(board.language_of(F.col("task_id"))).alias("language"), board.tier_of(F.col("task_id")).alias("tier"))


@query("m6_dataset_domains", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brushed') THEN 'finish' ELSE 'general' END AS domain, CASE WHEN p_partkey % 2 = 0 THEN 'cobol' ELSE 'unibasic' END AS language, 'data/' || lower(p_brand) || '/src/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.cbl' ELSE '.bp' END AS path FROM part")
def m6(spark, sf_dir):
    name = F.concat(F.lit("src\\"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".cbl").otherwise(".bp"))
    path = tasks.input_path(F.lit("data"), F.lower("p_brand"), name)
    domain = tasks.name_domain("p_type", {"metal": ("steel", "iron", "lead", "brass"), "finish": ("brushed",)})
    return table(spark, sf_dir, "part").select("p_partkey", domain.alias("domain"), tasks.language_of_path(path).alias("language"), path.alias("path"))


@query("m5_difficulty", f"WITH {_PARTS} SELECT p_partkey, {sql_fixed('rules * 20')} AS score, CASE WHEN rules * 20 < 30 THEN 'easy' WHEN rules * 20 < 60 THEN 'medium' ELSE 'hard' END AS level, CASE WHEN rules * 20 < 30 THEN 'easy' WHEN rules * 20 < 60 THEN 'medium' ELSE 'hard' END || ' (' || printf('%.1f', rules * 20.0) || '): ' || loc || ' lines, complexity 3, ' || rules || ' rules' AS text FROM c")
def m5(spark, sf_dir):
    score = (F.col("rules") * 20).cast("double")
    found = tasks.explained(score, F.col("loc"), F.lit(3), F.col("rules"))
    return _files(spark, sf_dir).select("p_partkey", fixed(score).alias("score"), found["level"].alias("level"), found["text"].alias("text"))


@query("k15_representative", f"WITH {_PARTS}, r AS (SELECT p_partkey, 'T' || (1 + p_partkey % 4) AS tier FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY p_partkey) AS nth FROM r), o AS (SELECT *, row_number() OVER (ORDER BY (nth > 1)::INT, tier, nth) AS place FROM n) SELECT p_partkey, tier FROM o WHERE place > 2 AND place <= 12")
def k15(spark, sf_dir):
    rows = _files(spark, sf_dir).select("p_partkey", F.concat(F.lit("T"), (1 + F.col("p_partkey") % 4).cast("string")).alias("tier"))
    return selection.representative(rows, 10, key="p_partkey", offset=2).select("p_partkey", "tier")


_R = "r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'model-' || (l_suppkey % 7) AS model, CASE WHEN l_linenumber % 2 = 0 THEN 'documentation' ELSE 'understanding' END AS category, l_discount * 1e1 AS score, l_tax * 12.5 AS overall, ['executed', 'static', 'error'][1 + l_partkey % 3] AS mode, CASE WHEN l_partkey % 2 = 0 THEN 'cobol' ELSE 'unibasic' END AS language, CASE l_suppkey % 4 WHEN 0 THEN 'copybook A not found' WHEN 1 THEN 'Syntax Error near X' WHEN 2 THEN 'bad USING clause here' ELSE 'a very long first line that runs beyond forty characters' || chr(10) || 'second' END AS error FROM lineitem)"


def _rows(spark, sf_dir):
    error = F.when(F.col("l_suppkey") % 4 == 0, "copybook A not found").when(F.col("l_suppkey") % 4 == 1, "Syntax Error near X").when(F.col("l_suppkey") % 4 == 2, "bad USING clause here").otherwise("a very long first line that runs beyond forty characters\nsecond")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit("model-"), (F.col("l_suppkey") % 7).cast("string")).alias("model"), F.when(F.col("l_linenumber") % 2 == 0, "documentation").otherwise("understanding").alias("category"),
        F.expr("l_discount * 1e1").alias("score"), F.expr("l_tax * 12.5e0").alias("overall"), F.get(F.array(F.lit("executed"), F.lit("static"), F.lit("error")), F.col("l_partkey") % 3).alias("mode"), F.when(F.col("l_partkey") % 2 == 0, "cobol").otherwise("unibasic").alias("language"), error.alias("error"),
    )


_DOCUMENTATION = "coalesce(avg(score) FILTER (WHERE category = 'documentation'), 0e0)"


@query("j7_category_means", f"WITH {_R} SELECT model, {sql_fixed(_DOCUMENTATION)} AS documentation_avg, count(*) FILTER (WHERE category = 'documentation') AS documentation_tasks, count(*) FILTER (WHERE category = 'understanding') AS understanding_tasks, {sql_fixed('avg(overall)')} AS overall_avg FROM r GROUP BY model".replace("chr(100) || chr(111) || chr(99) || chr(117) || chr(109) || chr(101) || chr(110) || chr(116) || chr(97) || chr(116) || chr(105) || chr(111) || chr(110)", "'documentation'"))
def j7(spark, sf_dir):
    out = tasks.category_means(_rows(spark, sf_dir), ["model"])
    return out.select("model", fixed(F.col("documentation_avg")).alias("documentation_avg"), "documentation_tasks", "understanding_tasks", fixed(F.col("overall_avg")).alias("overall_avg"))


@query("j11_mode_board", f"WITH {_R} SELECT model, count(*) AS tasks, count(*) FILTER (WHERE mode = 'executed') AS executed, count(*) FILTER (WHERE mode = 'static') AS static, {sql_fixed('avg(overall)')} AS avg_lcb, 'cobol,unibasic' AS languages FROM r GROUP BY model")
def j11(spark, sf_dir):
    return tasks.mode_board(_rows(spark, sf_dir).withColumn("lcb", F.col("overall"))).withColumn("avg_lcb", fixed(F.col("avg_lcb")))


@query("j13_language_board", f"WITH {_R}, b AS (SELECT model, count(*) AS tasks, avg(overall) AS mean FROM r WHERE language = 'cobol' GROUP BY model) SELECT model, tasks, {sql_fixed('mean')} AS avg_lcb, row_number() OVER (ORDER BY mean DESC, model)::INT AS rank FROM b")
def j13(spark, sf_dir):
    rows = tasks.of_language(_rows(spark, sf_dir).withColumn("lcb", F.col("overall")), "COBOL")
    found = board.ranked(rows.groupBy("model").agg(F.count("*").alias("tasks"), F.avg("lcb").alias("avg_lcb")), "avg_lcb")
    return found.withColumn("avg_lcb", fixed(F.col("avg_lcb")))


@query("g48_compile_errors", f"WITH {_R} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN 'Missing Copybook/File' WHEN 1 THEN 'Syntax Error' WHEN 2 THEN 'Procedure Using Clause' ELSE 'a very long first line that runs beyond ..' END AS reason, CASE WHEN l_suppkey % 4 = 0 THEN 'copybook_missing' ELSE 'other' END AS kind FROM r")
def g48(spark, sf_dir):
    return _rows(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", tasks.short_reason("error").alias("reason"), tasks.compile_error("error").alias("kind"))


@query("j15_summary_lines", f"{_T} SELECT program, 'PROGRAM ' || program || ': ' || (n + 1) || ' paragraphs, ' || len(string_split(source, chr(10))) || ' lines' AS line FROM t")
def j15(spark, sf_dir):
    return programs(spark, sf_dir).select("program", F.format_string("PROGRAM %d: %d paragraphs, %d lines", "program", (F.col("n") + 1), F.size(F.split("source", "\n"))).alias("line"))


@query("a15_results_written_and_read", "SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS task_id, 'model-' || (l_suppkey % 7) AS model, '2.3.1' AS version, floor(l_discount * 1e1 * 1e6 + 0.5) / 1e6 AS sc, floor(l_tax * 12.5e0 * 1e6 + 0.5) / 1e6 AS bf, CASE WHEN l_suppkey % 5 = 0 THEN 'CF-01' ELSE '' END AS failures FROM lineitem")
def a15(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("task_id"), F.concat(F.lit("model-"), (F.col("l_suppkey") % 7).cast("string")).alias("model"), F.expr("l_discount * 1e1").alias("sc"), F.expr("l_quantity / 5e1").alias("dq"), F.expr("l_tax * 12.5e0").alias("bf"),
        F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("CF-01: missing"))).otherwise(F.array().cast("array<string>")).alias("failures"),
    )
    folder = fresh_folder(spark, "results")
    rs.write_results(rows, folder)
    found = rs.normalised_results(rs.read_result_lines(spark, folder))
    return found.select("task_id", "model", "version", fixed(F.col("sc")).alias("sc"), fixed(F.col("bf")).alias("bf"), F.array_join("failures", ",").alias("failures"))


@query("a13_cache_misses", f"{_T} SELECT program FROM t WHERE program % 3 <> 0 OR program % 6 = 3")
def a13(spark, sf_dir):
    rows = programs(spark, sf_dir)
    changed = F.when(F.col("program") % 6 == 3, F.concat("source", F.lit(" "))).otherwise(F.col("source"))
    cache = rows.filter("program % 3 = 0").select("program", F.sha2(changed, 256).alias("source_hash"))
    return rs.cache_misses(rows, cache).select("program")


@query("a21_unwrapped_documents", f"{_T} SELECT program, CASE program % 3 WHEN 0 THEN md5('{{\"a\": 1}} and ' || document) WHEN 1 THEN md5(document) ELSE md5(document || chr(10) || chr(10) || document) END AS digest FROM t")
def a21(spark, sf_dir):
    rows = programs(spark, sf_dir)
    wrapped = lambda n: F.concat(*[F.concat(F.lit("text {x"), F.lit("} "), F.to_json(F.struct(F.lit("n").alias("name"), F.col("document").alias("content")))) for _ in range(n)])
    text = F.when(F.col("program") % 3 == 0, F.concat(F.lit('{"a": 1} and '), "document")).when(F.col("program") % 3 == 1, wrapped(1)).otherwise(wrapped(2))
    return rows.select("program", F.md5(rs.json_contents(text).cast("binary")).alias("digest"))

"""Queries over the given tables, by name, and the SQL that gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmeter.functions import text as t
from docmeter.lexicons import CORPUS, WEIGHTS
from docmeter.operators import board, claims, compare, scoring, selection, similarity
from docmeter.plans.documents import document_board, scored_documents
from docmeter.document_sql import WHITE_SPACE, scored_sql
from docmeter.registry import ORACLE_SQL, QUERIES, fixed, query, table
from docmeter.sources.folders import fresh_folder
from docmeter.sources.results import merged_digests, write_detailed_board
from docmeter.streaming.board import windowed_means

_WS = WHITE_SPACE


# Documents


_DOCUMENTS = "SELECT doc_id, source, n_chars, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_\\x20\\x09-\\x0D.]', ' ', 'g') AS plain, len(string_split(text, chr(10))) AS n_lines FROM documents"
_SCORED = scored_sql(CORPUS, _DOCUMENTS)


@query("d1_document_quality", f"WITH {_SCORED} SELECT doc_id, " + ", ".join(f"floor({c}::DOUBLE * 1e6 + 0.5) / 1e6 AS {c}" for c in ("structure", "traceability", "readability", "abstraction", "dq")) + " FROM scored")
def d1(spark, sf_dir):
    scored = scored_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *[fixed(F.col(c)).alias(c) for c in ("structure", "traceability", "readability", "abstraction", "dq")])


@query("d3_line_citations", f"WITH {_SCORED} SELECT doc_id, citations, valid FROM scored")
def d3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", t.line_citations("text", F.size(F.split("text", "\n"))).alias("c")).select("doc_id", F.col("c.citations").cast("long").alias("citations"), F.col("c.valid").cast("long").alias("valid"))


@query("d4_readability", f"WITH {_SCORED} SELECT doc_id, words, sentences, syllables::BIGINT AS syllables, floor(grade::DOUBLE * 1e6 + 0.5) / 1e6 AS grade FROM scored")
def d4(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", t.readability("text", unicode=False).alias("r"))
    return rows.select("doc_id", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("words", "sentences", "syllables")], fixed(F.col("r.grade")).alias("grade"))


@query("d6_abstraction_terms", f"WITH {_SCORED} SELECT doc_id, why, what, {' + '.join(f'contains(low, {x!r})::INT' for x in CORPUS.why)} AS why_present FROM scored")
def d6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", t.term_counts("text", CORPUS.why).cast("long").alias("why"), t.term_counts("text", CORPUS.what).cast("long").alias("what"), t.terms_present("text", CORPUS.why).alias("why_present"))


@query(
    "q0_document_board",
    f"""WITH {_SCORED}, x AS (SELECT doc_id, max(toxic) = 1 AS failed FROM labels GROUP BY doc_id),
    r AS (SELECT source, dq, coalesce(failed, false) AS failed, 1 + (n_chars >= 1000)::INT + (n_chars >= 2000)::INT + (n_chars >= 4000)::INT AS tier FROM scored LEFT JOIN x USING (doc_id)),
    b AS (SELECT source, count(*) AS documents, round(avg(dq)::DOUBLE, 6) AS avg_dq, count(*) FILTER (WHERE failed) AS failures, round(avg((NOT failed AND dq >= 0.5)::INT)::DOUBLE, 6) AS pass_share,
    {", ".join(f"round(coalesce(avg(dq) FILTER (WHERE tier = {k}), 0)::DOUBLE, 6) AS avg_t{k}" for k in (1, 2, 3, 4))} FROM r GROUP BY source)
    SELECT *, row_number() OVER (ORDER BY avg_dq DESC, source)::INT AS rank FROM b""",
)
def q0(spark, sf_dir):
    return document_board(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "d24_keyword_stuffing",
    rf"""WITH d AS (SELECT doc_id, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '[.!?]+'), lambda s: len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 5) AS s FROM documents),
    k AS (SELECT doc_id, {" + ".join(f"contains(low, '{x}')::INT" for x in ("the", "tion", "der", "las", "que"))} AS present, {" + ".join(f"(len(list_filter(s, lambda y: contains(y, '{x}'))) > 0)::INT" for x in ("the", "tion", "der", "las", "que"))} AS shown FROM d)
    SELECT doc_id, round(CASE WHEN present = 0 THEN 0.0 ELSE 1 - shown / present END::DOUBLE, 6) AS stuffing FROM k""",
)
def d24(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(t.stuffing_score("text", ("the", "tion", "der", "las", "que")), 6).alias("stuffing"))


_GRAMS = lambda table, key: rf"""SELECT DISTINCT {key}, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM {table}))"""


@query(
    "d28_passages_found",
    f"WITH d AS ({_GRAMS('documents', 'doc_id')}), b AS ({_GRAMS('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id) SELECT doc_id, item_id, count(*) AS shared, round((count(*) / n)::DOUBLE, 6) AS share FROM d JOIN b USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id, n",
)
def d28(spark, sf_dir):
    return similarity.passages_found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "e3_token_containment",
    r"""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda w: length(w) > 2)) AS w FROM documents)
    SELECT a.doc_id, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(a.w), 0), 0)::DOUBLE, 6) AS contained FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""",
)
def e3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", t.token_set("text").alias("w"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(other, "doc_id").select("doc_id", F.round(t.containment(F.col("w"), F.col("v")), 6).alias("contained"))


@query(
    "f2_bigram_jaccard",
    """WITH p AS (SELECT p_partkey, upper(p_name) AS u, list_distinct(list_transform(range(1, greatest(1, length(p_name)) ), lambda i: substr(upper(p_name), i, 2))) AS g FROM part)
    SELECT a.p_partkey, round(CASE WHEN a.u = b.u THEN 1.0 ELSE coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0) END::DOUBLE, 6) AS similarity FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""",
)
def f2(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select("p_partkey", F.round(t.bigram_jaccard("p_name", "other"), 6).alias("similarity"))


@query("f1_identifiers", rf"""WITH i AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '\b([A-Za-z][-A-Za-z0-9]*)\b', 1), lambda w: length(w) > 2 AND NOT list_contains([{', '.join(map(repr, claims.COMMON_WORDS))}], lower(w))), lambda w: upper(w))) AS w FROM documents) SELECT doc_id, len(w) AS n, coalesce(list_min(w), '') AS first_name, coalesce(list_max(w), '') AS last_name FROM i""")
def f1(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", claims.identifiers("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.coalesce(F.array_min("w"), F.lit("")).alias("first_name"), F.coalesce(F.array_max("w"), F.lit("")).alias("last_name"))


@query(
    "l2_bigram_precision",
    r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark), g AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS g, count(*) AS n FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL),
    p AS (SELECT a.item_id, sum(least(a.n, coalesce(b.n, 0))) AS hits, sum(a.n) AS n FROM g a LEFT JOIN g b ON b.item_id = a.item_id + 1 AND b.g = a.g GROUP BY a.item_id)
    SELECT item_id, hits::BIGINT AS hits, n::BIGINT AS n FROM p WHERE item_id + 1 IN (SELECT item_id FROM benchmark)""",
)
def l2(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", similarity.ngrams(t.words(F.lower("text")), 2).alias("g"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("g").alias("r"))
    return items.join(other, "item_id").select("item_id", similarity.clipped_matches(F.col("g"), F.col("r")).cast("long").alias("hits"), F.size("g").cast("long").alias("n"))


@query(
    "l4_tf_idf_best",
    r"""WITH b AS (SELECT 's' AS side, item_id AS key, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'r', item_id, text FROM benchmark WHERE item_id % 2 = 1), n AS (SELECT count(*) AS n FROM b),
    tf AS (SELECT side, key, term, count(*) AS tf FROM (SELECT side, key, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS term FROM b) GROUP BY ALL), idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
    w AS (SELECT side, key, term, tf * idf AS w FROM tf JOIN idf USING (term)), nn AS (SELECT side, key, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    u AS (SELECT side, key, term, w / norm AS w FROM w JOIN nn USING (side, key)), p AS (SELECT s.key AS s, r.key AS r, sum(s.w * r.w) AS c FROM u s JOIN u r ON s.term = r.term AND s.side = 's' AND r.side = 'r' GROUP BY ALL)
    SELECT s AS item_id, round(max(c), 6) AS best FROM p GROUP BY s""",
)
def l4(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return similarity.tf_idf_best(items.filter("item_id % 2 = 0"), items.filter("item_id % 2 = 1"), "item_id", "text")


# Results: orders as tasks, market segments as models


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    rows = orders.select(
        key.alias("task_id"), F.col("c_mktsegment").alias("model"), F.col("n_name").alias("submitter"), F.concat(F.lit("T"), (key % 4 + 1).cast("string")).alias("tier"),
        F.when(key % 10 == 0, "UniBasic").otherwise("COBOL").alias("language"), ((F.col("o_custkey") % 101) / 100).alias("sc"), ((key * 7 % 97) / 96).alias("dq"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 300000).alias("bf"), F.when(status == "P", F.array(F.lit("CF-03: contradiction"))).when(status == "F", F.array(F.lit("CF-05"), F.lit("CF-04"))).otherwise(F.array().cast("array<string>")).alias("failures"),
        F.col("o_orderpriority").alias("priority"),
    )
    verdict = scoring.verdict(F.col("sc"), F.col("dq"), F.col("bf"), F.col("failures"))
    return rows.withColumn("v", verdict).select("*", (F.col("v.lcb") / 100).alias("lcb"), F.col("v.passed").alias("passed"), F.col("v.reason").alias("reason")).drop("v")


_RESULTS = f"""
base AS (
  SELECT o_orderkey AS task_id, c_mktsegment AS model, n_name AS submitter, 'T' || (o_orderkey % 4 + 1) AS tier, CASE WHEN o_orderkey % 10 = 0 THEN 'UniBasic' ELSE 'COBOL' END AS language, (o_custkey % 101) / 100 AS sc, (o_orderkey * 7 % 97) / 96 AS dq,
    least(1.0::DOUBLE, o_totalprice / 300000) AS bf, CASE o_orderstatus WHEN 'P' THEN ['CF-03: contradiction'] WHEN 'F' THEN ['CF-05', 'CF-04'] ELSE []::VARCHAR[] END AS failures, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), results AS (
  SELECT *, CASE WHEN len(failures) > 0 THEN 0.0 ELSE ({" + ".join(f"{k} * {w}::DOUBLE" for k, w in WEIGHTS.items())}) * 100 / 100 END AS lcb, len(failures) = 0 AND sc >= 0.6 AND dq >= 0.5 AND bf >= 0.55 AS passed FROM base
)
"""


@query("i12_verdict", f"WITH {_RESULTS} SELECT task_id, round(lcb::DOUBLE, 6) AS lcb, passed, CASE WHEN len(failures) > 0 THEN 'Critical failure: ' || failures[1] WHEN passed THEN 'met' ELSE array_to_string(list_filter([CASE WHEN sc < 0.6 THEN 'SC' END, CASE WHEN dq < 0.5 THEN 'DQ' END, CASE WHEN bf < 0.55 THEN 'BF' END], lambda x: x IS NOT NULL), ',') END AS why FROM results")
def i12(spark, sf_dir):
    why = F.when(F.size("failures") > 0, F.col("reason")).when(F.col("passed"), "met").otherwise(F.array_join(F.regexp_extract_all("reason", F.lit(r"([A-Z]{2}) \("), 1), ","))
    return results(spark, sf_dir).select("task_id", F.round("lcb", 6).alias("lcb"), "passed", why.alias("why"))


@query("i17_performance_tiers", f"WITH {_RESULTS} SELECT model, CASE WHEN lcb >= 0.6 THEN 'excellent' WHEN lcb >= 0.4 THEN 'good' WHEN lcb >= 0.2 THEN 'fair' ELSE 'poor' END AS performance, count(*) AS n, count(*) FILTER (WHERE bf >= 0.6 AND CASE WHEN sc >= 0.6 AND dq >= 0.5 THEN 0.4 * sc + 0.4 * dq ELSE 0 END >= 0.55) AS balanced FROM results GROUP BY ALL")
def i17(spark, sf_dir):
    quality = scoring.quality_score(F.col("sc"), F.col("dq"), F.lit(0.0))
    rows = results(spark, sf_dir).withColumn("performance", scoring.performance_tier(F.col("lcb")))
    return rows.groupBy("model", "performance").agg(F.count("*").alias("n"), F.count_if(scoring.passes(F.col("bf"), quality, F.lit(False))).alias("balanced"))


@query(
    "j1_leaderboard",
    f"""WITH {_RESULTS}, b AS (SELECT model, count(*) AS tasks_total, {", ".join(f"round(avg({k}), 4) AS avg_{k}" for k in WEIGHTS)}, round({" + ".join(f"avg({k}) * {w}::DOUBLE" for k, w in WEIGHTS.items())}, 4) AS avg_lcb_components, round(avg(lcb), 4) AS avg_lcb_tasks,
    count(*) FILTER (WHERE len(failures) > 0) AS critical_failures, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, {", ".join(f"round(coalesce(avg(lcb) FILTER (WHERE tier = '{x}'), 0), 4) AS avg_{x.lower()}" for x in board.TIERS)} FROM results GROUP BY model)
    SELECT *, row_number() OVER (ORDER BY avg_lcb_components DESC, model)::INT AS rank FROM b""",
)
def j1(spark, sf_dir):
    return board.leaderboard(results(spark, sf_dir))


@query("j3_modal_submitter", f"WITH {_RESULTS}, c AS (SELECT model, submitter, count(*) AS n FROM results GROUP BY ALL) SELECT model, submitter, n FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, submitter) = 1")
def j3(spark, sf_dir):
    return board.modal_submitter(results(spark, sf_dir))


@query("j5_failure_histogram", f"WITH {_RESULTS}, x AS (SELECT model, unnest(failures) AS f FROM results) SELECT model, split_part(f, ':', 1) AS failure, count(*) AS n FROM x GROUP BY ALL")
def j5(spark, sf_dir):
    return board.failure_histogram(results(spark, sf_dir))


_MODES = "CASE task_id % 4 WHEN 0 THEN 'executed' WHEN 1 THEN 'error' ELSE 'static' END"
_REASONS = "CASE task_id % 4 WHEN 2 THEN 'book' WHEN 3 THEN 'disabled' END"
_DETAILED = f"""m AS (SELECT *, {_MODES} AS mode, {_REASONS} AS mode_reason FROM results), b AS (SELECT model, count(*) AS tasks_total, {", ".join(f"round(avg({k}), 4) AS avg_{k}" for k in WEIGHTS)}, round({" + ".join(f"avg({k}) * {w}::DOUBLE" for k, w in WEIGHTS.items())}, 4) AS avg_lcb, count(*) FILTER (WHERE len(failures) > 0) AS critical_failures,
  {", ".join(f"count(*) FILTER (WHERE mode = '{x}') AS {x}" for x in board.MODES)}, count(*) FILTER (WHERE mode_reason = 'book') AS books, count(*) FILTER (WHERE mode_reason = 'disabled') AS disabled, {", ".join(f"round(coalesce(avg(lcb) FILTER (WHERE tier = '{x}'), 0), 4) AS {x.lower()}, count(*) FILTER (WHERE tier = '{x}') AS n_{x.lower()}" for x in board.TIERS)},
  {", ".join(f"count(*) FILTER (WHERE len(list_filter(failures, lambda f: f LIKE '{x}%')) > 0) AS {x.lower().replace('-', '')}" for x in ("CF-03", "CF-04", "CF-05"))} FROM m GROUP BY model),
  o AS (SELECT b.*, row_number() OVER (ORDER BY avg_lcb DESC, b.model)::INT AS rank, s.submitter FROM b JOIN (SELECT model, submitter FROM (SELECT model, submitter, count(*) AS n FROM results GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, submitter) = 1) s USING (model))"""


def _moded(spark, sf_dir):
    part = F.col("task_id") % 4
    return results(spark, sf_dir).withColumns({"mode": F.when(part == 0, "executed").when(part == 1, "error").otherwise("static"), "mode_reason": F.when(part == 2, "book").when(part == 3, "disabled")})


@query("j1_detailed_board", f"WITH {_RESULTS}, {_DETAILED} SELECT model, submitter, rank, tasks_total, avg_lcb, {', '.join(board.MODES)}, 'book:' || books || ',disabled:' || disabled AS reasons, concat_ws(',', CASE WHEN cf03 > 0 THEN 'CF-03:' || cf03 END, CASE WHEN cf04 > 0 THEN 'CF-04:' || cf04 END, CASE WHEN cf05 > 0 THEN 'CF-05:' || cf05 END) AS failures, {', '.join(f'{x.lower()}, n_{x.lower()}' for x in board.TIERS)} FROM o")
def j1_detailed(spark, sf_dir):
    """Written as nested JSON and read back."""
    rows, folder = _moded(spark, sf_dir), fresh_folder(spark, "board")
    made = board.detailed_board(rows)
    write_detailed_board(made, board.detailed_tasks(rows), folder)
    read = spark.read.schema(made.schema).json(f"{folder}/board")
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    tier = lambda t: F.try_element_at("by_tier", F.lit(t))
    tiers = [c for t in board.TIERS for c in (F.coalesce(tier(t)["avg_score"], F.lit(0.0)).alias(t.lower()), F.coalesce(tier(t)["total"], F.lit(0)).alias(f"n_{t.lower()}"))]
    return read.select("model", "submitter", "rank", "tasks_total", F.col("avg_lcb_components").alias("avg_lcb"), *[F.col(f"bf_method.{m}").alias(m) for m in board.MODES], pairs("bf_method.reasons").alias("reasons"), pairs("critical_failure_types").alias("failures"), *tiers)


_TENTHS = lambda x: f"printf('%.1f', round_even(100 * ({x}), 1))"


@query("a17_summary", f"WITH {_RESULTS}, {_DETAILED} SELECT rank::VARCHAR AS rank, submitter || '/' || model AS model, {_TENTHS('avg_lcb')} AS lcb_score, {_TENTHS('avg_sc')} AS sc, {_TENTHS('avg_bf')} AS bf, {_TENTHS('avg_dq')} AS sq, '0.0' AS tr, {_TENTHS('t1')} AS t1_score, {_TENTHS('t4')} AS t4_score, tasks_total::VARCHAR AS total_tasks, critical_failures::VARCHAR AS critical_failures FROM o")
def a17(spark, sf_dir):
    """Written as CSV and read back."""
    rows, folder = _moded(spark, sf_dir), fresh_folder(spark, "board")
    write_detailed_board(board.detailed_board(rows), board.detailed_tasks(rows), folder)
    return spark.read.csv(f"{folder}/summary", header=True)


@query("j16_drill_down", f"WITH {_RESULTS}, {_DETAILED} SELECT model, count(*) AS tasks, {', '.join(f'round(avg({k}), 4) AS avg_{k}' for k in WEIGHTS)}, round({' + '.join(f'avg({k}) * {w}::DOUBLE' for k, w in WEIGHTS.items())}, 4) AS avg_lcb, {', '.join(f'count(*) FILTER (WHERE mode = {x!r}) AS {x}' for x in board.MODES)} FROM m WHERE language = 'COBOL' AND model = 'BUILDING' GROUP BY model")
def j16(spark, sf_dir):
    return board.restated(board.task_details(_moded(spark, sf_dir), "building", "cobol"))


@query("j8_overall", f"WITH {_RESULTS} SELECT {', '.join(f'round(avg({k}), 2) AS {k}_avg' for k in ('sc', 'dq', 'bf', 'lcb'))}, count(*) AS total_tasks, count(*) FILTER (WHERE len(failures) > 0) AS critical_failure_count, round(count(*) FILTER (WHERE len(failures) > 0) / count(*), 3) AS critical_failure_rate FROM results")
def j8(spark, sf_dir):
    return board.overall(results(spark, sf_dir))


@query("j9_by_model", f"WITH {_RESULTS} SELECT model, count(*) AS total_tasks, round(avg(lcb), 4) AS avg_overall, round(min(lcb), 6) AS min_score, round(max(lcb), 6) AS max_score, count(*) FILTER (WHERE len(failures) > 0) AS critical_failures, round(count(*) FILTER (WHERE len(failures) > 0) / count(*), 6) AS critical_failure_rate FROM results GROUP BY model")
def j9(spark, sf_dir):
    return board.by_model(results(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("min_score", "max_score")})


@query("j10_behaviour_details", f"WITH {_RESULTS}, x AS (SELECT *, task_id % 7 AS tests, least(task_id % 5, task_id % 7) AS ok FROM results WHERE task_id % 3 <> 0) SELECT model, count(*) AS n, round(avg(bf), 4) AS avg_bf, round(coalesce(sum(CASE WHEN tests > 0 THEN ok / tests END) / count(*), 0), 4) AS avg_pass_rate, count(*) FILTER (WHERE bf >= 0.95) AS perfect FROM x GROUP BY model")
def j10(spark, sf_dir):
    key = F.col("task_id")
    return board.behaviour_details(results(spark, sf_dir), F.least(key % 5, key % 7), key % 7, key % 3 == 0)


@query("j14_reproducible", f"WITH {_RESULTS} SELECT model, tier, count(*) AS runs, count(DISTINCT (language, priority)) = 1 AS same FROM results GROUP BY ALL")
def j14(spark, sf_dir):
    return board.reproducible(results(spark, sf_dir), ["model", "tier"], ["language", "priority"])


@query("a11_tier_totals", f"WITH {_RESULTS} SELECT tier, count(*) AS n, round(avg(lcb), 4) AS avg_lcb, grouping(tier)::INT AS level FROM results GROUP BY ROLLUP (tier)")
def a11(spark, sf_dir):
    return board.tier_stats(results(spark, sf_dir))


# Selection


@query(
    "k1_file_metrics",
    r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    m AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(trim(x), '^\s*[^\s*/]'))) AS loc, 1 + len(regexp_extract_all(text, '(?i)\bthe\b')) + len(regexp_extract_all(text, '(?i)\bder\b')) + len(regexp_extract_all(text, '(?i)\bque\s+.*\bde\b')) AS complexity, len(list_distinct(regexp_extract_all(text, 'of (\w+)', 1))) AS names FROM d)
    SELECT doc_id, loc, complexity, names, CASE WHEN loc < 300 THEN 0.0 ELSE 0.2 END::DOUBLE AS loc_score FROM m""",
)
def k1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", selection.code_lines("text").cast("long").alias("loc"), selection.cyclomatic("text", r"(?i)(?<!\w)the(?!\w)", r"(?i)(?<!\w)der(?!\w)", r"(?i)(?<!\w)que\s+.*(?<!\w)de(?!\w)").cast("long").alias("complexity"), F.size(selection.distinct_names("text", r"of (\w+)")).cast("long").alias("names"))
    return rows.withColumn("loc_score", selection.stepped(F.col("loc"), [(300, 0.0)], 0.2))


@query("k11_domain", f"WITH d AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS low FROM part), c AS (SELECT p_partkey, unnest([{', '.join(f'{{n: {i}, k: {"+".join(f"contains(low, {k!r})::INT" for k in keys)}}}' for i, keys in enumerate((('steel', 'blue'), ('brass', 'red'), ('a', 'e'))))}], recursive := true) FROM d) SELECT p_partkey, CASE WHEN k = 0 THEN 'general' ELSE ['first', 'second', 'third'][n + 1] END AS domain FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC, n) = 1")
def k11(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", selection.domain(text, {"first": ("steel", "blue"), "second": ("brass", "red"), "third": ("a", "e")}).alias("domain"))


@query("k12_size_tiers", "SELECT doc_id, 'T' || (least(3, (n_chars >= 1000)::INT + (n_chars >= 2000)::INT + (n_chars >= 4000)::INT + floor(CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 1.5 ELSE 0 END)::INT) + 1) AS tier FROM documents")
def k12(spark, sf_dir):
    boost = F.when(F.col("lang") == "en", 0.5).when(F.col("lang") == "de", 1.5).otherwise(0.0)
    return table(spark, sf_dir, "documents").select("doc_id", selection.size_tier(F.col("n_chars"), boost, (1000, 2000, 4000)).alias("tier"))


@query(
    "k14_round_robin",
    """WITH c AS (SELECT p_partkey, 'T' || (p_size % 4 + 1) AS tier, p_brand AS dataset, p_retailprice AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY tier, dataset ORDER BY score DESC, p_partkey) AS round FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round, dataset) AS place FROM r) SELECT p_partkey, tier, round::INT AS round, place::INT AS place FROM p WHERE place <= CASE tier WHEN 'T1' THEN 50 WHEN 'T2' THEN 42 WHEN 'T3' THEN 41 ELSE 68 END""",
)
def k14(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("T"), (F.col("p_size") % 4 + 1).cast("string")).alias("tier"), F.col("p_brand").alias("dataset"), F.col("p_retailprice").alias("score"))
    return selection.round_robin(part, selection.tier_targets(200), tie="p_partkey").select("p_partkey", "tier", "round", "place")


# Rows in order, ranges and streams


@query("a25_merged_conversations", "SELECT conv_id, count(*) AS parts, length(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS n_chars, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def a25(spark, sf_dir):
    return merged_digests(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").withColumnRenamed("md5", "digest")


@query("h18_normal_output", r"""WITH r AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents), n AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))), chr(10)), '\A\s+|\s+\z', '', 'g') AS t FROM r) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest, len(regexp_extract_all(t, '-?[0-9]+\.?[0-9]*')) AS numbers FROM n""")
def h18(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", compare.normal_output("text").alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"), F.size(t.numbers("t")).cast("long").alias("numbers"))


@query("h23_batch_comparison", "WITH x AS (SELECT l_orderkey, CASE WHEN abs(l_extendedprice - l_quantity * 1000) <= l_quantity * 500 THEN 1.0 ELSE 0.5 END AS s, l_returnflag = 'R' AND l_linenumber = 1 AS error FROM lineitem), b AS (SELECT l_orderkey, count(*) AS tests, count(*) FILTER (WHERE NOT error AND s >= 0.95) AS matches, count(*) FILTER (WHERE NOT error AND s < 0.95) AS mismatches, count(*) FILTER (WHERE error) AS errors FROM x GROUP BY l_orderkey) SELECT l_orderkey, tests, matches, mismatches, errors, round(matches / tests, 6) AS score, CASE WHEN (mismatches + errors) / tests >= 0.10 THEN 'CF-03' END AS failure FROM b")
def h23(spark, sf_dir):
    near = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000) <= F.col("l_quantity") * 500
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(near, 1.0).otherwise(0.5).alias("similarity"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("error"))
    return compare.batch(rows, "l_orderkey").withColumn("score", F.round("score", 6))


@query("e5_weighted_coverage", "SELECT l_orderkey, round(sum(w * hit) / sum(w), 6) AS coverage FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS w, (l_quantity >= 25)::INT AS hit FROM lineitem) GROUP BY l_orderkey")
def e5(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("priority", F.when(F.col("l_returnflag") == "R", "CRITICAL").when(F.col("l_returnflag") == "A", "IMPORTANT").otherwise("TRIVIAL"))
    return scoring.weighted_coverage(rows, "l_orderkey", F.col("priority"), F.col("l_quantity") >= 25).withColumn("coverage", F.round("coverage", 6))


@query("s1_windowed_means", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(coalesce(json_extract_string(props, '$.k')::BIGINT, 0)) AS top FROM events GROUP BY ALL")
def s1(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    top = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.max(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))).alias("top")).select(F.col("w.start").alias("start"), "event_type", "top")
    out = windowed_means(events, "ts", "event_type", "value").join(top, ["start", "event_type"])
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


from docmeter import queries_boards, queries_more, queries_programs, queries_reports, queries_scores, queries_second, queries_wide  # noqa: E402, F401  (register their queries)

__all__ = ["ORACLE_SQL", "QUERIES"]

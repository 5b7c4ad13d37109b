"""Aggregation of per-task results into ranked boards.

Results have the columns ``task_id, model, submitter, tier, language, sc, dq, bf, lcb`` (0 to 1) and ``failures``
(array of strings). Every function aggregates before it shuffles; what it returns has a row per model, or per model and
tier, so that the ranking window sees as many rows as there are models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmeter.lexicons import WEIGHTS

TIERS = ("T1", "T2", "T3", "T4")


def model_key(model: Column, submitter: Column) -> Column:
    """The model; the submitter where it is missing or unknown."""
    known = lambda c, unknown: F.when(c.isNotNull() & (c != "") & (c != unknown), c)
    return F.coalesce(known(model, "unknown"), known(submitter, "Unknown"), F.lit("unknown"))


def tier_of(task_id: Column) -> Column:
    tier = F.regexp_extract(task_id, "-(T[1-4])-", 1)
    return F.when(tier != "", tier).otherwise("T1")


def language_of(task_id: Column) -> Column:
    return F.when(task_id.startswith("LCB-UB-"), "UniBasic").otherwise("COBOL")


def drop_call_failures(failures: Column, references: Column, traceability: Column, least: float = 0.20) -> Column:
    """CF-05 goes where nothing was referenced or traceability is good enough."""
    return F.when((references == 0) | (traceability >= least), F.filter(failures, lambda f: ~f.startswith("CF-05"))).otherwise(failures)


def averages(results: DataFrame, weights: dict[str, float] = WEIGHTS, digits: int = 4) -> DataFrame:
    """One row per model: component means, both overall means, task and failure counts, tier means (0 if empty)."""
    mean = lambda c: F.round(F.avg(c), digits)
    parts = {k: F.avg(k) for k in weights}
    overall = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    tiers = [F.round(F.coalesce(F.avg(F.when(F.col("tier") == t, F.col("lcb"))), F.lit(0.0)), digits).alias(f"avg_{t.lower()}") for t in TIERS]
    return results.groupBy("model").agg(
        F.count("*").alias("tasks_total"),
        *[mean(k).alias(f"avg_{k}") for k in weights],
        F.round(overall, digits).alias("avg_lcb_components"),
        mean("lcb").alias("avg_lcb_tasks"),
        F.count_if(F.size("failures") > 0).alias("critical_failures"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        *tiers,
    )


def ranked(board: DataFrame, by: str = "avg_lcb_components") -> DataFrame:
    """Ranks 1 to n without ties, the best first, equal scores by model name."""
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "model")))


def leaderboard(results: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return ranked(averages(results, weights))


def modal_submitter(results: DataFrame) -> DataFrame:
    """Each model's most frequent submitter; of equally frequent ones the first by name."""
    counts = results.groupBy("model", "submitter").agg(F.count("*").alias("n"))
    return counts.groupBy("model").agg(F.min_by("submitter", F.struct(-F.col("n"), F.col("submitter"))).alias("submitter"), F.max("n").alias("n"))


def failure_histogram(results: DataFrame) -> DataFrame:
    """How often each model's results have each critical failure (what stands before a colon)."""
    kinds = results.select("model", F.explode("failures").alias("failure"))
    return kinds.groupBy("model", F.split_part("failure", F.lit(":"), F.lit(1)).alias("failure")).agg(F.count("*").alias("n"))


def tier_stats(results: DataFrame) -> DataFrame:
    """Rows and mean by tier with a grand total (tier null)."""
    return results.rollup("tier").agg(F.count("*").alias("n"), F.round(F.avg("lcb"), 4).alias("avg_lcb"), F.grouping_id().cast("int").alias("level"))


def by_model(results: DataFrame) -> DataFrame:
    """Mean, least and greatest score, failures and their rate."""
    failed = F.count_if(F.size("failures") > 0)
    return results.groupBy("model").agg(F.count("*").alias("total_tasks"), F.round(F.avg("lcb"), 4).alias("avg_overall"), F.min("lcb").alias("min_score"), F.max("lcb").alias("max_score"), failed.alias("critical_failures"), F.round(failed / F.count("*"), 6).alias("critical_failure_rate"))


def overall(results: DataFrame) -> DataFrame:
    """One row: component means, failures and rate over all results."""
    failed = F.count_if(F.size("failures") > 0)
    return results.agg(*[F.round(F.avg(k), 2).alias(f"{k}_avg") for k in ("sc", "dq", "bf", "lcb")], F.count("*").alias("total_tasks"), failed.alias("critical_failure_count"), F.round(F.try_divide(failed, F.count("*")), 3).alias("critical_failure_rate"))


def behaviour_details(results: DataFrame, passed: Column, tests: Column, placeholder: Column) -> DataFrame:
    """Mean score and pass rate of rows that are no placeholders; rows without tests count in the mean's divisor."""
    rows = results.filter(~placeholder)
    rate = F.sum(F.when(tests > 0, passed / tests)) / F.count("*")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("bf"), 4).alias("avg_bf"), F.round(F.coalesce(rate, F.lit(0.0)), 4).alias("avg_pass_rate"), F.count_if(F.col("bf") >= 0.95).alias("perfect"))


def reproducible(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Whether all runs of a task gave the same values."""
    state = F.xxhash64(*values)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), (F.min(state) == F.max(state)).alias("same"))


def task_details(results: DataFrame, model: str, language: str | None = None) -> DataFrame:
    """One model's tasks, name in any case, of one language if given."""
    rows = results.filter((F.lower("model") == model.lower()) | (F.lower("submitter") == model.lower()))
    return rows.filter(F.lower("language") == language.lower()) if language else rows


MODES = ("executed", "static", "error")


def _counts(rows: DataFrame, kind: str, out: str) -> DataFrame:
    """A map from kind to number for each model; as long as there are kinds."""
    counts = rows.filter(F.col(kind).isNotNull()).groupBy("model", kind).agg(F.count("*").alias("n"))
    return counts.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(out))


def detailed_board(results: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The ranked board with ``submitter``, ``critical_failure_types``, ``by_tier`` and ``bf_method``.

    ``by_tier`` maps each tier to its number of tasks and mean, ``bf_method`` has the tasks of each way of judging (column
    ``mode``) and a map of reasons (``mode_reason``; null counts nowhere). Maps come from counts by model and kind, so that a
    model with very many tasks meets in no task. Tasks are a table of their own, ``detailed_tasks``.
    """
    tiers = results.groupBy("model", "tier").agg(F.struct(F.count("*").alias("total"), F.round(F.avg("lcb"), 4).alias("avg_score")).alias("stats"))
    tiers = tiers.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "stats")))).alias("by_tier"))
    failures = _counts(failure_kinds(results), "failure", "critical_failure_types")
    reasons = _counts(results, "mode_reason", "reasons")
    modes = results.groupBy("model").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in MODES])
    out = leaderboard(results, weights).join(modal_submitter(results).select("model", "submitter"), "model").join(tiers, "model").join(modes, "model")
    out = out.join(failures, "model", "left").join(reasons, "model", "left")
    none = F.create_map().cast("map<string,bigint>")
    method = F.struct(*MODES, F.coalesce("reasons", none).alias("reasons"))
    return out.withColumns({"critical_failure_types": F.coalesce("critical_failure_types", none), "bf_method": method}).drop(*MODES, "reasons")


def failure_kinds(results: DataFrame) -> DataFrame:
    """``model, failure``: a row for each critical failure of each result, without what stands after a colon."""
    return results.select("model", F.explode("failures").alias("failure")).withColumn("failure", F.split_part("failure", F.lit(":"), F.lit(1)))


def detailed_tasks(results: DataFrame, digits: int = 4) -> DataFrame:
    """``model, task_id, tier, language, lcb, sc, dq, bf, mode, mode_reason, failures``: what a board's rows were made of."""
    score = lambda c: F.round(c, digits).alias(c)
    return results.select("model", "task_id", "tier", "language", *map(score, ("lcb", "sc", "dq", "bf")), F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("mode_reason", F.lit("")).alias("mode_reason"), "failures")


def restated(details: DataFrame, weights: dict[str, float] = WEIGHTS, digits: int = 4) -> DataFrame:
    """Component means of shown tasks (``task_details`` of a model, or of one language of it), and the overall one of these."""
    parts = {k: F.avg(k) for k in weights}
    overall = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    return details.groupBy("model").agg(F.count("*").alias("tasks"), *[F.round(v, digits).alias(f"avg_{k}") for k, v in parts.items()], F.round(overall, digits).alias("avg_lcb"), *[F.count_if(F.col("mode") == m).alias(m) for m in MODES])


def summary(board: DataFrame) -> DataFrame:
    """The eleven columns of the summary, as text: rank, submitter and model, percentages with one decimal, counts."""
    # Half a tenth goes to the even one as doubles have it, not as their shortest decimals do.
    percent = lambda c, name: F.format_string("%.1f", F.rint(c * 100 * 10) / 10).alias(name)
    of_tier = lambda t: F.coalesce(F.try_element_at("by_tier", F.lit(t))["avg_score"], F.lit(0.0))
    traced = F.col("avg_tr") if "avg_tr" in board.columns else F.lit(0.0)
    return board.select(
        F.col("rank").cast("string").alias("rank"), F.concat_ws("/", "submitter", "model").alias("model"), percent(F.col("avg_lcb_components"), "lcb_score"), percent(F.col("avg_sc"), "sc"), percent(F.col("avg_bf"), "bf"), percent(F.col("avg_dq"), "sq"), percent(traced, "tr"),
        percent(of_tier("T1"), "t1_score"), percent(of_tier("T4"), "t4_score"), F.col("tasks_total").cast("string").alias("total_tasks"), F.col("critical_failures").cast("string").alias("critical_failures"),
    )

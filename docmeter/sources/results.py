"""Result files, source files and board sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from docmeter.operators.board import summary

#: Characters beyond which a wrapped content is a document.
LONG_CONTENT = 50

RESULT = """task_id string, task_category string, evaluator_version string, submitter struct<name:string,model:string,category:string>,
result struct<version:string,lcb_score:double,structural_completeness:double,behavioral_fidelity:double,semantic_quality:double,traceability:double,
scores:struct<sc:double,dq:double,bf:double,overall:double,comprehension:double,behavioral:double,documentation:double>,
critical_failures:array<string>,breakdown:struct<bf:string>>, overall_score double, model string, lcb_score double"""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file of a folder (boards are left out); unreadable ones keep their text in ``_corrupt_record``."""
    rows = spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.input_file_name()).filter(~F.col("file").endswith("leaderboard.json"))


def layout(task: str = "task_id") -> Column:
    """Which layout a result has: ``2.3.1``, ``2.3``, ``2.1`` or null if it is none."""
    scores = F.col("result.scores")
    newest = (F.col("result.version") == "2.3.1") | (scores["sc"].isNotNull() & scores["dq"].isNotNull())
    return F.when(F.col(task).isNull() | F.col("result").isNull(), None).when(newest, "2.3.1").when((F.col("result.version") == "2.3.0") | scores["comprehension"].isNotNull(), "2.3").when(F.col("result.structural_completeness").isNotNull(), "2.1")


def normalised_results(rows: DataFrame) -> DataFrame:
    """All layouts as ``task_id, model, submitter, version, sc, dq, bf, tr, lcb`` (0 to 1) and ``failures`` (ids)."""
    version, scores, r = layout(), F.col("result.scores"), F.col("result")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pick = lambda new, mid, old: F.when(F.col("version") == "2.3.1", zero(new) / 100).when(F.col("version") == "2.3", zero(mid) / 100).otherwise(zero(old))
    ident = lambda f: F.coalesce(F.get_json_object(f, "$.id"), F.split_part(f, F.lit(":"), F.lit(1)))
    rows = rows.withColumn("version", version).filter("version is not null")
    return rows.select(
        "task_id",
        F.coalesce(F.col("submitter.model"), F.col("model")).alias("model"),
        F.col("submitter.name").alias("submitter"),
        "version",
        pick(scores["sc"], scores["comprehension"], r["structural_completeness"]).alias("sc"),
        pick(scores["dq"], scores["documentation"], r["semantic_quality"]).alias("dq"),
        pick(scores["bf"], scores["behavioral"], r["behavioral_fidelity"]).alias("bf"),
        F.when(F.col("version") == "2.1", zero(r["traceability"])).otherwise(0.0).alias("tr"),
        F.when((F.col("version") == "2.3.1") & (zero(r["lcb_score"]) > 0), r["lcb_score"] / 100).when((F.col("version") == "2.3") & (zero(scores["overall"]) > 0), scores["overall"] / 100).otherwise(zero(F.col("overall_score"))).alias("lcb"),
        F.transform(F.coalesce(r["critical_failures"], F.array().cast("array<string>")), ident).alias("failures"),
    )


def read_sources(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("cbl", "cob", "CBL", "COB")) -> DataFrame:
    """``program`` (path), ``source`` and ``size`` of all source files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return rows.select(F.col("path").alias("program"), F.decode("content", F.lit("UTF-8")).alias("source"), F.col("length").alias("size"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    schema = "task_id string, category string, difficulty string, language string, domain string, input_files array<string>, task_description string, source_dataset string, tier string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_board(board: DataFrame, folder: str) -> None:
    """A board as JSON, and as CSV in percent with one decimal."""
    board.write.mode("overwrite").json(f"{folder}/json")
    share = [c for c in board.columns if c.startswith("avg_")]
    board.select(*[F.round(F.col(c) * 100, 1).alias(c) if c in share else F.col(c) for c in board.columns]).write.mode("overwrite").csv(f"{folder}/csv", header=True)


def write_detailed_board(board: DataFrame, tasks: DataFrame, folder: str) -> None:
    """A detailed board as nested JSON, a row for each model; its tasks as JSON, a folder for each model; the summary as CSV."""
    board.write.mode("overwrite").json(f"{folder}/board")
    tasks.withColumn("of_model", F.col("model")).write.mode("overwrite").partitionBy("of_model").json(f"{folder}/tasks")
    summary(board).write.mode("overwrite").csv(f"{folder}/summary", header=True)


def markdown(board: DataFrame, columns: list[str]) -> DataFrame:
    """A pipe table as text with ``line_no``: the head, its rule, then the rows in the order of their first column."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = board.select((F.row_number().over(Window.orderBy(columns[0])) + 1).alias("line_no"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    head = board.sparkSession.range(2).select(F.col("id").cast("int").alias("line_no"), F.when(F.col("id") == 0, row([F.lit(c) for c in columns])).otherwise(row([F.lit("---") for _ in columns])).alias("value"))
    return head.unionByName(body)


def write_results(rows: DataFrame, folder: str, version: str = "2.3.1") -> None:
    """Results (``task_id, model, sc, dq, bf, failures``; scores in 0 to 1) as JSON lines of the common layout, a folder
    for each evaluator version."""
    scores = F.struct(*[(F.col(k) * 100).alias(k) for k in ("sc", "dq", "bf")])
    result = F.struct(F.lit(version).alias("version"), scores.alias("scores"), F.col("failures").alias("critical_failures"))
    out = rows.select("task_id", F.lit("documentation").alias("task_category"), F.lit(version).alias("evaluator_version"), F.struct(F.col("model").alias("name"), F.col("model").alias("model")).alias("submitter"), result.alias("result"))
    out.withColumn("of_version", F.col("evaluator_version")).write.mode("append").partitionBy("of_version").json(folder)


def read_result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Results that ``write_results`` wrote, of all versions."""
    return spark.read.schema(RESULT).option("recursiveFileLookup", True).json(folder)


def write_manifest(files: DataFrame, folder: str, tier: str = "tier") -> None:
    """Files as JSON lines, a folder for each tier."""
    files.write.mode("overwrite").partitionBy(tier).json(folder)


def write_tests(tests: DataFrame, folder: str) -> None:
    tests.write.mode("overwrite").json(folder)


def cache_misses(sources: DataFrame, cache: DataFrame, key: str = "program") -> DataFrame:
    """Sources whose text, by key and hash, the cache doesn't hold."""
    return sources.withColumn("source_hash", F.sha2("source", 256)).join(cache.select(key, "source_hash").distinct(), [key, "source_hash"], "left_anti")


@F.pandas_udf(StringType())
def _contents(texts: pd.Series) -> pd.Series:
    return pd.Series([_content(t) if isinstance(t, str) else None for t in texts])


def _content(text: str) -> str:
    """Long ``content`` values of the JSON objects that a text holds, joined by blank lines; the text itself without any."""
    found, at, decoder = [], text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            value, end = None, at + 1
        if isinstance(value, dict) and isinstance(value.get("content"), str) and len(value["content"]) > LONG_CONTENT:
            found.append(value["content"])
        at = text.find("{", end)
    return "\n\n".join(found) or text


def json_contents(document: str | Column) -> Column:
    """Documents wrapped in JSON objects without theirs; only texts with a brace reach the Python function."""
    text = F.col(document) if isinstance(document, str) else document
    return F.when(F.contains(text, F.lit("{")), _contents(text)).otherwise(text)


def missing_results(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def unwrapped(document: str | Column, mark: str = r"<!--\s*Source:[^>]*-->") -> Column:
    """Documents in which each part after a source mark may be a JSON object: its ``content``, parts joined by a blank line."""
    parts = F.filter(F.transform(F.split(F.col(document) if isinstance(document, str) else document, mark), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.content"), p)), "\n\n")


#: Characters of a merged document that becomes one text.
MOST_CHARS = 1 << 24


def merged(rows: DataFrame, key: str, order: list[str], text: str, between: str = "\n", most_chars: int = MOST_CHARS) -> DataFrame:
    """Texts of a key in order as one ``document``, with the number of ``parts``, its ``n_chars`` and its ``md5``.

    Keys of more than ``most_chars`` characters have no document but all the rest, by ``merged_digests``; so no row holds
    an unbounded key. Ties in order go by text; null texts are empty ones.
    """
    size = rows.groupBy(key).agg((F.sum(F.length(F.coalesce(text, F.lit("")))) + F.count("*") * len(between)).alias("_size"))
    small = rows.join(size.filter(F.col("_size") <= most_chars).select(key), key, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_text"))))
    whole = small.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), between).alias("document"))
    return merged_digests(rows, key, order, text, between).join(whole, key, "left")


def merged_digests(rows: DataFrame, key: str, order: list[str], text: str, between: str = "\n") -> DataFrame:
    """``key, parts, n_chars, md5`` of the texts of each key in order, put together one row after the other.

    Rows are sorted by key and order within their task, which holds one batch of rows and a running digest.
    """
    kind = rows.schema[key].dataType
    slim = rows.select(key, *order, F.coalesce(text, F.lit("")).alias("_text")).repartition(key).sortWithinPartitions(key, *order, "_text")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, chars, digest, of = None, 0, 0, hashlib.md5(), pa.null()
        for batch in batches:
            done, of = [], batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if parts and k != now:
                    done.append((now, parts, chars, digest.hexdigest()))
                    parts, chars, digest = 0, 0, hashlib.md5()
                piece = between + t if parts else t
                now, parts, chars = k, parts + 1, chars + len(piece)
                digest.update(piece.encode())
            yield _digests(key, done, of)
        if parts:
            yield _digests(key, [(now, parts, chars, digest.hexdigest())], of)

    return slim.select(key, "_text").mapInArrow(digested, f"`{key}` {kind.simpleString()}, parts long, n_chars long, md5 string")


def _digests(key: str, rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (of, pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "parts", "n_chars", "md5"])


def code_block(answer: str | Column) -> Column:
    """The first fenced block of an answer that names the language, or the first plain one; the answer without any."""
    text = F.col(answer) if isinstance(answer, str) else answer
    block = lambda head: F.nullif(F.regexp_extract(text, rf"(?is)```{head}\n(.*?)\n```", 1), F.lit(""))
    return F.coalesce(F.when(F.contains(F.lower(text), F.lit("```cobol")), block("cobol")).otherwise(block("")), text)


def without_fences(answer: str | Column) -> Column:
    """An answer without its lines of fence marks, if it begins with one."""
    text = F.trim(F.col(answer) if isinstance(answer, str) else answer)
    return F.when(text.startswith("```"), F.trim(F.regexp_replace(text, r"(?m)^```[^\n]*\n?", ""))).otherwise(text)

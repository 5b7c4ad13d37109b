"""Index of books and programs by name, files that a program needs, and parsed programs in a table that is extended, not rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmeter.functions.text import as_column
from docmeter.operators import source_code as sc

# Suffixes and folders of books, suffixes of programs, and how many names and files count.
BOOK_SUFFIXES, BOOK_FOLDERS = ("cpy", "copy"), ("cpy", "copy", "copybook", "copybooks")
PROGRAM_SUFFIXES = ("cbl", "cob")
MOST_BOOKS, MOST_EACH, MOST_FILES = 5, 3, 5
# End of fixed values.


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: str | Column) -> Column:
    """Lower-case suffix of a path's last part, empty without one."""
    return F.lower(F.regexp_extract(_last(as_column(path)), r"[^.]\.([^.]*)$", 1))


def stem(path: str | Column) -> Column:
    """Upper-case last part of a path without its suffix."""
    return F.upper(F.regexp_replace(_last(as_column(path)), r"(?<=[^.])\.[^.]*$", ""))


def is_book(path: str | Column) -> Column:
    """By suffix, or by a folder's name anywhere above."""
    folders = F.transform(F.slice(F.reverse(F.split(as_column(path), "/")), 2, 1 << 30), lambda f: F.lower(f))
    return suffix(path).isin(*BOOK_SUFFIXES) | F.arrays_overlap(folders, F.array(*[F.lit(f) for f in BOOK_FOLDERS]))


def file_index(files: DataFrame, chosen: Column, *keys: str) -> DataFrame:
    """``keys, name, path`` of the chosen files: each name's first path in order, within its keys (as a data set)."""
    named = files.filter(chosen).select(*keys, stem("path").alias("name"), "path")
    return named.groupBy(*keys, "name").agg(F.min("path").alias("path"))


def book_index(files: DataFrame, *keys: str) -> DataFrame:
    return file_index(files, is_book("path"), *keys)


def program_index(files: DataFrame, *keys: str) -> DataFrame:
    return file_index(files, suffix("path").isin(*PROGRAM_SUFFIXES), *keys)


def found_files(needs: DataFrame, index: DataFrame, keys: list[str], names: str, most: int, kind: str) -> DataFrame:
    """``program, kind, nth, name, path`` of a program's first ``most`` names (an array, in order) that the index has.

    An equi-join on keys and name: a name that all programs use is a hot key, which AQE splits, of one index row.
    """
    each = needs.select("program", *keys, F.posexplode(F.slice(names, 1, most)).alias("nth", "name")).withColumn("name", F.upper("name"))
    return each.join(index, [*keys, "name"]).select("program", F.lit(kind).alias("kind"), "nth", "name", "path")


def related_files(needs: DataFrame, books: DataFrame, programs: DataFrame, keys: list[str], most: int = MOST_FILES) -> DataFrame:
    """Files that understanding a program (``program, keys, calls, copies``) needs: called programs first, then books.

    Of each kind the first few names count, and of what is found the first ``most``. A program has at most twice MOST_EACH
    rows before that.
    """
    both = found_files(needs, programs, keys, "calls", MOST_EACH, "program").unionByName(found_files(needs, books, keys, "copies", MOST_EACH, "book"))
    order = F.array_sort(F.collect_list(F.struct((F.col("kind") == "book").alias("later"), "nth", "kind", "name", "path")))
    return both.groupBy("program").agg(F.slice(order, 1, most).alias("files")).select("program", F.posexplode("files").alias("place", "f")).select("program", "place", "f.kind", "f.name", "f.path")


def book_fields(books: DataFrame) -> DataFrame:
    """Fields of books (``name, content``), which have no division of their own; lines count from the book's first."""
    rows = books.select(F.col("name").alias("program"), F.concat(F.lit("       DATA DIVISION.\n"), F.coalesce("content", F.lit(""))).alias("source"))
    return sc.data_fields(rows).withColumn("line_no", F.col("line_no") - 1).withColumnRenamed("program", "book")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def cached_parse(sources: DataFrame, folder: str, parse: Callable[[DataFrame], DataFrame], language: str = "first", key: str = "program", digits: int = 1) -> DataFrame:
    """What ``parse`` makes of sources (``key, source``), from the table in ``folder`` where it has them.

    The table has what was parsed by ``key`` and ``source_hash``, in a folder for each ``language`` and the first
    ``digits`` of the hash (``bucket``), so that a join reads the buckets it needs. Sources that it lacks, by key and hash, are parsed and
    appended; rows are never rewritten, and a changed source gets rows of its own. ``parse`` keeps ``key``; a source
    of which it makes nothing is parsed again the next time. Runs that append at once may both parse a source: rows of a key,
    hash and run are returned once, those of the first run that has them.
    """
    spark = sources.sparkSession
    wanted = sources.select(key, "source", F.sha2(F.coalesce("source", F.lit("")), 256).alias("source_hash")).withColumn("bucket", F.substr("source_hash", F.lit(1), F.lit(digits)))
    of_language = f"{folder.rstrip('/')}/language={language}"
    missing, run = wanted, 1
    if _exists(spark, of_language):
        known = spark.read.parquet(of_language)
        missing = wanted.join(known.select(key, "source_hash", "bucket").distinct(), [key, "source_hash", "bucket"], "left_anti")
        run = (known.agg(F.max("run")).first()[0] or 0) + 1
    made = parse(missing.select(key, "source")).join(missing.select(key, "source_hash", "bucket"), key).withColumn("run", F.lit(run))
    made.write.mode("append").partitionBy("bucket").parquet(of_language)
    have = spark.read.schema(made.schema).parquet(of_language).join(wanted.select(key, "source_hash", "bucket"), [key, "source_hash", "bucket"], "left_semi")
    first = have.groupBy(key, "source_hash", "bucket").agg(F.min("run").alias("run"))
    return have.join(first, [key, "source_hash", "bucket", "run"])

"""Tables that cut lineage: written to the shared folder, then read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset and Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    """This process's folder, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *order: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which survives lost executors; ``drop`` removes it."""
    path = fresh_path(df.sparkSession, name)
    out = df.sortWithinPartitions(*order) if order else df
    out.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(conf).delete(path, True)

"""Files in the folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (tests on one machine) a folder under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its file system: one without a scheme lies in Spark's default file system, as it does for Spark's own readers and writers."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    home = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/")
    return f"file://{path}" if home == "file:" else f"{home}{path}"


def located(path: str):
    """The file system of a URI, and the path inside it. Tasks are given resolved paths: one without a scheme would name each machine's own disk."""
    from pyarrow import fs

    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"the path {path} names no file system")
    return fs.FileSystem.from_uri(path)

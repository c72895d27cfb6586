"""A local session for tests and benchmarks; on a cluster, use the session it gives."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    home = tempfile.mkdtemp(prefix="spark-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.checkpoint.dir", f"file://{home}/shared")
        .config("spark.local.dir", f"{home}/local")
        .getOrCreate()
    )

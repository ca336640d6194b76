"""A local session for tests, checks and benchmarks; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitequill")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SITEQUILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for streams and written tables.

    On a cluster it lies in the shared folder of ``spark.checkpoint.dir``. Without that
    setting, as in local tests, a temporary folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        run = spark.sparkContext.applicationId
        return f"{shared.rstrip('/')}/{name}-{run}-{os.urandom(4).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def cut_lineage(rows: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate table and go on from the written copy.

    Used where a result feeds several branches, so that losing executors costs a read and
    not a recomputation.
    """
    spark = rows.sparkSession
    path = work_folder(spark, name)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

"""Readers and sinks for the tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitequill.sources.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table as parquet, ORC, JSON or CSV with its fixed schema."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


def stream_table(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Read a growing directory of access-log or change-feed files as a stream."""
    reader = spark.readStream.schema(TABLES[name]).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly per-row work on a scan with fewer splits than cores.

    A scan of large files has more splits than that and stays as it is, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Write index and page texts, one row per address: (site_id, path, content)."""
    documents.select("site_id", "path", "content").write.mode(mode).parquet(path)


def write_events(events: DataFrame, path: str, run: str | int) -> None:
    """Add the events of one run; a run owns its folder, so running it again leaves one copy."""
    events.write.mode("overwrite").parquet(f"{path}/run={run}")

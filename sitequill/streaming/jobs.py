"""Streams that write tables: verdicts, agent activity, and artefacts kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitequill.operators.agents import agent_activity
from sitequill.plans.rebuild import rebuilt
from sitequill.plans.tables import Tables
from sitequill.session import cut_lineage
from sitequill.sources.artifacts import append_artifacts


def activity_stream(
    requests: DataFrame, path: str, checkpoint: str, width: str, keys: Sequence[str] = (), **trigger
) -> StreamingQuery:
    """Requests per agent and window, and per ``keys``. Each micro-batch writes its own counts to
    its own folder, so a repeated batch replaces itself, and a late row counts like any other;
    ``read_activity`` adds the counts up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        agent_activity(batch, width, keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        requests.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_activity(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    return (
        spark.read.parquet(f"{path}/batch=*")
        .groupBy(*keys, "window_start", "agent")
        .agg(F.sum("requests").alias("requests"))
    )


def split_late(rows: DataFrame, folder: str, checkpoint: str, width: str, delay: str, **trigger) -> StreamingQuery:
    """Write a stream (site_id, ts, agent) to ``ontime`` and ``late`` tables, batch by batch.

    A row is late if its window ended before the horizon: the newest time of earlier batches
    less ``delay``. That is the watermark with which ``window_stream`` has read those batches, or
    a later one, so it never drops a row of ``ontime``. A batch that runs again gives the
    same rows, since its horizon comes from the batches before it.
    """
    end = F.window("ts", width)["end"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = lambda name: f"{folder}/{name}/batch={batch_id}"
        kept = cut_lineage(batch.select("site_id", "ts", "agent", end.alias("window_end")), "micro-batch")
        late = F.lit(False)
        if batch_id:
            seen = spark.read.parquet(f"{folder}/newest").filter(F.col("batch") < batch_id)
            newest = seen.agg(F.max("newest") - F.expr(f"INTERVAL {delay}")).first()[0]
            if newest is not None:
                late = F.col("window_end") <= F.lit(newest)
        for name, some in (("ontime", ~late), ("late", late)):
            kept.filter(some).drop("window_end").write.mode("overwrite").parquet(at(name))
        kept.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(at("newest"))

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def window_stream(spark: SparkSession, folder: str, checkpoint: str, width: str, delay: str, **trigger) -> StreamingQuery:
    """Count agents per site and event-time window, from the rows in time.

    The state holds open windows only. Every micro-batch writes the new counts of the windows
    that it changed; ``read_windows`` takes the last ones.
    """
    rows = spark.readStream.schema("site_id string, ts timestamp, agent string").parquet(f"{folder}/ontime/batch=*")
    counts = (
        rows.filter(F.col("agent").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "site_id", "agent")
        .agg(F.count("*").alias("requests"))
        .select("site_id", F.col("w.start").alias("window_start"), "agent", "requests")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_windows(spark: SparkSession, folder: str, width: str) -> DataFrame:
    """Counts per site, window and agent: ``requests`` in time, and ``late_requests``."""
    key = ["site_id", "window_start", "agent"]
    counts = spark.read.option("basePath", f"{folder}/counts").parquet(f"{folder}/counts/batch=*")
    last = counts.groupBy(*key).agg(F.max_by("requests", "batch").alias("requests")).withColumn("late_requests", F.lit(0).cast("bigint"))
    late = agent_activity(spark.read.parquet(f"{folder}/late/batch=*"), width, ["site_id"])
    late = late.withColumn("late_requests", F.col("requests")).withColumn("requests", F.lit(0).cast("bigint"))
    return last.unionByName(late).groupBy(*key).agg(F.sum("requests").alias("requests"), F.sum("late_requests").alias("late_requests"))


def rebuild_stream(
    changes: DataFrame,
    tables: Callable[[], Tables],
    path: str,
    checkpoint: str,
    now: Column | None = None,
    **trigger,
) -> StreamingQuery:
    """Follow a change feed: every micro-batch renders only the pages and indexes it touches.

    ``tables`` reads the tables anew for each micro-batch, so posts that came after the start
    are seen. Keys whose source is gone get a row without content, which readers skip.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        append_artifacts(rebuilt(tables(), batch, None, at), path, f"stream-{batch_id}")

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

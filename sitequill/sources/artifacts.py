"""The store of rendered artefacts: a base and batches of later rows, in buckets of the key.

Both are Spark's bucketed tables with the same buckets, so the newest rows are found and met with
their texts bucket by bucket, without an exchange. A batch is one partition of the delta table;
a batch that runs again replaces its rows. ``merge_artifacts`` writes a new version of the base
and records how far each writer's batches went into it; readers skip those. A version counts
once it is recorded, so a merge that fails leaves the old one in force.

A batch is named by a writer and a number, as ``stream-12`` or ``7``; of rows made at one time
that of the higher number is newer. The number of buckets is fixed when a store is made.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequill.sources.schemas import TABLES

BUCKETS = 32
KEY = ["site_id", "kind", "artifact_key"]
_FIELDS = TABLES["artifacts"].fieldNames()
_NUMBERED = "^(.*?)([0-9]{1,18})$"


def _number(batch: Column) -> Column:
    return F.coalesce(F.expr("try_cast(nullif(regexp_extract(batch, '^(.*?)([0-9]{1,18})$', 2), '') AS BIGINT)"), F.lit(0).cast("bigint"))


def _writer(batch: Column) -> Column:
    return F.when(batch.rlike(_NUMBERED), F.regexp_extract(batch, _NUMBERED, 1)).otherwise(batch)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, in Hadoop's terms."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _buckets(spark: SparkSession, path: str, wanted: int) -> int:
    """The number of buckets of a store, written down when it is made."""
    layout = f"{path}/layout"
    if not _exists(spark, f"{layout}/_SUCCESS"):
        spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("overwrite").parquet(layout)
    return spark.read.parquet(layout).first()["buckets"]


def _bucketed(spark: SparkSession, path: str, folder: str, buckets: int, partitioned: bool) -> str:
    """The session's name of a table at a folder of the store; makes the table known if it isn't."""
    name = f"artifacts_{hashlib.md5(f'{path}/{folder}'.encode()).hexdigest()}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["artifacts"].fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch string) USING parquet"
        " OPTIONS ('partitionOverwriteMode' = 'dynamic')"
        f"{' PARTITIONED BY (batch)' if partitioned else ''}"
        f" CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'"
    )
    if partitioned and _exists(spark, f"{path}/{folder}"):
        # Partitions that other sessions wrote.
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def append_artifacts(artifacts: DataFrame, path: str, batch: str | int, buckets: int = BUCKETS) -> None:
    """Add one batch of rendered artefacts, at most one row per key.

    Rows are dealt to buckets as they are written, which is the only time that texts move.
    """
    spark = artifacts.sparkSession
    buckets = _buckets(spark, path, buckets)
    name = _bucketed(spark, path, "delta", buckets, True)
    rows = artifacts.select(*_FIELDS, F.lit(str(batch)).alias("batch"))
    rows.repartition(buckets, *KEY).write.insertInto(name, overwrite=True)


def artifacts_of_batch(spark: SparkSession, path: str, batch: str | int) -> DataFrame:
    """The rows that one batch wrote, as long as it is not deleted."""
    name = _bucketed(spark, path, "delta", _buckets(spark, path, BUCKETS), True)
    return spark.table(name).filter(F.col("batch") == str(batch))


def _merged(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int]]]:
    """The version of the base, 0 for none, and the last batch of each writer that went into it."""
    if not _exists(spark, f"{path}/merges"):
        return 0, []
    rows = spark.read.parquet(f"{path}/merges")
    newest = rows.agg(F.max("version")).first()[0]
    # One row per writer.
    return newest, [(r.writer, r.upto) for r in rows.filter(F.col("version") == newest).collect()]


def _delta(spark: SparkSession, path: str, buckets: int, merged: list[tuple[str, int]]) -> DataFrame:
    rows = spark.table(_bucketed(spark, path, "delta", buckets, True))
    batch = F.col("batch")
    for writer, upto in merged:
        # On the partition column alone, so merged batches are not even listed.
        rows = rows.filter(~((_writer(batch) == writer) & (_number(batch) <= upto)))
    return rows


def _made(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.struct("generated_at", _number(F.col("batch")).alias("number"), "batch").alias("made"))


def _newest(rows: DataFrame) -> DataFrame:
    """Time and batch of the newest row per key, from narrow columns."""
    return rows.groupBy(*KEY).agg(F.max("made").alias("newest"))


def _beside(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Join by key inside each bucket: the narrow side is held, the texts stream past it."""
    return rows.join(side.hint("shuffle_hash"), KEY, how)


def stored_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every key, removed ones included, with the batch that wrote it.

    Comparisons stand after the joins as "not older", because an equality would become a part
    of the join key, for which the buckets don't serve.
    """
    buckets = _buckets(spark, path, BUCKETS)
    version, merged = _merged(spark, path)
    delta = _made(_delta(spark, path, buckets, merged))
    newest = _newest(delta)
    later = _beside(delta, newest, "inner").filter(F.col("made") >= F.col("newest")).drop("newest")
    if not version:
        return later.drop("made")
    base = _made(spark.table(_bucketed(spark, path, f"base/version={version}", buckets, False)))
    old = base.select(*KEY, F.col("made").alias("old"))
    later = _beside(later, old, "left").filter(F.coalesce(F.col("made") > F.col("old"), F.lit(True))).drop("old")
    kept = _beside(base, newest, "left").filter(F.coalesce(F.col("made") >= F.col("newest"), F.lit(True))).drop("newest")
    return kept.unionByName(later).drop("made")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every artefact that is not removed."""
    return stored_artifacts(spark, path).filter(F.col("content").isNotNull()).select(*_FIELDS)


def merge_artifacts(spark: SparkSession, path: str, now: Column) -> int:
    """Write base and batches as a new base, without removed keys whose lifetime is over at ``now``.

    Each task holds rows of one bucket already, so this moves no text either. Returns the
    version. Batches that come while it runs are left for the next one.
    """
    buckets = _buckets(spark, path, BUCKETS)
    version, merged = _merged(spark, path)
    batches = _delta(spark, path, buckets, merged).select("batch").distinct()
    fresh = batches.groupBy(_writer(F.col("batch")).alias("writer")).agg(F.max(_number(F.col("batch"))).alias("upto")).collect()
    upto = dict(merged) | {r.writer: max(r.upto, dict(merged).get(r.writer, r.upto)) for r in fresh}
    over = F.col("content").isNull() & (F.unix_seconds("generated_at") + F.col("ttl_s") <= F.unix_seconds(now))
    name = _bucketed(spark, path, f"base/version={version + 1}", buckets, False)
    stored_artifacts(spark, path).filter(~over).select(*_FIELDS, "batch").write.insertInto(name, overwrite=True)
    rows = [(version + 1, w, n) for w, n in upto.items()] or [(version + 1, "", -1)]
    spark.createDataFrame(rows, "version int, writer string, upto long").coalesce(1).write.mode("append").parquet(f"{path}/merges")
    return version + 1


def remove_merged(spark: SparkSession, path: str) -> None:
    """Delete the batches that are in the base, and earlier versions of it, when nobody reads them."""
    version, merged = _merged(spark, path)
    files, _ = _files(spark, path)
    if not version:
        return
    upto = dict(merged)
    name = _bucketed(spark, path, "delta", _buckets(spark, path, BUCKETS), True)
    batches = spark.table(name).select("batch").distinct()
    named = batches.select("batch", _writer(F.col("batch")).alias("writer"), _number(F.col("batch")).alias("number"))
    for r in named.collect():
        if r.number <= upto.get(r.writer, -1):
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (batch = '{r.batch}')")
            files.delete(_files(spark, f"{path}/delta/batch={r.batch}")[1], True)
    for old in range(1, version):
        files.delete(_files(spark, f"{path}/base/version={old}")[1], True)

"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitequill.session import cut_lineage, work_folder

__all__ = ["components", "cut_lineage", "ranked", "table", "work_folder"]

#: Bytes of text that a task works on together.
TEXT_BYTES = 2_000_000

#: Partition number of a rank: rows of one key are dealt to this many ranges of a hash.
RANK_BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(
    rows: DataFrame, keys: list[str], order: str, rank: str, stretch: int | None = None, then: tuple[str, ...] = ()
) -> DataFrame:
    """Number the rows of each key from 0 in column `rank`, in the order of a 64-bit column.

    No key is sorted in one task: its rows are dealt to ranges of `order`, whose counts give
    each range its first number; only ranges are sorted. `order` should be a hash, so that
    ranges are even. `rows` is read twice and should be a written table. Null keys are one key;
    rows with equal `order` are numbered in any order, or by the columns `then`. An order that is
    no hash comes with the length of its ranges in `stretch`.
    """
    if stretch:
        bucket = F.floor(F.col(order) / stretch)
    else:
        bucket = F.floor((F.col(order) / F.lit(2.0**64) + F.lit(0.5)) * RANK_BUCKETS).cast("int")
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order, *then)
    numbered = rows.withColumn("__at", F.row_number().over(inside) - 1)
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(first, same).select(
        *[c for c in rows.columns if c != "__bucket"],
        (F.col("__first") + F.col("__at")).alias(rank),
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: one row (member, root) per linked id.

    The root is the smallest id of the component; the root itself has a row as well. Each round
    joins all neighbours of an id to the smallest among them, which ends in stars after about
    the logarithm of the diameter. Both inputs of each join are written tables, so adaptive
    execution can split the rows of a hub. Null ids and links to itself are ignored.
    """
    spark = edges.sparkSession
    now = _oriented(edges.select(F.col(a).alias("x"), F.col(b).alias("y")))
    state, now = _written(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = cut_lineage(
            both.groupBy("x").agg(F.min("y").alias("low"))
            .select(F.col("x").alias("u"), F.least("x", "low").alias("low")),
            "lowest",
        )
        moved = both.join(low, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("low").alias("y"))
        seen, now = _written(_oriented(moved.unionByName(low.select(F.col("u").alias("x"), F.col("low").alias("y")))))
        if seen == state:
            break
        state = seen
    members = now.select(F.col("y").alias("member"), F.col("x").alias("root"))
    return members.unionByName(now.select(F.col("x").alias("member"), F.col("x").alias("root")).distinct())


def _oriented(pairs: DataFrame) -> DataFrame:
    return (
        pairs.where(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )


def _written(pairs: DataFrame) -> tuple[tuple[int, int], DataFrame]:
    """The written pairs, with their number and a sum of their hashes."""
    seen = Observation()
    wanted = pairs.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("x", "y"), 20)), F.lit(0)).alias("h"),
    )
    rows = cut_lineage(wanted, "links")
    got = seen.get
    return (got["n"], got["h"]), rows


def no_text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about TEXT_BYTES of text together, one at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().tolist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > TEXT_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def used_up(*written: DataFrame) -> None:
    """Delete tables of `cut_lineage` of which everything that is still needed has been written."""
    for rows in written:
        spark = rows.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in rows.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

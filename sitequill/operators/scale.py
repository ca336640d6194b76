"""Skew-proof helpers: joins, top-n and numbering that survive one key with a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequill.session import cut_lineage


def lookup_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a large table with a side table of one narrow row per key, however skewed.

    Adaptive execution takes the side's real size in bytes and broadcasts it below Spark's own
    threshold; beyond that it splits the rows of a hot key over many tasks. It can do so only
    if both inputs are shuffled for the join, so the key is one struct: a side that was grouped
    by the same columns is then shuffled as well. A null in the key matches nothing.
    """
    on = list(on)
    key = F.struct(*on)
    rest = [c for c in lookup.columns if c not in on]
    side = lookup.dropna(subset=on).select(key.alias("_key"), *rest)
    return fact.withColumn("_key", key).join(side, "_key", how).drop("_key")


def top_n(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str,
    spread_by: str,
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows per key, ranked from 1.

    Two rounds: the first ranks inside (key, salt), so a hot key is sorted by many tasks and
    leaves at most ``n`` rows per salt; the second ranks the survivors. Spark turns both
    filters into group limits that also cut rows before the shuffle.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(inner))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .filter(F.col(rank) <= n)
    )


def newest_first_position(
    rows: DataFrame, group: str, part: str, ts: str, unique_id: str
) -> DataFrame:
    """Number all rows newest first without sorting a whole group in one task.

    Adds ``position`` (within group and part) and ``section`` (the parts of a group numbered
    by their newest row). Rows are range partitioned by group, part, time and id, so a hot part
    or a day with a bulk import is cut into many ranges; each partition numbers its own rows,
    and counts per partition and part say where it starts. The sorted rows are written once,
    because both steps have to see the same ranges.
    """
    keys = [group, part]
    order = [F.col(group), F.col(part), F.desc(ts), F.desc(unique_id)]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this id are the partition, the lower 33 count its rows.
    numbered = cut_lineage(spread.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    numbered = numbered.withColumn("_range", F.shiftright("_at", 33))
    ranges = numbered.groupBy(*keys, "_range").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max(F.struct(ts, unique_id)).alias("_newest")
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    newest = ranges.groupBy(*keys).agg(F.max("_newest").alias("_newest"))
    sections = newest.withColumn(
        "section", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_newest")))
    ).drop("_newest")
    starts = starts.join(sections, keys).select(*keys, "_range", "_first", "_before", "section")
    return (
        lookup_join(numbered, starts, [*keys, "_range"], "inner")
        .withColumn("position", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int"))
        .drop("_at", "_range", "_first", "_before")
    )

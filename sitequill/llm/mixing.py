"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt to blocks; a slot holds one block. If all sources were served
at once, each at its weight over the weights of those not used up, block k of a source would be
served in a certain stretch of slots. The block is released in the slot in which the stretch
begins and due at its end; in each slot the released block with the earliest deadline goes out.
At every slot of the whole schedule each source then differs from its target by less than one
block. When a source is used up, the others go on with their weights, so every document is used
exactly once.

Weights are taken as the exact numbers they are, and stretches are worked out in whole numbers
of any size: nothing is rounded to units that add up to a drift. There may be any number of
sources. The schedule is worked out by one task that sees one count per source and holds one or two blocks of each; it writes a narrow
row per block. Documents are numbered inside their source by counts of hash ranges, never in one
task, and meet the slot of their block in a join.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ranked

#: Documents in a block, slots in a batch of the schedule.
BLOCK = 32
BATCH = 10_000
#: Without given weights a source weighs its number of documents to this power.
TEMPERATURE = 0.5


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, sources by their place in the lists: earliest deadline first."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact)) if exact else 1
    units = [int(w * scale) for w in exact]
    # The moment n / u as a whole number: keys of different moments differ, as no u has more bits.
    bits = 2 * max((u.bit_length() for u in units), default=0)
    ends = sorted(((n << bits) // u, n, u) for n, u in zip(blocks, units, strict=True) if n > 0)
    keys = [key for key, _, _ in ends]
    done = [0, *accumulate(n for _, n, _ in ends)]
    active = [sum(u for _, _, u in ends)]
    for _, _, u in ends:
        active.append(active[-1] - u)

    def served(k: int, u: int) -> tuple[int, int]:
        """Blocks of all sources up to the moment k / u: whole ones, and rounded up."""
        at = bisect_right(keys, (k << bits) // u)
        whole, rest = divmod(k * active[at], u)
        return done[at] + whole, done[at] + whole + (rest > 0)

    coming = [(0, i, 0) for i, n in enumerate(blocks) if n > 0]
    waiting: list[tuple[int, int, int]] = []
    for t in range(done[-1]):
        while coming and coming[0][0] <= t:
            _, i, k = heapq.heappop(coming)
            release, deadline = served(k + 1, units[i])
            heapq.heappush(waiting, (deadline, i, k))
            if k + 1 < blocks[i]:
                heapq.heappush(coming, (release, i, k + 1))
        deadline, i, k = heapq.heappop(waiting)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield i, k


def period(units: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """Slots of each source if all have as many blocks as units: one period of these units."""
    return {s: slots for s, _, _, _, _, _, slots in phases(units, units)}


def phases(blocks: Mapping[str | None, int], units: Mapping[str | None, float]) -> list[tuple]:
    """A small schedule by source: rows (source, first block, blocks, first slot, period, units, slots)."""
    names = list(blocks)
    slots: dict[str | None, list[int]] = {s: [] for s in names}
    for t, (i, _) in enumerate(schedule(list(blocks.values()), [units[s] for s in names])):
        slots[names[i]].append(t)
    return [(s, 0, n, 0, sum(blocks.values()), n, slots[s]) for s, n in blocks.items() if n > 0]


def _scheduled(weights: Mapping[str | None, float] | None, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {s: n for b in batches for s, n in zip(b.column("source").to_pylist(), b.column("n").to_pylist(), strict=True)}
        # Sorted, so that equal counts give the same schedule whatever order they came in.
        names = sorted(counts, key=lambda s: (s is None, s or ""))
        if weights is None:
            target = [counts[s] ** TEMPERATURE for s in names]
        else:
            least = min(weights.values(), default=1.0)
            target = [weights.get(s, least) for s in names]
        rows: list[tuple] = []
        for slot, (i, k) in enumerate(schedule([-(-counts[s] // block) for s in names], target)):
            rows.append((names[i], k, slot))
            if len(rows) == BATCH:
                yield _slots(rows)
                rows = []
        yield _slots(rows)

    return run


def _slots(rows: list[tuple]) -> pa.RecordBatch:
    s, b, slot = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(s, pa.string()), pa.array(b, pa.int64()), pa.array(slot, pa.int64())], names=["s", "b", "slot"]
    )


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per (doc_id, source): doc_id, source, block, slot, place.

    Sorting by slot, then place, gives the mixed order; a slot holds one block of one source.
    Inside a source the order is that of a hash of doc_id. A null source is a source, a null
    doc_id an id; repeated rows of one doc_id and source share a place; texts don't matter.
    Weights must be positive; sources without a given weight get the smallest given one. Other
    columns are ignored; an empty table gives no rows.
    """
    if weights is not None and not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    rows = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
        .distinct().withColumn("order", F.xxhash64(F.lit("mix"), "doc_id")),
        "mix-rows",
    )
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.repartition(1).mapInArrow(_scheduled(weights, block), "s string, b long, slot long")
    numbered = ranked(rows, ["source"], "order", "rank").select(
        "doc_id", "source", F.floor(F.col("rank") / block).alias("block"), (F.col("rank") % block).alias("place")
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    return numbered.join(plan, same).select("doc_id", "source", "block", "slot", "place")


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """All rows of docs, ordered by slot and place; written files keep that order by name.

    There is a slot row per document, so no size of that side is proven: it is merged, never
    broadcast, and small tables take the plan of large ones.
    """
    order = mixed(docs, weights).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("slot").alias("__slot"), F.col("place").alias("__place"))
    packed = docs.select(
        F.struct("*").alias("__row"),
        F.col("doc_id").cast("long").alias("__doc"), F.col("source").cast("string").alias("__from"),
    )
    placed = packed.join(cut_lineage(order, "mix-order").hint("merge"), F.col("__doc").eqNullSafe(F.col("__id")) & F.col("__from").eqNullSafe(F.col("__source")))
    return placed.select("__row", "__slot", "__place").repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select("__row.*")

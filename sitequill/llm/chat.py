"""Collapse of cumulative conversation logs, then rendering. SQL expressions only.

A log that was saved after each turn leaves many conversations that are prefixes of a longer
one. Each turn has a position-keyed hash; the exclusive-or of the hashes up to a turn is the
rolling hash of that prefix. A conversation whose last hash is a proper prefix hash of another
is dropped, of equal conversations the smallest id stays.

Hashes are narrow rows. A conversation of any length is scanned in parts of PART_TURNS turn
numbers: totals of the parts give each part its start value. Texts are shuffled once, by
conversation and part, and only for retained conversations.

Parts with more than PART_ROWS rows, as null keys or repeated rows give them, are known from the
hashes and left out of that shuffle. Their rows are made distinct as rows, spread over ranges in
their order, numbered by counts of ranges and rendered PART_ROWS at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

#: Turn numbers in one part, the unit of scanning and rendering.
PART_TURNS = 256
#: Rows that are rendered together at most.
PART_ROWS = 4096
#: Characters of a text that take part in choosing ranges, so that their sample is small.
RANGE_CHARS = 1024
#: Marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
_NONE = -(2**63)
_HASH = ("h1", "h2", "n")


def _keys() -> list[Column]:
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    return [
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"),
        turn.alias("at"),
        F.floor(turn / PART_TURNS).alias("part"),
    ]


def _prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rolling hashes: one row per conversation and turn; and the parts of each conversation, with their rows."""
    said = [F.lit(0), F.col("at"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashes = (
        turns.select(*_keys(), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .select("conv", "at", "part", F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"))
        .groupBy("conv", "at", "part", "h1", "h2").agg(F.count(F.lit(1)).alias("seen"))
    )
    xor = [F.bit_xor(h).alias(h) for h in ("h1", "h2")]
    by_turn = cut_lineage(
        hashes.groupBy("conv", "part", "at").agg(*xor, F.count(F.lit(1)).alias("n"), F.sum("seen").alias("seen")), "turn-hashes"
    )
    by_part = by_turn.groupBy("conv", "part").agg(*xor, F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.max("at").alias("end"))
    whole = Window.partitionBy("conv")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(
        by_part.select(
            F.col("conv").alias("c"), F.col("part").alias("p"), "seen",
            F.max("end").over(whole).alias("last"),
            F.coalesce(F.bit_xor("h1").over(before), F.lit(0)).alias("b1"),
            F.coalesce(F.bit_xor("h2").over(before), F.lit(0)).alias("b2"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bn"),
        ),
        "conversation-parts",
    )
    run = Window.partitionBy("conv", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = by_turn.select(
        "conv", "part", "at",
        *[F.bit_xor(h).over(run).alias(h) for h in ("h1", "h2")], F.sum("n").over(run).alias("n"),
    )
    rolling = rolling.join(parts, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))).select(
        "conv", (F.col("at") == F.col("last")).alias("ends"),
        F.col("h1").bitwiseXOR(F.col("b1")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("b2")).alias("h2"),
        (F.col("n") + F.col("bn")).alias("n"),
    )
    return cut_lineage(rolling, "rolling-hashes"), parts.select("c", "p", "seen")


def maximal(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retained conversations (conv, copies), and all parts (c, p, seen) of all conversations."""
    rolling, parts = _prefixes(turns)
    ends = rolling.where("ends").groupBy(*_HASH).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    proper = rolling.where("not ends").select(*_HASH).distinct()
    return cut_lineage(ends.join(proper, list(_HASH), "left_anti").select("conv", "copies"), "maximal"), parts


def _safe(text: Column) -> Column:
    """Text in which nothing reads as a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(turns: DataFrame) -> DataFrame:
    """One row per part of each retained conversation: conv_id, part, n_turns, copies, text.

    Conversations of up to PART_TURNS turn numbers are one part; joining the texts of a longer
    one in order of `part` gives its whole text. A part with more than PART_ROWS distinct rows
    comes as several, and the later parts of its conversation move up. A null conv_id is a conversation of its own, a
    null turn comes before all others, a null role reads `unknown`, a null text is empty but
    differs from an empty one when conversations are compared. Repeated rows count once; rows
    that share a turn stand in order of role and text. Other columns are ignored; an empty table
    gives no rows. Null conversations and empty ones need no care: a conversation has a row.
    """
    kept, parts = maximal(turns)
    wanted = cut_lineage(
        parts.join(kept, F.col("c") == F.col("conv")).select("c", "p", "copies", (F.col("seen") > PART_ROWS).alias("large")),
        "wanted-parts",
    )
    rows = turns.select(
        *_keys(), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.col("text").cast("string").alias("text")
    )
    own = (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p"))
    large = parts.where(F.col("seen") > PART_ROWS).select("c", "p")
    if large.isEmpty():
        return _shown(rows.join(wanted, own), F.col("part"))
    small = rows.join(large, own, "left_anti")
    cut = _cut(rows.join(wanted.where("large").select("c", "p"), own, "left_semi"))
    more = cut.groupBy("conv", "part").agg(F.max("piece").alias("more"))
    earlier = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(
        wanted.join(more, own, "left").select(
            "c", "p", "copies", "large", F.coalesce(F.sum("more").over(earlier), F.lit(0)).alias("shift")
        ),
        "placed-parts",
    )
    number = F.col("part") + F.col("shift")
    whole = _shown(small.join(placed.where("not large"), own), number)
    return whole.unionByName(_shown(cut.join(placed.where("large"), own), number + F.col("piece")))


def _cut(rows: DataFrame) -> DataFrame:
    """Distinct rows with `piece`: rows of a part in order of turn, role and text, PART_ROWS in each."""
    order = ["conv", "part", "at", "role"]
    ranges = rows.distinct().repartitionByRange(*order, F.substring("text", 1, RANGE_CHARS))
    ranges = cut_lineage(ranges.withColumn("range", F.spark_partition_id()), "large-parts")
    before = Window.partitionBy("conv", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("conv", "part", "range").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("conv").alias("c"), F.col("part").alias("p"), F.col("range").alias("r"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
    )
    inside = Window.partitionBy("conv", "part", "range").orderBy("at", "role", "text")
    numbered = ranges.withColumn("number", F.row_number().over(inside) - 1).join(
        first, (F.col("conv") == F.col("c")) & (F.col("part") == F.col("p")) & (F.col("range") == F.col("r"))
    )
    piece = F.floor((F.col("first") + F.col("number")) / PART_ROWS)
    return cut_lineage(numbered.select(*order, "text", piece.alias("piece")), "cut-parts")


def _shown(own: DataFrame, number: Column) -> DataFrame:
    """The text of the rows of each conversation and part number."""
    turn = F.struct("at", "role", "text")
    pieces = own.withColumn("number", number).groupBy("conv", "part", "number").agg(
        F.any_value("copies").alias("copies"), F.array_distinct(F.sort_array(F.collect_list(turn))).alias("said")
    )
    shown = F.transform(
        "said",
        lambda x: F.concat(
            F.lit(START), _safe(F.when(x.role.isNull() | (x.role == ""), "unknown").otherwise(x.role)), F.lit("\n"), _safe(x.text), F.lit(END), F.lit("\n")
        ),
    )
    return pieces.select(
        F.when(F.col("conv") != _NONE, F.col("conv")).alias("conv_id"),
        F.col("number").alias("part"), F.size("said").cast("long").alias("n_turns"), "copies", F.array_join(shown, "").alias("text"),
    )

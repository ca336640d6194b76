"""Prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt from the beginning of another one and their own rest. Turns become
hashes in the scan; texts are never shuffled. A hash keyed by the position makes the exclusive-or
of the first d turns a key of that prefix, and that of all turns a key of the whole sequence.

Equal conversations collapse to one weighted sequence, so a conversation copied a million times
is one path. A sequence whose key is no proper prefix of another is a leaf (anti-join). The
prefixes of the sequences, with their weights, add up to the nodes. A node's share of
`saved_tokens` is put on one path, that of its smallest member, and sums from the end of each
path bring it to all nodes above.

No conversation is sorted, scanned or hashed in one piece: turns are numbered by ranges, running
values are taken in parts of PART turns, and lists of ends are joined in pieces of PIECE ids. Only
the SHA-256 of a list reads these pieces in turn, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequill.operators.scale import lookup_join

from .common import cut_lineage, no_text

#: The first turns come from the conversation whose id is the next lower multiple of this.
GROUP = 20
#: So many first turns at most, less one.
LEAD = 4
#: Turns in one part of a path; ids in one piece of a list.
PART = 256
PIECE = 4096
#: Characters of role and text by which rows of one turn are ordered, before a hash of the whole.
HEAD = 64
_NODE = ("depth", "k1", "k2")


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, i, t1, t2, words): turns numbered from 1; and (conv, own): their number."""
    role, text = no_text(F.col("role").cast("string")), no_text(F.col("text").cast("string"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.left(role, F.lit(HEAD)).alias("role"), F.left(text, F.lit(HEAD)).alias("text"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "t1", "t2"))]
    # The upper bits of this id are the range, the lower 33 count its rows.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "t1", "t2", "words", F.monotonically_increasing_id().alias("at"))
    rows = cut_lineage(rows, "turns").withColumn("range", F.shiftright("at", 33))
    ranges = rows.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut_lineage(ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "turn-ranges")
    numbered = lookup_join(rows, ranges.select("conv", "range", "first", "before"), ["conv", "range"], "inner")
    own = ranges.groupBy("conv").agg(F.sum("n").alias("own"))
    i = F.col("before") + F.col("at") - F.col("first") + 1
    return cut_lineage(numbered.select("conv", i.alias("i"), "t1", "t2", "words"), "numbered-turns"), own


def _lead(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % LEAD


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, depth, words, h1, h2), and the ids of rebuilt conversations without turns (conv).

    The first h turns come from conversation c - c % GROUP, as far as it has them, the others are
    those that follow the first h of the conversation itself; h = crc32(c) % LEAD. The remainder
    has the sign of c.
    """
    numbered, own = _numbered(turns)
    base = F.col("conv") - F.col("conv") % GROUP
    shape = own.select("conv", "own", base.alias("base"), _lead(F.col("conv")).alias("h"))
    lengths = own.where(F.col("conv") % GROUP == 0).select(F.col("conv").alias("base"), F.col("own").alias("given"))
    shape = lookup_join(shape, lengths, ["base"]).withColumn("lead", F.least("h", F.coalesce("given", F.lit(0))))
    shape = cut_lineage(shape.select("conv", "own", "base", "h", "lead"), "shapes")
    rest = lookup_join(numbered.where(F.col("i") > _lead(F.col("conv"))), shape.select("conv", "h", "lead"), ["conv"], "inner").select(
        "conv", (F.col("i") - F.col("h") + F.col("lead")).alias("depth"), "t1", "t2", "words"
    )
    # At most LEAD - 1 rows for each of at most GROUP conversations.
    first = numbered.where((F.col("i") < LEAD) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "from")
    first = first.join(shape.select("conv", "base", "lead"), (F.col("from") == F.col("base")) & (F.col("i") <= F.col("lead"))).select(
        "conv", F.col("i").alias("depth"), "t1", "t2", "words"
    )
    said = rest.unionByName(first).select(
        "conv", F.col("depth").cast("long").alias("depth"), "words",
        F.xxhash64("depth", "t1", "t2").alias("h1"), F.xxhash64(F.lit("second"), "t2", "depth", "t1").alias("h2"),
    )
    bare = shape.where((F.col("lead") == 0) & (F.col("own") <= F.col("h"))).select("conv")
    return cut_lineage(said, "rebuilt-turns"), bare


def _running(rows: DataFrame, values: list[str], fold, back: bool = False) -> DataFrame:
    """Add running values `r_<name>` over the depths of each conversation, from its end if `back`.

    Rows are scanned in parts of PART depths; the folds of the parts give each its start.
    """
    rows = rows.withColumn("part", F.floor((F.col("depth") - 1) / PART))

    def order(column):
        return F.desc(column) if back else F.asc(column)

    parts = rows.groupBy("conv", "part").agg(*[fold(v).alias(v) for v in values])
    before = Window.partitionBy("conv").orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", *[F.coalesce(fold(v).over(before), F.lit(0)).alias(f"b_{v}") for v in values])
    run = Window.partitionBy("conv", "part").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[fold(v).over(run).alias(f"r_{v}") for v in values])
    return lookup_join(rows, parts, ["conv", "part"], "inner").drop("part")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each sequence, joined by commas in pieces of at most PIECE."""
    names = ["depth", "k1", "k2", "first", "ids"]
    now, ids, done = None, [], []

    def close():
        if ids:
            done.append((*now, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for depth, k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, k1, k2) != now or len(ids) >= PIECE:
                close()
                now, ids = (depth, k1, k2), []
            ids.append(conv)
        yield _table(done, names)
        done = []
    close()
    yield _table(done, names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each sequence, which come in order; the list is never held whole."""
    names = ["depth", "k1", "k2", "sha"]
    now, digest, done = None, None, []
    for batch in batches:
        for depth, k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, k1, k2) == now:
                digest.update(b",")
            else:
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (depth, k1, k2), hashlib.sha256()
            digest.update(ids.encode())
        yield _table(done, names)
        done = []
    if now:
        done.append((*now, digest.hexdigest()))
    yield _table(done, names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("ids", "sha") else pa.int64() for n in names]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _ends(wholes: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): the hash of the ids of the conversations that end at a node."""
    by = [*_NODE, "conv"]
    pieces = wholes.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _pieces, "depth long, k1 long, k2 long, first long, ids string"
    )
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, sha string"
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation. Turns are ordered by number, null first; rows
    of one turn by the first HEAD characters of role and text, then by a hash of both. Repeated
    rows are turns of their own. Null roles and texts are empty, and equal to empty ones. Texts
    of any length are compared whole, by 128 bits of hash. Other columns are ignored. An empty
    table has no conversation and so no root.
    """
    said, bare = rebuilt(turns)
    zero = F.lit(0).cast("long")
    xor = [F.bit_xor(h).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))]
    wholes = said.groupBy("conv").agg(F.count(F.lit(1)).alias("depth"), *xor)
    wholes = cut_lineage(wholes.unionByName(bare.select("conv", *[zero.alias(k) for k in _NODE])), "whole-sequences")
    sequences = cut_lineage(
        wholes.groupBy(*_NODE).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")), "weighted-sequences"
    )
    own = lookup_join(said, sequences.select("conv", "weight", F.col("depth").alias("length")), ["conv"], "inner")
    steps = _running(own, ["h1", "h2"], F.bit_xor).select(
        "conv", "weight", "length", "depth", "words",
        *[F.col(f"r_h{i}").bitwiseXOR(F.col(f"b_h{i}")).alias(f"k{i}") for i in (1, 2)], "h1", "h2",
    )
    # The key before the last turn is the key of the parent.
    steps = steps.select(
        "conv", "weight", "length", *_NODE, "words", *[F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"u{i}") for i in (1, 2)]
    )
    roots = sequences.select(
        "conv", "weight", F.col("depth").alias("length"), *[zero.alias(k) for k in _NODE], zero.alias("words"),
        *[F.lit(None).cast("long").alias(u) for u in ("u1", "u2")],
    )
    paths = cut_lineage(steps.unionByName(roots), "paths")

    proper = paths.where(F.col("depth") < F.col("length")).select(*_NODE).distinct()
    leaves = sequences.join(proper, list(_NODE), "left_anti").select("conv", F.lit(1).alias("leaf"))
    nodes = cut_lineage(
        lookup_join(paths, leaves, ["conv"]).groupBy(*_NODE).agg(
            F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
            F.max("words").alias("words"), F.max("u1").alias("u1"), F.max("u2").alias("u2"),
        ),
        "nodes",
    )

    # A node's tokens stand once, on the path of its smallest member.
    tokens = nodes.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    on_paths = paths.select("conv", *_NODE).join(tokens, ["conv", "depth"], "left").withColumn("tokens", F.coalesce("tokens", zero))
    below = _running(on_paths, ["tokens"], F.sum, back=True)
    none = {c: F.lit(None).cast("long") for c in ("conv_id", "n_convs", "n_leaves", "u1", "u2", "saved", "child")}

    def partial(rows: DataFrame, sha: Column = F.lit(None).cast("string"), **has: Column) -> DataFrame:
        columns = none | has
        return rows.select(*_NODE, *[c.cast("long").alias(n) for n, c in columns.items()], sha.alias("sha"))

    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
    parts = [
        partial(nodes, conv_id=F.col("conv"), **{c: F.col(c) for c in ("n_convs", "n_leaves", "u1", "u2")}),
        partial(below, saved=F.col("r_tokens") + F.col("b_tokens")),
        partial(children, child=F.lit(1)),
        partial(_ends(wholes), sha=F.col("sha")),
    ]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    whole = cut_lineage(
        together.groupBy(*_NODE).agg(
            *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_leaves", "u1", "u2")],
            F.sum("saved").alias("saved_tokens"), F.count("child").alias("n_children"), F.max("sha").alias("sha"),
        ),
        "whole-nodes",
    )
    above = whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    return lookup_join(whole, above, ["depth", "u1", "u2"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

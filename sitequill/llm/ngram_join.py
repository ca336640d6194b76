"""Similarity join of documents on word n-grams: rare-first prefix filtering.

1. One pass describes each document (set size, key of its set, parity bits of its n-grams)
   and counts all n-grams in a sketch of fixed size. The sketch gives the global rare-first order;
   a collision in it only moves an n-gram towards the end, so results don't depend on it.
2. A second pass emits the prefix n-grams of each distinct set. Those that occur in one set only
   are dropped. Length and positional filters test what is left.
3. Candidates are first taken in chains: in each n-gram's group every set meets the REACH next
   ones in one of a few random orders, so pairs grow with the rows and not with their square.
   Verified links give components; then only pairs whose sets are still in different components
   are left, and all of those are verified. Within a component further pairs cannot change the
   result.
4. The suffix filter bounds the difference of two whole sets before they are compared: each
   n-gram flips one of BITS bits, so the bits in which two sets differ are at most the n-grams
   in which they differ, and nearly as many while those are few. Each pair is verified once, and
   texts are read again only for sets that passed.

Copies (equal sets) are one class from the start and are never joined with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut_lineage, stretches, used_up
from .shingles import WordHashes, mixed, set_key, shingle_set

#: The sketch has 2 ** SKETCH_BITS counters in BLOCKS rows. Its size doesn't follow the input;
#: for corpora far beyond a terabyte raise it, which lowers the noise in the order.
SKETCH_BITS = 18
BLOCKS = 256
#: Bits of the filter that picks texts; like the sketch, its size doesn't follow the input.
FILTER_BITS = 24
BITS = 1024
#: Random orders in which the sets of a group are chained, and how many following sets one meets.
ORDERS = 4
REACH = 8
#: Keys that a task remembers, to emit a set only once per task.
SEEN = 500_000

_DESCRIBED = "doc_id long, n long, key long, parity array<long>, block int, counts binary"


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded amount of text."""
    for batch in batches:
        for start, end in stretches(batch.column("text")):
            yield batch.slice(start, end - start)


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("parity", pa.list_(pa.int64())), ("block", pa.int32()), ("counts", pa.binary())])
        for batch in _parts(batches):
            rows, fresh = [], []
            for doc_id, text in _columns(batch):
                own = shingle_set(text, width, known)
                key = set_key(own)
                rows.append((doc_id, len(own), key, _parity(own)))
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    fresh.append(own)
                if len(fresh) >= 2000:
                    counts += _counted(fresh)
                    fresh = []
            counts += _counted(fresh)
            ids, sizes, keys, parity = zip(*rows, strict=True) if rows else ((), (), (), ())
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(parity, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())],
                schema=schema,
            )
        parts = counts.reshape(BLOCKS, -1)
        used = [i for i in range(BLOCKS) if parts[i].any()]
        none = pa.nulls(len(used))
        long = none.cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [long, long, long, none.cast(pa.list_(pa.int64())), pa.array(used, pa.int32()), pa.array([_packed(parts[i]) for i in used], pa.binary())],
            schema=schema,
        )

    return run


def _parity(own: np.ndarray) -> np.ndarray:
    """Bit b tells whether an odd number of the n-grams hash to b; packed in 64-bit numbers."""
    slot = (own >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=BITS) & 1).astype(bool)).view(np.int64)


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    if not sets:
        return np.zeros(1 << SKETCH_BITS, np.int64)
    return np.bincount(_slot(np.concatenate(sets)), minlength=1 << SKETCH_BITS)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type; the length of the bytes tells which."""
    top = counts.max()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size = (1 << SKETCH_BITS) // BLOCKS
    return np.frombuffer(data, f"<u{len(data) // size}").astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in _columns(batch):
            total[block] = total.get(block, 0) + _unpacked(data)
    yield pa.RecordBatch.from_pydict(
        {"block": pa.array(list(total), pa.int32()), "counts": pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())}
    )


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed counters: 2 ** SKETCH_BITS numbers, whatever the input."""
    parts = (
        described.where(F.col("block").isNotNull()).select("block", "counts")
        .repartition("block").mapInArrow(_summed, "block int, counts binary")
    )
    size = (1 << SKETCH_BITS) // BLOCKS
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.collect():
        total[row.block * size : (row.block + 1) * size] = np.frombuffer(row["counts"], "<i8")
    return total


def prefix_length(n: int, num: int, den: int) -> int:
    """N-grams of a set of n, one of which any set at the threshold must share."""
    return n - -(-n * num // den) + 1


def _prefixes(width: int, num: int, den: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, counts = WordHashes(), set(), order.value
        for batch in _parts(batches):
            tokens, keys, sizes, places = [], [], [], []
            for (text,) in _columns(batch):
                own = shingle_set(text, width, known)
                key = set_key(own)
                if not len(own) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                k = prefix_length(len(own), num, den)
                first = np.lexsort((own, counts[_slot(own)]))[:k]
                tokens.append(own[first].view(np.int64))
                keys.append(np.full(k, key, np.int64))
                sizes.append(np.full(k, len(own), np.int64))
                places.append(np.arange(k, dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (tokens, keys, sizes, places)],
                    names=["token", "key", "n", "pos"],
                )

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of ids, in blocks; blocks without a bit are left out."""
    marked = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        marked[_mark(batch.column(0).drop_null().to_numpy())] = True
    parts = np.packbits(marked).reshape(BLOCKS, -1)
    used = np.flatnonzero(parts.any(axis=1)).tolist()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])


def _mark(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _joined_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in _columns(batch):
            total[block] = total.get(block, np.uint8(0)) | np.frombuffer(bits, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "bits"])


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A filter of 2 ** FILTER_BITS bits that passes the ids and few others."""
    kind = "block int, bits binary"
    parts = ids.mapInArrow(_marks, kind).repartition("block").mapInArrow(_joined_marks, kind)
    size = (1 << FILTER_BITS) // BLOCKS // 8
    bits = np.zeros(BLOCKS * size, np.uint8)
    for row in parts.collect():
        bits[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bits


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        passes = np.unpackbits(wanted.value).astype(bool)
        for batch in _parts(batches):
            ids = batch.column("doc_id")
            chosen = passes[_mark(ids.fill_null(0).to_numpy())] | ids.is_null().to_numpy(zero_copy_only=False)
            rows = []
            for doc_id, text in _columns(batch.filter(pa.array(chosen))):
                own = shingle_set(text, width, known)
                key = set_key(own)
                if doc_id is not None or passes[_mark(np.array([key]))][0]:
                    rows.append((key, own.tobytes()))
            keys, sets = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "own"]
            )

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for ka, kb, xa, xb in _columns(batch):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if den * common >= num * (len(x) + len(y) - common):
                    a.append(ka)
                    b.append(kb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _may_link(n1: str, p1: str, n2: str, p2: str, num: int, den: int) -> Column:
    """Length and positional filter for two sets that share the n-grams at places p1 and p2."""
    n1, p1, n2, p2 = map(F.col, (n1, p1, n2, p2))
    least = F.ceil((n1 + n2) * num / (num + den) - F.lit(1e-9))
    return (
        (den * F.least(n1, n2) >= num * F.greatest(n1, n2))
        & (n1 - p1 >= least)
        & (n2 - p2 >= least)
    )


def ngram_classes(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Documents link if den * |A and B| >= num * |A or B| for their sets of `width`-word n-grams.
    component_id is the smallest doc_id reachable by links. Null and empty texts have no n-grams
    and link with nothing; a short text is one n-gram. Repeated rows are classed each on its own,
    rows with a null doc_id get the id of their class if it has one. Other columns are ignored.
    An empty table gives no rows. Links are exact up to collisions of 64-bit hashes.
    """
    return _classed(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def _classed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The same, with the key of the set of each row and the key that stands for its component."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    described = cut_lineage(texts.mapInArrow(_described(width), _DESCRIBED), "described")
    order = spark.sparkContext.broadcast(_sketch(described))
    rows = described.where(F.col("block").isNull()).select("doc_id", "n", "key", "parity")
    classes = cut_lineage(
        rows.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("first_id"), F.any_value("parity").alias("parity")),
        "classes",
    )
    prefixes = texts.select("text").mapInArrow(
        _prefixes(width, num, den, order), "token long, key long, n long, pos long"
    )
    # Sets of an n-gram in the order of their chain; in it, repeats of a set are neighbours.
    group = _chain()
    shared = cut_lineage(
        prefixes.repartition("token")
        .withColumn("before", F.lag("key").over(group))
        .where("before is null or before != key")
        .select("token", "key", "n", "pos", F.lag("key").over(group).alias("before"), F.lead("key").over(group).alias("after"))
        .where("before is not null or after is not null")
        .select("token", "key", "n", "pos"),
        "shared-prefixes",
    )
    first = cut_lineage(_close(_chained(shared, num, den), classes, num, den), "chained-pairs")
    links = cut_lineage(_links(first, texts, classes, width, num, den), "links")
    roots = cut_lineage(components(links), "roots")
    left = cut_lineage(
        _across(shared, roots, classes, num, den).join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs-across"
    )
    stars = roots.select(F.col("member").alias("a"), F.col("root").alias("b"))
    roots = cut_lineage(components(stars.unionByName(_links(left, texts, classes, width, num, den))), "roots")
    used_up(shared, first, links, left)
    return _with_ids(rows, classes, roots)


def _sets_of(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The whole sets that occur in pairs, from one text of each.

    A filter of fixed size picks the texts in the scan, so only sets that are wanted, and a few
    that the filter lets through, are shuffled to be matched with the exact list. It passes the
    first id of a class or, where all rows of a class have a null id, the key of its set.
    """
    keys = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    wanted = cut_lineage(
        classes.select("key", "first_id").join(keys, F.col("key") == F.col("k"), "left_semi"), "wanted-sets"
    )
    passes = texts.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(F.coalesce("first_id", "key"))))
    found = texts.mapInArrow(_sets(width, passes), "key long, own binary")
    right = wanted.select(F.col("key").alias("k")).hint("shuffle_hash")
    return found.join(right, F.col("key") == F.col("k"), "left_semi").dropDuplicates(["key"])


def _chain() -> Window:
    return Window.partitionBy("token").orderBy(F.xxhash64("key", F.pmod("token", F.lit(ORDERS))), "key")


def _chained(shared: DataFrame, num: int, den: int) -> DataFrame:
    met = F.array(*[F.lag(F.struct("key", "n", "pos"), k).over(_chain()) for k in range(1, REACH + 1)])
    pairs = shared.repartition("token").select("key", "n", "pos", met.alias("met")).select(
        "key", "n", "pos", F.inline("met").alias("key2", "n2", "pos2")
    )
    return _pairs(pairs.where(F.col("key2").isNotNull() & _may_link("n", "pos", "n2", "pos2", num, den)))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"), (F.col("n") + F.col("n2")).alias("n_both")
    ).distinct()


def _few_bits_apart(x: str, y: str, n_both: Column, num: int, den: int) -> Column:
    """Suffix filter: the parity bits of two sets don't differ in more than a link allows."""
    most = n_both - 2 * F.ceil(n_both * num / (num + den) - F.lit(1e-9))
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return apart <= most


def _close(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    bits = classes.select("key", "parity")
    return (
        pairs.join(bits.select(F.col("key").alias("a"), F.col("parity").alias("pa")), "a")
        .join(bits.select(F.col("key").alias("b"), F.col("parity").alias("pb")), "b")
        .where(_few_bits_apart("pa", "pb", F.col("n_both"), num, den))
        .select("a", "b")
    )


def _across(shared: DataFrame, roots: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a group whose sets are in different components, by bands of set size."""
    group = Window.partitionBy("token")
    # A little wider than the ratio of two sizes that may link, so that rounding moves none out.
    width = float(np.log(den / num)) * (1 + 1e-6)
    split = cut_lineage(
        shared.join(roots, F.col("key") == F.col("member"), "left")
        .select("token", "key", "n", "pos", F.coalesce("root", "key").alias("root"))
        .repartition("token")
        .withColumn("low", F.min("root").over(group))
        .withColumn("high", F.max("root").over(group))
        .where("low != high")
        .select("token", "key", "n", "pos", "root", F.floor(F.log(F.col("n")) / width).alias("band")),
        "split-groups",
    )
    # The larger set of a pair is in the band of the smaller one or the next.
    near = F.array(F.col("band"), F.col("band") + 1)
    small = split.select(
        *[F.col(c).alias(f"{c}2") for c in ("token", "key", "n", "pos", "root")], F.explode(near).alias("band2")
    )
    # Groups and bands in which only one component is left have nothing to compare.
    placed = (
        small.groupBy(F.col("token2").alias("token"), F.col("band2").alias("band"))
        .agg(F.min("root2").alias("low"), F.max("root2").alias("high")).where("low != high")
    )
    placed = cut_lineage(placed.select(F.col("token").alias("t"), F.col("band").alias("b")), "mixed-bands")
    bits = classes.select(F.col("key").alias("k"), "parity")
    live = split.join(placed, (F.col("token") == F.col("t")) & (F.col("band") == F.col("b")), "left_semi")
    live = cut_lineage(live.join(bits, F.col("key") == F.col("k")).drop("k"), "live-large")
    less = small.join(placed, (F.col("token2") == F.col("t")) & (F.col("band2") == F.col("b")), "left_semi")
    less = cut_lineage(less.join(bits, F.col("key2") == F.col("k")).drop("k").withColumnRenamed("parity", "parity2"), "live-small")
    met = live.join(
        less,
        (F.col("token") == F.col("token2"))
        & (F.col("band") == F.col("band2"))
        & (F.struct("n", "key") > F.struct("n2", "key2"))
        & (F.col("root") != F.col("root2"))
        & _may_link("n", "pos", "n2", "pos2", num, den)
        & _few_bits_apart("parity", "parity2", F.col("n") + F.col("n2"), num, den),
    )
    return _pairs(met).select("a", "b")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs at the threshold, one exact comparison each.

    Both sides of a pair take their sets from one and the same shuffle.
    """
    sets = _sets_of(pairs, texts, classes, width)
    return (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("xa")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("own").alias("xb")), "b")
        .select("a", "b", "xa", "xb")
        .mapInArrow(_verified(num, den), "a long, b long")
    )


def _with_ids(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    ids = classes.select("key", "first_id")
    linked = roots.join(ids, F.col("member") == F.col("key"))
    named = cut_lineage(linked.groupBy("root").agg(F.min("first_id").alias("named")), "named")
    linked = cut_lineage(roots.join(named, "root").select("member", "named", "root"), "linked")
    final = cut_lineage(
        classes.join(linked, F.col("key") == F.col("member"), "left").select(
            F.col("key").alias("k"), F.col("n").alias("m"), F.coalesce("named", "first_id").alias("component_id"),
            F.coalesce("root", "key").alias("root"),
        ),
        "final-classes",
    )
    some = rows.where("n > 0").select("doc_id", "n", "key").join(final, (F.col("key") == F.col("k")) & (F.col("n") == F.col("m")))
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "key", F.col("key").alias("root"))
    return some.select("doc_id", "n", "component_id", "key", "root").unionByName(none).withColumnRenamed("n", "n_shingles")


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys = [set_key(shingle_set(text, width, known)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(keys, pa.int64())], names=["id", "hash", "own"]
            )

    return run


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, one whose doc_id is the smallest there, with all columns.

    Rows are judged each by its own text: if a doc_id repeats with unlike texts, each of them
    stays or goes with its component. Of texts without n-grams each doc_id keeps one; rows with
    a null doc_id stay.
    """
    found = cut_lineage(_classed(docs, width, num, den), "classed")
    repeats = cut_lineage(
        found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"),
        "repeated-ids",
    )
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
    if repeats.isEmpty():
        return docs.join(cut_lineage(gone, "near-copies"), docs["doc_id"] == F.col("__gone"), "left_anti")
    # A doc_id that repeats is judged apart, row by row.
    gone = cut_lineage(gone.unionByName(repeats.select(F.col("__id").alias("__gone"))).distinct(), "near-copies")
    kept = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    text = F.col("text").cast("binary")
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(text).alias("__hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    keys = texts.join(repeats, F.col("id") == F.col("__id"), "left_semi").mapInArrow(_keys(width), "id long, hash long, own long")
    first = found.where("doc_id = component_id").select("doc_id", "key", "root").distinct()
    first = first.join(repeats, F.col("doc_id") == F.col("__id"), "left_semi")
    stay = cut_lineage(
        keys.distinct().join(first, (F.col("id") == F.col("doc_id")) & (F.col("own") == F.col("key"))).select("id", "hash", "root"),
        "first-of-components",
    )
    one = Window.partitionBy("id", "root").orderBy(F.xxhash64("__row"))
    single = packed.join(stay, (F.col("__doc") == F.col("id")) & (F.col("__hash") == F.col("hash")))
    single = single.withColumn("__at", F.row_number().over(one)).where("__at = 1")
    return kept.unionByName(single.select("__row.*"))

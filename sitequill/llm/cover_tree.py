"""Near-duplicate vectors: a cover tree per label and a dual traversal of it.

Vectors are unit vectors, so a cosine of at least c is a distance of at most sqrt(2 - 2c). The
tree has two parts. The upper levels are built by Spark: a node of more than NODE points is
split among a few of its points, each child has a centre and a covering radius, and pairs of nodes
descend together, dropped when their centres are farther apart than both radii and the threshold.
Leaves of at most NODE points become blocks. In a task, each block gets nested levels with halving
radii, and a pair of blocks is traversed the same way; pairs of nodes that lie within the threshold
as a whole are linked without comparing members, leaves are compared exactly.

A pair of blocks gives link counts per point and a forest of links, not all pairs. Equal vectors
of a label are one point with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut_lineage

#: Points of a block, children of a node, points of a leaf in a task, rounds of splitting.
NODE = 1024
FAN = 8
LEAF = 48
ROUNDS = 24
#: Distances are rounded; bounds keep this margin and comparisons inside it are done again.
MARGIN = 1e-9


def _matrix(values: list) -> np.ndarray:
    return np.array(values, dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


# --- upper levels ----------------------------------------------------------------------------


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each point to the nearest pivot of its node."""
    for batch in batches:
        nodes, distances = [], []
        for node, vec, pivots in zip(*(batch.column(c).to_pylist() for c in ("node", "vec", "pivots")), strict=True):
            if pivots is None:
                nodes.append(node)
                distances.append(None)
                continue
            away = np.linalg.norm(_unit(_matrix(pivots)) - _unit(_matrix(vec)), axis=1)
            best = int(away.argmin())
            nodes.append(f"{node}.{best}")
            distances.append(float(away[best]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("copies"), batch.column("vec"), pa.array(nodes, pa.string()), pa.array(distances, pa.float64())],
            names=["id", "copies", "vec", "node", "away"],
        )


def _near(reach: float):
    """Pairs of nodes whose bounds allow a link; a node without a centre allows all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, ca, cb, ra, rb in _columns(batch):
                if ca is None or cb is None or a == b or np.linalg.norm(_unit(_matrix(ca)) - _unit(_matrix(cb))) <= ra + rb + reach + MARGIN:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in kept], pa.string()), pa.array([b for _, b in kept], pa.string())], names=["a", "b"]
            )

    return run


def _descend(pairs: DataFrame, kids: DataFrame, reach: float) -> DataFrame:
    left, right = (
        kids.select(F.col("parent").alias(f"p{s}"), F.col("node").alias(f"n{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}"))
        for s in "12"
    )
    both = pairs.join(left, F.col("a") == F.col("p1")).join(right, F.col("b") == F.col("p2"))
    both = both.where((F.col("a") != F.col("b")) | (F.col("n1") <= F.col("n2")))
    return cut_lineage(
        both.select("n1", "n2", "c1", "c2", "r1", "r2").mapInArrow(_near(reach), "a string, b string"), "node-pairs"
    )


def _upper(points: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Points with their leaf, and the pairs of leaves that may hold links."""
    nodes = points.select("node").distinct()
    pairs = cut_lineage(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")), "node-pairs")
    known = nodes.select("node", F.lit(None).cast(points.schema["vec"].dataType).alias("centre"), F.lit(None).cast("double").alias("radius"))
    known = cut_lineage(known, "nodes")
    for level in range(ROUNDS):
        sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        big = cut_lineage(sizes.where(F.col("n") > NODE).select(F.col("node").alias("whole"), "n"), "large-nodes")
        if big.isEmpty():
            break
        # A sample of about 4 FAN points of each node by hash; FAN of them become its children.
        order = F.xxhash64(F.lit(level), "id")
        share = (order / F.lit(2.0**64) + F.lit(0.5)) * F.col("n") < 4 * FAN
        sample = points.join(big, F.col("node") == F.col("whole")).where(share).select("node", "vec", order.alias("order"))
        ranked = sample.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("order"))).where(F.col("rank") <= FAN)
        pivots = cut_lineage(
            ranked.groupBy(F.col("node").alias("whole")).agg(F.collect_list("vec").alias("pivots")).where(F.size("pivots") > 1), "pivots"
        )
        schema = f"id long, copies long, vec {points.schema['vec'].dataType.simpleString()}, node string, away double"
        moved = points.join(pivots, F.col("node") == F.col("whole"), "left").select("id", "copies", "vec", "node", "pivots")
        moved = cut_lineage(moved.mapInArrow(_assigned, schema), "points")
        radii = moved.where("away is not null").groupBy("node").agg(F.max("away").alias("radius"))
        parent, place = F.regexp_extract("node", r"^(.*)\.(\d+)$", 1), F.regexp_extract("node", r"^(.*)\.(\d+)$", 2)
        fresh = radii.select("node", "radius", parent.alias("parent"), place.cast("int").alias("place")).join(
            pivots, F.col("parent") == F.col("whole")
        ).select("parent", "node", F.get("pivots", "place").alias("centre"), "radius")
        same = known.join(pivots, F.col("node") == F.col("whole"), "left_anti").select(F.col("node").alias("parent"), "node", "centre", "radius")
        kids = cut_lineage(fresh.unionByName(same), "nodes")
        pairs = _descend(pairs, kids, reach)
        points, known = moved.select("id", "copies", "vec", "node"), kids.select("node", "centre", "radius")
    # What could not be split by distance is dealt to blocks by hash, under the same bounds.
    sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("node").alias("leaf"), F.ceil(F.col("n") / NODE).alias("blocks")
    )
    sizes = cut_lineage(sizes, "leaf-sizes")
    block = lambda number: F.concat("node", F.lit("#"), number.cast("string"))
    leaves = known.join(sizes, F.col("node") == F.col("leaf")).select(
        F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), "node", "centre", "radius"
    )
    leaves = cut_lineage(leaves.select("parent", block(F.col("k")).alias("node"), "centre", "radius"), "blocks")
    points = points.join(sizes, F.col("node") == F.col("leaf")).select(
        "id", "copies", "vec", block(F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("node")
    )
    return points, _descend(pairs, leaves, reach)


# --- levels inside a block -------------------------------------------------------------------


class Tree:
    """Nested levels with halving radii over the rows of a matrix of unit vectors.

    Nodes are rows of arrays: centre, covering radius, first and last child, and the members as
    a stretch of `order`.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.x = x
        self.nodes: list[list] = []
        self._node(0, len(x), 0)
        level = 0
        while level < len(self.nodes):
            self._split(level)
            level += 1

    def _node(self, start: int, end: int, centre: int) -> None:
        away = np.linalg.norm(self.x[self.order[start:end]] - self.x[centre], axis=1)
        self.nodes.append([centre, float(away.max()), start, end, 0, 0])

    def _split(self, i: int) -> None:
        centre, radius, start, end, _, _ = self.nodes[i]
        if end - start <= LEAF or radius <= MARGIN:
            return
        left, parts, picked = self.order[start:end], [], centre
        while len(left):
            near = np.linalg.norm(self.x[left] - self.x[picked], axis=1) <= radius / 2
            parts.append((picked, left[near]))
            left = left[~near]
            if len(parts) > (end - start) // 4:
                return  # the next level would hold about as many nodes as points: a leaf
            if len(left):
                picked = int(left[0])
        if len(parts) < 2:
            return
        first, at = len(self.nodes), start
        for picked, own in parts:
            self.order[at : at + len(own)] = own
            self._node(at, at + len(own), picked)
            at += len(own)
        self.nodes[i][4:] = [first, len(self.nodes)]


def linked(x: Tree, y: Tree, raw_x: np.ndarray, raw_y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) with the cosine, by a dual traversal; i < j if both trees are the same."""
    reach = (2 - 2 * cosine) ** 0.5
    found_i, found_j, waiting = [], [], [(0, 0)]
    while waiting:
        a, b = waiting.pop()
        ca, ra, sa, ea, fa, la = x.nodes[a]
        cb, rb, sb, eb, fb, lb = y.nodes[b]
        apart = float(np.linalg.norm(x.x[ca] - y.x[cb]))
        if apart > ra + rb + reach + MARGIN:
            continue
        if apart + ra + rb < reach - MARGIN:
            i, j = (g.ravel() for g in np.meshgrid(x.order[sa:ea], y.order[sb:eb], indexing="ij"))
        elif not la and not lb:
            i, j = _compared(x, y, raw_x, raw_y, x.order[sa:ea], y.order[sb:eb], cosine)
        else:
            if la and (not lb or ra >= rb):
                waiting.extend((c, b) for c in range(fa, la))
            else:
                waiting.extend((a, c) for c in range(fb, lb))
            continue
        if same:
            i, j = i[i < j], j[i < j]
        found_i.append(i)
        found_j.append(j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def _compared(x: Tree, y: Tree, raw_x, raw_y, rows: np.ndarray, columns: np.ndarray, cosine: float):
    cosines = x.x[rows] @ y.x[columns].T
    i, j = np.nonzero(cosines >= cosine - MARGIN)
    unsure = np.nonzero(np.abs(cosines[i, j] - cosine) <= MARGIN)[0]
    wrong = [
        k for k in unsure
        if (u := raw_x[rows[i[k]]]) @ (v := raw_y[columns[j[k]]]) / ((u @ u) ** 0.5 * (v @ v) ** 0.5) < cosine
    ]
    i, j = np.delete(i, wrong), np.delete(j, wrong)
    return rows[i], columns[j]


def _traversed(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, tuple] | None = None
        for batch in batches:
            for a, b, mine, yours in _columns(batch):
                if last is None or last[0] != a:
                    last = (a, _block(mine, kind))
                ids, copies, raw, tree = last[1]
                other = last[1] if a == b else _block(yours, kind)
                i, j = linked(tree, other[3], raw, other[2], cosine, a == b)
                yield _links(ids, copies, *other[:2], i, j)

    return run


def _block(rows: dict, kind: str) -> tuple:
    raw = np.frombuffer(rows["vecs"], kind).astype(np.float64).reshape(len(rows["ids"]), -1)
    return np.array(rows["ids"], np.int64), np.array(rows["copies"], np.int64), raw, Tree(_unit(raw))


def _links(ids_a, copies_a, ids_b, copies_b, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Link counts of points, and a forest that connects what the pairs connect."""
    own, inverse = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
    x, y = inverse[: len(i)], inverse[len(i) :]
    counts = np.bincount(x, copies_b[j], len(own)) + np.bincount(y, copies_a[i], len(own))
    root = np.arange(len(own))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            break
    return pa.RecordBatch.from_arrays(
        [pa.array(own), pa.array(counts.astype(np.int64)), pa.array(own[root])], names=["id", "links", "root"]
    )


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [
                {"ids": [r["id"] for r in rows], "copies": [r["copies"] for r in rows], "vecs": np.array([r["vec"] for r in rows], kind).tobytes()}
                for rows in batch.column("rows").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(blocks, pa.struct([("ids", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vecs", pa.binary())]))],
                names=["node", "block"],
            )

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and they have the same length.
    Those that are null, zero or hold null or non-finite components link with nothing, nor do
    rows with a null vec_id. component_id is the smallest vec_id reachable by links; kept says
    that it is the row's own. Rows that repeat a vec_id count as vectors of their own, n_links
    counts rows. Other columns are ignored; an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    vec = F.col("embedding") if element == "float" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), vec.alias("vec"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
        & F.coalesce(F.forall("vec", finite), F.lit(False)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    )
    # Names of nodes grow by a dot and a number, so a label stands in them as a hash.
    group = F.concat_ws("/", F.sha2(F.col("label").cast("string").cast("binary"), 256), F.size("vec").cast("string"))
    keyed = cut_lineage(
        rows.select("vec_id", F.when(usable, F.xxhash64("label", "vec")).alias("id"), F.when(usable, group).alias("node"), F.when(usable, F.col("vec")).alias("vec")),
        "vectors",
    )
    points = cut_lineage(
        keyed.where("id is not null").groupBy("id").agg(
            F.count(F.lit(1)).alias("copies"), F.any_value("vec").alias("vec"), F.any_value("node").alias("node"), F.min("vec_id").alias("first_id")
        ),
        "points",
    )
    leaves, pairs = _upper(points.select("id", "copies", "vec", "node"), (2 - 2 * cosine) ** 0.5)
    blocks = cut_lineage(
        leaves.groupBy("node").agg(F.collect_list(F.struct("id", "copies", "vec")).alias("rows"))
        .mapInArrow(_packed(kind), "node string, block struct<ids: array<bigint>, copies: array<bigint>, vecs: binary>"),
        "packed-blocks",
    )
    met = (
        pairs.join(blocks.select(F.col("node").alias("na"), F.col("block").alias("mine")), F.col("a") == F.col("na"))
        .join(blocks.select(F.col("node").alias("nb"), F.col("block").alias("yours")), F.col("b") == F.col("nb"))
        .select("a", "b", "mine", "yours")
    )
    found = cut_lineage(met.mapInArrow(_traversed(cosine, kind), "id long, links long, root long"), "links-of-blocks")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    ids = points.select("id", "copies", "first_id")
    classes = cut_lineage(
        ids.join(counts.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
        .join(roots, F.col("id") == F.col("member"), "left")
        .select("id", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")),
        "classes",
    )
    named = cut_lineage(classes.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("named")), "named")
    classes = cut_lineage(classes.join(named, F.col("root") == F.col("r")).select(F.col("id").alias("own"), "n_links", "named"), "classes")
    return keyed.select("vec_id", "id").join(classes, F.col("id") == F.col("own"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("named", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("named", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )

"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

Words and their shapes (case, digits, marks, repetition) give n-grams that are hashed into a fixed
number of buckets; the shapes carry over to words that no labelled text has. Weights are learnt
one text at a time by FTRL-Proximal updates: each bucket has its own learning rate, and those that
tell little keep a weight of zero. Learning reads a bounded sample of labelled texts, whose
features are made by all tasks and updated in one pass order, fixed by a hash. All documents are
scored in their scan with the broadcast weights; texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .shingles import mixed

#: Labelled texts that are learnt from, and passes over them.
TRAIN_ROWS = 10_000
PASSES = 2
#: Buckets of n-grams, the last for the constant.
BITS = 18
#: FTRL-Proximal: learning rate, its start, and both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
THRESHOLD = 0.7
#: Words that are hashed together, and kept in a task's memory.
STRETCH = 1 << 16
CACHE_WORDS = 300_000
_WORD = re.compile(r"\w+|[^\w\s]+")
#: Odd multipliers of the places in an n-gram, one list for words and one for shapes.
_PLACES = [[np.uint64(xxhash.xxh3_64_intdigest(b"place", seed=10 * kind + i) | 1) for i in range(3)] for kind in (1, 2)]
#: Lengths of n-grams of words and of shapes.
_GRAMS = ((1, 2), (1, 2, 3))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shape_of(word: str) -> str:
    """Marks as they are, up to three; for other words the case, and whether there are digits."""
    if not (word[0].isalnum() or word[0] == "_"):
        return word[:3]
    case = "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a" if word[0].islower() else ""
    return case + ("0" if any(map(str.isdigit, word)) else "") + ("+" if len(word) > 20 else "")


class _Words(dict):
    """Hash of a word, above that of its shape in 16 bits; kept for words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        value = self[word] = own >> 16 << 16 | xxhash.xxh32_intdigest(shape_of(word).encode("utf-8", "surrogatepass")) & 0xFFFF
        return value


def _buckets(codes: np.ndarray, carried: int) -> np.ndarray:
    """Buckets of the n-grams that end after the first `carried` words."""
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    words, shapes = codes >> np.uint64(16), codes & np.uint64(0xFFFF)
    # A word said twice running has a shape of its own, whatever the word.
    shapes = np.where(again, np.uint64(1 << 20), shapes)
    found = []
    for kind, values in enumerate((words, shapes)):
        for n in _GRAMS[kind]:
            total = np.full(max(0, len(codes) - n + 1), kind * 10 + n, np.uint64)
            for i in range(n if len(total) else 0):
                total = total + values[i : len(codes) - n + 1 + i] * _PLACES[kind][i]
            found.append(total[max(0, carried - n + 1) :])
    return (mixed(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, and values: roots of their shares, so that the norm is 1.

    Very long texts are read in stretches. The next one gets the last three words: two for its n-grams, one
    more to tell whether the first of these says its predecessor again.
    """
    words = map(known.__getitem__, map(re.Match.group, _WORD.finditer(text or "")))
    parts, last = [], []
    while own := list(islice(words, STRETCH)):
        codes = np.fromiter(chain(last, own), np.uint64, len(last) + len(own))
        parts.append(np.unique(_buckets(codes, len(last)), return_counts=True))
        last = codes[-3:].tolist()
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    at, counts = parts[0]
    if len(parts) > 1:
        totals = np.zeros(1 << BITS, np.int64)
        for some, own in parts:
            totals[some] += own
        at = np.nonzero(totals)[0]
        counts = totals[at]
    return at, np.sqrt(counts / counts.sum())


# --- learning ------------------------------------------------------------------------------


class Ftrl:
    """Logistic regression by FTRL-Proximal; bucket `1 << BITS` is the constant."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, rate = self.z[at], (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, 1 << BITS), np.append(values, 1.0)
        w = self.weights(at)
        slope = (probability(float(w @ values)) - label) * values
        n = self.n[at]
        sigma = (np.sqrt(n + slope * slope) - np.sqrt(n)) / ALPHA
        self.z[at] += slope - sigma * w
        self.n[at] = n + slope * slope


def probability(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the labelled texts."""
    known = _Words()
    for batch in batches:
        ids, labels, orders, texts = (c.to_pylist() for c in batch.columns)
        found = [features(t, known) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(orders, pa.int64()),
                pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
            ],
            names=["labelled", "quality", "text_order", "at", "value"],
        )


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model from all rows, in their order; at most TRAIN_ROWS come in for each pass."""
    model, seen = Ftrl(), set()
    for batch in batches:
        for label, at, values in zip(batch.column("quality").to_pylist(), batch.column("at"), batch.column("value"), strict=True):
            model.learn(at.values.to_numpy().astype(np.int64), values.values.to_numpy().astype(float), label)
            seen.add(label)
    weights = model.weights() if len(seen) == 2 else np.zeros_like(model.z)
    at = np.nonzero(weights)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weights[at], pa.float64())], names=["at", "weight"])


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from at most TRAIN_ROWS labelled texts that are not held out, chosen by a hash of doc_id.

    Null labels and labels other than 0 and 1 are ignored, as are labels without a document. Of
    documents with several labels each label counts; of rows that share a doc_id one text is
    learnt from, that of the smallest hash. Without both labels all weights are zero.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = cut_lineage(
        usable.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).distinct()
        .orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(TRAIN_ROWS),
        "quality-labels",
    )
    text = F.col("text").cast("string")
    # The sample has a fixed bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_order")).join(
        F.broadcast(sample), F.col("doc_id") == F.col("labelled")
    )
    made = rows.select("labelled", "quality", "text_order", "text").mapInArrow(
        _made, "labelled long, quality int, text_order long, at array<int>, value array<float>"
    )
    one = made.groupBy("labelled", "quality").agg(F.min(F.struct("text_order", "at", "value")).alias("row"))
    one = cut_lineage(one.select("labelled", "quality", "row.at", "row.value"), "quality-features")
    passes = one.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(PASSES)])))
    passes = passes.withColumn("order", F.xxhash64("pass", "labelled"))
    order = ["pass", "order", "labelled", "quality"]
    found = passes.repartition(1).sortWithinPartitions(*order).select("quality", "at", "value").mapInArrow(_learnt, "at long, weight double")
    weights = np.zeros((1 << BITS) + 1)
    for row in found.collect():
        weights[row.at] = row.weight
    return weights


# --- scoring -------------------------------------------------------------------------------


def score(text: str | None, weights: np.ndarray, known: _Words) -> float:
    at, values = features(text, known)
    return probability(float(weights[at] @ values) + float(weights[-1]))


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = _Words(), weights.value
        for batch in batches:
            scores = [score(t, own, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def scored(docs: DataFrame, weights: np.ndarray, carry: list[str]) -> DataFrame:
    """The columns in `carry`, with the score, one row per row; a column named score can't be carried.

    Null texts count as empty; texts without words get the score of the constant, 0.5 if nothing
    was learnt. Repeated rows are scored alike. An empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(weights)
    packed = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_scored(weights), f"row {kind}, score double").select("row.*", "score")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = scored(docs, learn(docs, labels), ["doc_id"])
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

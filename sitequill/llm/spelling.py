"""Spelling variants: words one edit apart, found by a bit-sliced position index.

A vocabulary is held as bitsets, one for each (position, letter): bit v says that word v has
this letter there. A query word runs over its letters once. It keeps, for all words of the index
in parallel, the set that agrees so far without an error, and two sets that agree with one: a
letter replaced (same position) or an extra letter in the indexed word (positions shifted by one).
A missing letter is the same pair seen from the longer word.

The vocabulary grows with the corpus, so the index is cut into blocks. Of two words one edit apart,
the shorter with c letters, the edit leaves either the first c // 2 letters alone or the last
c - c // 2. Each word is dealt by these keys, and a pair is counted under the first one that holds.
A key with very many words is cut into slabs: each word is indexed in one slab and asked in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut_lineage

#: Words of the vocabulary: letters at least, and occurrences at least.
LETTERS = 5
OCCURRENCES = 3
#: In a document, a run whose checksum this number divides loses one letter.
DELETES = 97
#: Words in one slab of a key, on average; words that are indexed together.
SLAB = 8192
BLOCK = 2048
#: 64-bit numbers in one array of the recurrences, so that they stay in a core's cache.
CELLS = 1 << 15
#: Letters of the query words that are looked up together.
LOOKUPS = 1 << 20
#: Fixed value: what ends a run of letters.
_ENDS = r"[^A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(run: Column) -> Column:
    """A-Z in lower case; other capitals stay."""
    return F.when(run.rlike(r"[^A-Za-zß-ÿ]"), F.translate(run, _UPPER, _LOWER)).otherwise(F.lower(run))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words with their number of occurrences: word, n.

    Null texts have no words. In documents without an id no letter is deleted. Repeated rows
    count each time.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.split(F.col("text").cast("string"), _ENDS)).alias("run"))
    runs = runs.where(F.length("run") >= LETTERS).select("id", _lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.col("h") % F.length("run")
    shorter = F.concat(F.expr("substring(run, 1, CAST(h % length(run) AS INT))"), F.expr("substring(run, CAST(h % length(run) AS INT) + 2)"))
    word = F.when((F.col("h") % DELETES == 0) & at.isNotNull(), shorter).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


# --- near words ----------------------------------------------------------------------------


class PositionIndex:
    """Bitsets by (position, letter) of words that have `c` or `c + 1` letters."""

    def __init__(self, words: list[bytes], c: int):
        self.c = c
        self.width = max(1, -(-len(words) // 64))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        number = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = place * 256 + np.frombuffer(b"".join(words), np.uint8)
        self.codes, row = np.unique(codes, return_inverse=True)
        bits = np.zeros((len(self.codes) + 1) * self.width, np.uint64)
        np.bitwise_or.at(bits, (row + 1) * self.width + number // 64, np.uint64(1) << (number % 64).astype(np.uint64))
        #: Row 0 is the empty set, of letters that no word has there.
        self.bits = bits.reshape(-1, self.width)
        self.short, self.long = (self._set(np.nonzero(lengths == n)[0]) for n in (c, c + 1))

    def _set(self, numbers: np.ndarray) -> np.ndarray:
        found = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(found, numbers // 64, np.uint64(1) << (numbers % 64).astype(np.uint64))
        return found

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + 1, 0)

    def near(self, asked: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of asked words, which have `c` letters, and of indexed words one edit away."""
        step = max(1, min(CELLS // self.width, LOOKUPS // self.c))
        for first in range(0, len(asked), step):
            some = asked[first : first + step]
            letters = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), self.c)
            here = np.arange(self.c) * 256 + letters
            same, shifted = self._rows(here), self._rows(here + 256)
            clean = np.full((len(some), self.width), ~np.uint64(0))
            replaced, longer = np.zeros_like(clean), np.zeros_like(clean)
            for i in range(self.c):
                agree = self.bits[same[:, i]]
                longer |= clean
                longer &= self.bits[shifted[:, i]]
                replaced &= agree
                agree &= clean
                clean ^= agree
                replaced |= clean
                clean = agree
            longer |= clean
            found = (replaced & self.short) | (longer & self.long)
            q, w = np.nonzero(found)
            bit = np.unpackbits(found[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, number = np.nonzero(bit)
            yield q[at] + first, w[at] * 64 + number


class _Block:
    """Whole keys, or slabs of one, that are indexed together and asked afterwards."""

    def __init__(self, c: int):
        self.c = c
        self.words: list[bytes] = []
        self.n, self.group, self.start, self.suffix = [], [], [], []
        self.index: PositionIndex | None = None

    def add(self, word: bytes, n: int, group: int, start: int, suffix: bool) -> None:
        self.words.append(word)
        self.n.append(n)
        self.group.append(group)
        self.start.append(start)
        self.suffix.append(suffix)

    def columns(self) -> tuple[np.ndarray, ...]:
        return np.array(self.n, np.int64), np.array(self.group, np.int64), np.array(self.start, np.int64), np.array(self.suffix, bool)


def _best(word: list[bytes], other: list[bytes], q: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[list, ...]:
    """For each asked number: its word, number of others, and the other of largest n, the smallest of equal ones."""
    rank = np.empty(len(other), np.int64)
    rank[sorted(range(len(other)), key=other.__getitem__)] = np.arange(len(other))
    order = np.lexsort((rank[x], -n[x], q))
    q, x = q[order], x[order]
    first = np.nonzero(np.concatenate(([True], q[1:] != q[:-1])))[0]
    sizes = np.diff(np.concatenate((first, [len(q)])))
    return [word[i] for i in q[first].tolist()], sizes.tolist(), n[x[first]].tolist(), [other[i] for i in x[first].tolist()]


def _answers(index: _Block, asked: _Block) -> Iterator[pa.RecordBatch]:
    """Partial counts and best others of the asked words and, for longer words, of the indexed ones."""
    n, group, start, suffix = index.columns()
    qn, qgroup, qstart, _ = asked.columns()
    longer = np.fromiter(map(len, index.words), np.int64, len(index.words)) > index.c
    for q, x in index.index.near(asked.words):
        # A pair that shares both keys counts under its beginning.
        own = (qgroup[q] == group[x]) & ~(suffix[x] & (qstart[q] == start[x]))
        q, x = q[own], x[own]
        parts = []
        if len(q):
            parts.append(_best(asked.words, index.words, q, x, n))
        back = longer[x]
        if back.any():
            parts.append(_best(index.words, asked.words, x[back], q[back], qn))
        for words, sizes, best_n, best in parts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(sizes, pa.int64()),
                    pa.array(best_n, pa.int64()), pa.array([w.decode("latin-1") for w in best], pa.string()),
                ],
                names=["word", "near", "best_n", "best"],
            )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by letters, key and slab; in a slab its own words come first."""
    block, asked, now, number = None, None, None, -1
    asks_later = False

    def answered():
        if block is not None and block.words:
            if block.index is None:
                block.index = PositionIndex(block.words, block.c)
            if asked.words:
                yield from _answers(block, asked)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for c, key, slab, own, asks, suffix, start, word, n in zip(*columns, strict=True):
            if (c, key, slab) != now:
                if block is None or c != block.c or len(block.words) >= BLOCK or asks_later:
                    yield from answered()
                    block, asked, asks_later = _Block(c), _Block(c), False
                now, number = (c, key, slab), number + 1
            word = word.encode("latin-1")
            if own:
                block.add(word, n, number, start, suffix)
            else:
                asks_later = True
            if asks:
                asked.add(word, n, number, start, suffix)
            if asks_later and len(asked.words) >= BLOCK:
                yield from answered()
                asked = _Block(c)
    yield from answered()


def near_words(words: DataFrame) -> DataFrame:
    """For each word with a near word: word, near (their number), best_n and best (the most frequent one).

    `words` is a written table of distinct word and n.
    """
    length = F.length("word")

    def key(c: Column, asks: bool, suffix: bool) -> Column:
        half = F.floor(c / 2).cast("int")
        part = F.expr("right(word, %s)" % ("length(word) - length(word) div 2" if asks else "length(word) - 1 - (length(word) - 1) div 2")) if suffix else F.left("word", half)
        return F.struct(
            c.alias("c"), F.xxhash64(c, F.lit(suffix), part).alias("key"), F.lit(asks).alias("asks"),
            F.lit(suffix).alias("suffix"), F.xxhash64(F.left("word", half)).alias("start"),
        )

    keys = F.array(*[key(length if asks else length - 1, asks, suffix) for asks in (True, False) for suffix in (False, True)])
    dealt = words.select("word", "n", F.inline(keys)).where(F.col("c") >= LETTERS)
    large = cut_lineage(
        dealt.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SLAB)
        .select(F.col("key").alias("large"), F.ceil(F.col("rows") / SLAB).cast("int").alias("slabs")),
        "large-keys",
    )
    slabs = F.coalesce("slabs", F.lit(1))
    own = F.pmod(F.xxhash64("word"), slabs).cast("int")
    rows = (
        dealt.join(large, F.col("key") == F.col("large"), "left")
        .withColumn("own", own)
        .withColumn("slab", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), slabs - 1)).otherwise(F.array("own"))))
        .select("c", "key", "slab", (F.col("own") == F.col("slab")).alias("own"), "asks", "suffix", "start", "word", "n")
    )
    sorted_rows = rows.repartition("c", "key", "slab").sortWithinPartitions("c", "key", "slab", F.desc("own"))
    found = sorted_rows.mapInArrow(_near, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), first.alias("first")).select(
        F.col("word").alias("of"), "near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")
    )


# --- forms and roots -----------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(of, root): forms followed to the last, by joining the table of (of, at) with itself.

    n at least doubles at each form, so paths are short and no circle exists; each round doubles
    the steps.
    """
    while True:
        seen = Observation()
        far = forms.select(F.col("of").alias("via"), F.col("at").alias("far"))
        moved = (
            forms.join(far, F.col("at") == F.col("via"), "left")
            .observe(seen, F.count("far").alias("moved"))
            .select("of", F.coalesce("far", "at").alias("at"))
        )
        forms = cut_lineage(moved, "roots")
        if not seen.get["moved"]:
            return forms.select(F.col("of").alias("rooted"), F.col("at").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """Per word of the vocabulary: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters with A-Z lower-cased, of LETTERS code points and
    OCCURRENCES occurrences at least. The form is the near word of largest n, the smallest of
    equal ones, if that n is at least twice the word's; the root is reached by following forms.
    Null, empty and other texts without letters add no word; words of any length are compared
    whole; other columns are ignored; an empty table gives no rows.
    """
    words = cut_lineage(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    near = near_words(words)
    rows = words.join(near, F.col("word") == F.col("of"), "left")
    has = F.col("best_n") >= 2 * F.col("n")
    found = cut_lineage(
        rows.select(
            "word", F.when(has, F.col("best")).alias("form"), "n",
            F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form is not null").select(F.col("word").alias("of"), F.col("form").alias("at")))
    return found.join(roots, F.col("word") == F.col("rooted"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Packing tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths reaches the driver: at most LENGTH counts. There, few-piece
patterns that fill a sequence are enumerated over bins of lengths, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left goes
best fit, longest first, into the room that patterns leave and into new sequences. The plan says
which numbers of pieces of a length go where; pieces are numbered within their length by counts
of hash ranges, never in one task, and look their place up in the plan. Where the order of the
documents counts, pieces are numbered by the place of their document instead, and sequences by
their first piece.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from string import punctuation
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ranked, stretches

LENGTH = 4096
END = 1
#: Width of a bin of lengths and most pieces in a pattern, for the least-squares fit.
BIN = 32
PARTS = 3
#: Words whose ids a task keeps, new words that are encoded in one text.
CACHE_WORDS = 300_000
TOGETHER = 256
#: Bits for the number of a row in its file and of a file in its task, and rows of a file whose
#: pieces are numbered together.
ROW_BITS = 36
FILE_BITS = 6
STRETCH = 1 << 14

_PIECES = "doc_id long, piece int, start long, length long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of words as little-endian 32-bit numbers, kept for words seen lately.

    This vocabulary splits at white space and drops it, so a text's ids are those of its words.
    A word of plain letters is one pre-token, and only the last token of a pre-token carries the
    end-of-word mark: many new words are encoded in one text and cut apart there. Punctuation
    after the letters is a pre-token of its own; any other word is encoded alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def of(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words."""
        new = {w for words in texts for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = {w for words in texts for w in words}
        self._learn(new)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in texts]

    def _learn(self, new: set[bytes]) -> None:
        cut = []
        for word in new:
            text = word.decode()
            letters = text.rstrip(punctuation)
            if letters.isalpha() and (letters.isascii() or (max(letters) < "\u0250" and "\u0130" not in letters)):
                cut.append((word, letters.lower(), text[len(letters) :]))
            else:
                self.words[word] = self._alone(text)
        if len(self.letters) + len(cut) > CACHE_WORDS:
            self.letters.clear()
        self._learn_letters(sorted({x for _, x, _ in cut if x not in self.letters}))
        for word, letters, marks in cut:
            if marks not in self.marks:
                if len(self.marks) >= CACHE_WORDS:
                    self.marks = {"": b""}
                self.marks[marks] = self._alone(marks)
            self.words[word] = self.letters[letters] + self.marks[marks]

    def _learn_letters(self, new: list[str]) -> None:
        parts = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
        for part, found in zip(parts, encoded, strict=True):
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or (len(stops) and stops[-1] != len(ids)):
                raise ValueError("the vocabulary doesn't mark ends of words")
            data, at = ids.tobytes(), 0
            for word, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.letters[word] = data[at:stop]
                at = stop

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _tokenised(path: str, length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(path)
        last = np.array([END], "<u4").tobytes()
        for batch in batches:
            for start, end in stretches(batch.column("text")):
                part = batch.slice(start, end - start)
                texts = [text.split() if text else [] for text in part.column("text").to_pylist()]
                rows, owners = [], []
                for k, own in enumerate(known.of(texts)):
                    ids = own + last
                    for i, at in enumerate(range(0, len(ids), 4 * length)):
                        piece = ids[at : at + 4 * length]
                        rows.append((i, at // 4, len(piece) // 4, crc32(piece) if digest else piece))
                        owners.append(k)
                yield _batch(part.drop_columns(["text"]).take(pa.array(owners, pa.int64())), rows, digest)

    return run


def _batch(owners: pa.RecordBatch, rows: list[tuple], digest: bool) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
    doc_id, *more = owners.columns
    return pa.RecordBatch.from_arrays(
        [doc_id, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], *more],
        names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids", *owners.schema.names[1:]],
    )


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, place: Column | None = None, digest: bool = False) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids (little-endian 32 bit).

    Whole texts are tokenised and closed with id END; a null text is empty and has END alone.
    Only documents beyond `length` are cut. Repeated rows give repeated pieces. A long `place` of
    the documents is handed to their pieces as a further column. With `digest` the checksum of
    the ids, `ids_crc32`, is taken where they are made, and the ids stay in the task.
    """
    own = [] if place is None else [place.alias("place")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *own)
    kind = _PIECES + (", ids_crc32 long" if digest else ", ids binary") + ", place long" * len(own)
    return texts.mapInArrow(_tokenised(path or tokenizer_path(), length, digest), kind)


# --- the plan ------------------------------------------------------------------------------


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the smallest |a x - b|: an active set grows by the steepest column."""
    x = np.zeros(a.shape[1])
    active: list[int] = []
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active.append(best)
        while active:
            z = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[active] = z
                break
            old = x[active]
            low = z <= 1e-12
            step = (old[low] / np.maximum(old[low] - z[low], 1e-300)).min()
            moved = old + step * (z - old)
            x[:] = 0
            x[active] = np.maximum(moved, 0)
            kept = [i for i, m in zip(active, moved, strict=True) if m > 1e-12]
            if len(kept) == len(active):
                kept.remove(min(active, key=lambda i: x[i]))
            x[[i for i in active if i not in kept]] = 0
            active = kept
    return x


@cache
def patterns(total: int, parts: int, most: int | None = None) -> tuple[tuple[int, ...], ...]:
    """All descending tuples of at most `parts` positive numbers with this sum."""
    most = total if most is None else most
    if total == 0:
        return ((),)
    if parts == 0:
        return ()
    return tuple(
        (first, *rest)
        for first in range(min(total, most), 0, -1)
        for rest in patterns(total - first, parts - 1, first)
    )


def fitted(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of bins and how often each is used, within the supply."""
    bins = -(-length // BIN)
    supply = np.zeros(bins + 1)
    for size, n in counts.items():
        supply[-(-size // BIN)] += n
    found = patterns(bins, PARTS)
    a = np.zeros((bins + 1, len(found)))
    for j, pattern in enumerate(found):
        for size in pattern:
            a[size, j] += 1
    scale = max(1.0, supply.max())
    x = nonnegative_least_squares(a, supply / scale) * scale
    left = supply.astype(np.int64)
    used = []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        need = a[:, j].astype(np.int64)
        times = min(int(x[j]), *(left[need > 0] // need[need > 0]))
        if times > 0:
            left -= times * need
            used.append((found[j], int(times)))
    return used


class Plan:
    """Groups of equal sequences: runs of equal lengths in each, and their number."""

    def __init__(self, counts: dict[int, int], length: int) -> None:
        self.length = length
        self.left = {size: n for size, n in counts.items() if n > 0}
        self.open: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        self.rooms: list[int] = []
        for pattern, times in fitted(self.left, length):
            self._use(pattern, times)
        for size in sorted(self.left, reverse=True):
            self._best_fit(size, self.left[size])

    def _add(self, runs: tuple[tuple[int, int], ...], times: int) -> None:
        room = self.length - sum(size * n for size, n in runs)
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((runs, times))

    def _use(self, pattern: tuple[int, ...], times: int) -> None:
        """Fill a pattern of bins with real lengths, longest first."""
        drawn = []
        for b in pattern:
            runs, need = [], times
            for size in range(min(b * BIN, self.length), (b - 1) * BIN, -1):
                n = min(need, self.left.get(size, 0))
                if n:
                    runs.append([size, n])
                    self.left[size] -= n
                    need -= n
            drawn.append(runs)
        while drawn[0]:
            n = min(runs[0][1] for runs in drawn)
            sizes: dict[int, int] = {}
            for runs in drawn:
                sizes[runs[0][0]] = sizes.get(runs[0][0], 0) + 1
                runs[0][1] -= n
                if not runs[0][1]:
                    runs.pop(0)
            self._add(tuple(sizes.items()), n)

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            at = bisect_left(self.rooms, size)
            if at == len(self.rooms):
                each = self.length // size
                if n >= each:
                    self._add(((size, each),), n // each)
                if n % each:
                    self._add(((size, n % each),), 1)
                return
            room = self.rooms[at]
            runs, times = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            each = room // size
            full = min(times, n // each)
            rest = 0
            if full:
                self._add((*runs, (size, each)), full)
            elif n:
                self._add((*runs, (size, n)), 1)
                rest, full = n, 1
            n -= rest or full * each
            if times > full:
                self._add(runs, times - full)

    def places(self) -> np.ndarray:
        """Rows (length, first number, numbers per sequence, sequence, offset), sorted."""
        rows, sequence, used = [], 0, {}
        for room in self.rooms:
            for runs, times in self.open[room]:
                offset = 0
                for size, n in runs:
                    first = used.get(size, 0)
                    rows.append((size, first, n, sequence, offset))
                    used[size] = first + n * times
                    offset += size * n
                sequence += times
        self.sequences = sequence
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        starts = (rows[:, 0] << 40) + rows[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(starts, (size << 40) + rank, "right") - 1
            _, first, each, sequence, offset = rows[at].T
            rank = rank - first
            kept = batch.drop_columns(["__rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence + rank // each), pa.array(offset + rank % each * size)],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    return run


def packed(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a column `length`.

    Sequences are gapless and at most `length` long. Lengths must lie between 1 and `length`.
    Carries all columns of the input along, so give narrow rows. An empty table stays empty.
    Pieces of one length are dealt to sequences in the order of a hash; if there is a column
    `place`, in its order, and sequences are numbered by the place of their first piece.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return found.selectExpr("*", "cast(0 as bigint) as sequence_id", "cast(0 as bigint) as offset")
    plan = spark.sparkContext.broadcast(Plan(counts, length).places())
    ordered = "place" in found.columns
    if ordered:
        numbered = ranked(found, ["length"], "place", "__rank", STRETCH, ("piece",))
    else:
        numbered = ranked(found.withColumn("__order", F.xxhash64("doc_id", "piece", "start")), ["length"], "__order", "__rank").drop("__order")
    kinds = ", ".join(f"`{c}` {k}" for c, k in found.dtypes)
    placed = numbered.mapInArrow(_placed(plan), f"{kinds}, sequence_id long, offset long")
    return _in_order(cut_lineage(placed, "placed")) if ordered else placed


def _in_order(placed: DataFrame) -> DataFrame:
    """The same sequences, numbered from 0 in the order of their first pieces."""
    first = placed.groupBy("sequence_id").agg(F.min(F.struct("place", "piece")).alias("first"))
    first = cut_lineage(first.select(F.col("sequence_id").alias("__sequence"), "first.place", "first.piece"), "first-pieces")
    numbers = ranked(first, [], "place", "__number", STRETCH, ("piece",)).select("__sequence", "__number")
    return placed.join(numbers, F.col("sequence_id") == F.col("__sequence")).select(
        *[F.col("__number").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns]
    )


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(cut_lineage(pieces(docs, path, digest=True), "pieces"))


def packed_in_order(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As packed_documents, for files whose order counts: by number of the file, then by row.

    Needs the table as it is read from its files, since the place of a row is taken from them:
    Spark numbers the files it writes as `part-<task>-...-c<file of the task>`; a file named
    otherwise comes first. Documents of one length keep their order, sequences come in the order
    of their first piece. Null texts are empty, repeated rows stay, other columns are ignored; an
    empty table gives no rows.
    """
    task, more = (F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(_metadata.file_name, '{p}', 1), '') as bigint)"), F.lit(0)) for p in (r"^part-([0-9]+)", r"[.-]c([0-9]+)[.]"))
    rows = docs.select("doc_id", "text", (task * F.lit(1 << FILE_BITS) + more).alias("__file"), F.col("_metadata.row_index").alias("__at"))
    found = pieces(rows, path, place=F.shiftleft("__file", ROW_BITS) + F.col("__at"), digest=True)
    return packed(cut_lineage(found, "pieces")).drop("place")


def sequences(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Token ids of each sequence: sequence_id, length, ids; from a written table of pieces.

    A sequence is bounded by `length` ids. Texts are not read again.
    """
    placed = packed(found.select("doc_id", "piece", "start", "length", "ids"), length)
    part = F.struct("offset", "ids")
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts")
    ).select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda t, p: F.concat(t, p["ids"])).alias("ids"))

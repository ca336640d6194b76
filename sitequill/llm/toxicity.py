"""Toxicity: fuzzy lexicon matches, weighed by their context.

The lexicon is learnt from labelled documents: words and word beginnings that mark toxic ones.
Each word of a text is matched against the lexicon's trie by a Levenshtein automaton, which
catches misspellings. Words around a match tell whether it is quoted or reported, or addressed
to somebody; a logistic regression on these counts gives the score. Scoring happens in the scan;
texts are not shuffled. Lexicon, weights and the labelled sample have fixed bounds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .lexicon_match import Matches

#: Labelled rows that are learnt from, candidate terms that are counted, terms of the lexicon.
TRAIN_ROWS = 20_000
CANDIDATES = 5_000
LEXICON = 300
#: A term stands in this share of the toxic rows at least, and this much less often in others.
SUPPORT = 0.02
RATIO = 20.0
STEMS = (4, 5, 6, 7)
#: Words on each side of a match that are its context.
WINDOW = 6
THRESHOLD = 0.3
#: Cues of reported speech, and of speech to somebody.
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes called calls termed word words term insult insults slur "
    "sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)
ADDRESSING = frozenset(
    "you your you're youre u ur yourself du dich dir dein deine ihr euch tu te toi vous votre ton ta tú ti usted vosotros".split()
)
_WORD = re.compile(r"\w+")
_OPEN, _CLOSE = "“«„", "”»"
_STRENGTH = (1.0, 0.6, 0.4)


@dataclass(frozen=True)
class Model:
    """Terms (text, is a stem) and weights of the features; no terms and weights give score 0."""

    terms: tuple[tuple[str, bool], ...] = ()
    weights: tuple[float, ...] = ()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _quoted(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks of one line; marks without a partner quote nothing."""
    found, start = [], None
    for m in re.finditer(r"[\"“”«»„\n]", text):
        c = m[0]
        if c == "\n":
            start = None
        elif start is None and c not in _CLOSE:
            start = m.start()
        elif start is not None and c not in "«„":
            found.append((start, m.start()))
            start = None
    return found


def hits_of(text: str, known: Matches) -> list[dict]:
    """Matches of a text: word number, term, edits, quoted, addressed."""
    lower = text.lower()
    words = _WORD.findall(lower)
    at = [(i, m) for i, m in enumerate(map(known.__getitem__, words)) if m]
    if not at:
        return []
    starts = [m.start() for m in _WORD.finditer(lower)]
    # Stretches come in order and don't overlap, so only the last one that opens before a word can hold it.
    marks = _quoted(lower)
    opens = [a for a, _ in marks]
    hits = []
    for i, (term, edits) in at:
        near = {*words[max(0, i - WINDOW) : i], *words[i + 1 : i + 1 + WINDOW]}
        last = bisect_left(opens, starts[i]) - 1
        inside = last >= 0 and starts[i] < marks[last][1]
        hits.append({
            "word": i, "term": term, "edits": edits,
            "quoted": inside or not near.isdisjoint(REPORTING), "addressed": not near.isdisjoint(ADDRESSING),
        })
    return hits


def features_of(hits: list[dict], n_words: int) -> list[float]:
    """Constant, strength of plain, quoted and addressed matches, distinct terms, density."""
    plain = sum(_STRENGTH[h["edits"]] for h in hits if not h["quoted"])
    quoted = sum(_STRENGTH[h["edits"]] for h in hits if h["quoted"])
    addressed = sum(_STRENGTH[h["edits"]] for h in hits if h["addressed"] and not h["quoted"])
    exact = sum(h["edits"] == 0 and not h["quoted"] for h in hits)
    return [
        1.0, np.log1p(plain), np.log1p(quoted), np.log1p(addressed), np.log1p(exact),
        float(len({h["term"] for h in hits})), np.log1p(100 * plain / max(1, n_words)),
    ]


# --- learning ------------------------------------------------------------------------------


def _terms(text: str) -> set[str]:
    """Words, and word beginnings marked by a star."""
    words = {w for w in _WORD.findall(text.lower()) if not w.isdigit()}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _counted(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = wanted.value if wanted is not None else None
        found: Counter = Counter()
        for batch in batches:
            for (text,) in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _terms(text or "")
                found.update(own & chosen if chosen is not None else own)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return run


def chosen_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """The lexicon: frequent in toxic rows and rare in others.

    A beginning is taken if it covers clearly more rows than any one word; then at its longest
    form that covers about as many rows. Terms that a taken beginning covers are left out.
    """
    least = max(3.0, SUPPORT * n_toxic)
    good = {
        t: n for t, n in toxic.items()
        if n >= least and (n + 0.5) / (n_toxic + 1) >= RATIO * (clean.get(t, 0) + 0.5) / (n_clean + 1)
    }
    words = {t for t in good if not t.endswith("*")}
    stems = []
    for t in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if any(t.startswith(s[:-1]) for s in stems):
            continue
        if good[t] <= 1.2 * max((good[w] for w in words if w.startswith(t[:-1])), default=0):
            continue
        longer = [s for s in good if s.endswith("*") and s.startswith(t[:-1]) and good[s] >= 0.97 * good[t]]
        stems.append(max(longer, key=lambda s: (len(s), s)))
    taken = [(s[:-1], True) for s in stems]
    taken += [(w, False) for w in words if not w.startswith(tuple(s[:-1] for s in stems) or ("\0",))]
    taken.sort(key=lambda x: (-good[x[0] + "*" * x[1]], x))
    return taken[:LEXICON]


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method; the first feature is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], decay)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most TRAIN_ROWS labelled rows that are not held out, chosen by a hash of doc_id.

    Null labels and labels other than 0 and 1 are ignored, as are labels without a document. Of
    documents with several labels each label counts. Without rows of both kinds the model is
    empty.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (
        usable.select(F.col("doc_id").alias("labelled"), "toxic").distinct()
        .orderBy(F.xxhash64("labelled"), "labelled", "toxic").limit(TRAIN_ROWS)
    )
    sample = cut_lineage(sample, "toxic-labels")
    rows = cut_lineage(
        docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("text", "toxic"),
        "toxic-sample",
    )
    sizes = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    total = F.sum("n").alias("n")
    toxic = {
        r.term: r["n"]
        for r in rows.where("toxic = 1").select("text").mapInArrow(_counted(None), "term string, n long")
        .groupBy("term").agg(total).where(F.col("n") >= max(3.0, SUPPORT * n_toxic)).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()
    }
    wanted = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {
        r.term: r["n"]
        for r in rows.where("toxic = 0").select("text").mapInArrow(_counted(wanted), "term string, n long").groupBy("term").agg(total).collect()
    }
    terms = tuple(chosen_terms(toxic, clean, n_toxic, n_clean))
    measured = rows.mapInArrow(_measured(terms), "toxic int, features array<double>").collect()
    x = np.array([r.features for r in measured])
    y = np.array([r.toxic for r in measured], float)
    return Model(terms, tuple(logistic(x, y)))


def _measured(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matches(terms)
        for batch in batches:
            features = [features_of(hits_of(t or "", known), len(_WORD.findall(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(features, pa.list_(pa.float64()))], names=["toxic", "features"]
            )

    return run


# --- scoring -------------------------------------------------------------------------------

_HIT = "struct<word: int, term: string, edits: int, quoted: boolean, addressed: boolean>"


def _scored(model):
    kind = pa.list_(pa.struct([("word", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("addressed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Matches(model.terms)
        weights = np.array(model.weights)
        for batch in batches:
            hits, scores = [], []
            for text in batch.column("text").to_pylist():
                own = hits_of(text or "", known)
                hits.append(own)
                if len(weights):
                    n = len(_WORD.findall(text)) if own else 0
                    scores.append(float(1 / (1 + np.exp(-np.clip(np.dot(features_of(own, n), weights), -30, 30)))))
                else:
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(hits, kind), pa.array(scores, pa.float64())], names=["row", "hits", "score"]
            )

    return run


def scored(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns in `carry`, with hits (an array of matches) and score, one row per row.

    Null texts count as empty and get the score of a text without matches. Repeated rows are
    scored alike. Columns named hits and score can't be carried.
    """
    packed = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_scored(model), f"row {kind}, hits array<{_HIT}>, score double").select("row.*", "hits", "score")


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = scored(docs, learn(docs, labels), ["doc_id"])
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is below THRESHOLD, with the columns of docs."""
    packed = docs.select(F.struct("*").alias("__row"), F.col("text"))
    return scored(packed, learn(docs, labels), ["__row"]).where(F.col("score") < THRESHOLD).select("__row.*")

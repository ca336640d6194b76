"""URL filter: rules on host and path first, then a linear model on character n-grams.

The model is a logistic regression on hashed character n-grams of host and path, fitted on a
small labelled table of URLs. The table and the weights have a fixed size, so the weights go to
the tasks by broadcast; the pages are scored in their scan and never shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path and verdict of each rule. The longest fitting rule wins.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Words of unwanted and of wanted sites, words that both use, and letters of made-up names.
UNWANTED = (
    "pills casino poker jackpot spam adult xxx warez keygen crack payday replica betting slots lottery"
    " escort hack clickbait ads prize cheap farm win loan viagra free"
).split()
WANTED = (
    "news library museum university school garden kitchen travel weather history science music forum wiki"
    " docs research hospital council archive recipes theatre railway poetry gallery blog"
).split()
NEUTRAL = "online best world hub city daily shop live top club".split()
STARTS = "b c d f g h k l m n p r s t th st tr ch".split()
ENDS = "n r s t l m nd st nt".split() + [""] * 6
OWN_PATHS = (
    "/about /guide/start /page/history /catalogue/12 /course/physics /thread/991 /exhibits /2024/05/report.html".split(),
    "/buy /order-now /bonus /click-here /crack.html /ads/redirect /free-gift /offer".split(),
)


def labelled_urls(names: int = 100, seed: int = 1) -> list[tuple[str, int]]:
    """Labelled URLs, 1 unwanted and 0 wanted: two for each of three times `names` names.

    A third of the names join unwanted words with words that both labels use, a third do so with
    wanted words, and a third are made up and wanted: a name that says nothing is no reason to
    block. Three names at a time share subdomain, domain and number, so these say nothing either.
    One path of each name is its label's, the other is a language and the number.
    """
    draw = random.Random(seed)

    def joined(words: list[str], i: int) -> str:
        word = words[i % len(words)]
        return draw.choice([
            word, f"{word}-{draw.choice(words)}", f"{draw.choice(NEUTRAL)}-{word}", f"{word}{draw.choice(NEUTRAL)}",
        ])

    rows = []
    for i in range(names):
        sub, domain = draw.choice(["", "www.", "blog.", "m."]), draw.choice(["com", "org", "net"])
        plain = f"/{draw.choice(['en', 'de', 'fr', 'es'])}/{draw.randrange(10_000)}{draw.choice(['', '/', '.html'])}"
        made_up = "".join(draw.choice(STARTS) + draw.choice("aeiou") + draw.choice(ENDS) for _ in range(draw.randint(2, 4)))
        for name, label in ((joined(UNWANTED, i), 1), (joined(WANTED, i), 0), (made_up, 0)):
            host = f"{sub}{name}.example.{domain}"
            rows += [(f"https://{host}{plain}", label), (f"http://{host}{draw.choice(OWN_PATHS[label])}", label)]
    return rows


#: What the model learns from unless a caller brings another table.
LABELLED = tuple(labelled_urls())

BITS = 14
GRAMS = (3, 4, 5)
ROUNDS = 3000
RATE = 2.0
DECAY = 1e-4


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host = rest[:cut].translate(_LOWER)
    rest = rest[cut:]
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    return host, rest[: min(ends, default=len(rest))]


_LOWER = {i: i + 32 for i in range(65, 91)}


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path, each with its own seed."""
    found = set()
    for seed, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in GRAMS:
            found.update(
                xxhash.xxh32_intdigest(text[i : i + n].encode(), seed=seed) % (1 << BITS)
                for i in range(len(text) - n + 1)
            )
    return np.fromiter(found, np.int64, len(found))


def fit(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by gradient descent; the last one is the constant.

    Features are scaled by the root of their number. The table is a parameter of a fixed, small
    size. Without both labels the weights are all zero, which allows every URL.
    """
    weights = np.zeros((1 << BITS) + 1)
    rows = [(features(*parts(url)), label) for url, label in labelled if url is not None and label is not None]
    if len({label for _, label in rows}) < 2:
        return weights
    at = np.concatenate([f for f, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    scale = 1 / np.sqrt([max(1, len(f)) for f, _ in rows])
    truth = np.array([label for _, label in rows], float)
    for _ in range(rounds):
        margin = np.bincount(row, weights[at], len(rows)) * scale + weights[-1]
        error = 1 / (1 + np.exp(-margin)) - truth
        step = np.bincount(at, (error * scale)[row], 1 << BITS) / len(rows)
        weights[:-1] -= RATE * (step + DECAY * weights[:-1])
        weights[-1] -= RATE * error.mean()
    return weights


def score(host: str, path: str, weights: np.ndarray) -> float:
    found = features(host, path)
    margin = weights[found].sum() / max(1, len(found)) ** 0.5 + weights[-1]
    return float(1 / (1 + np.exp(-margin)))


def _judged(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value
        for batch in batches:
            ids, urls = (c.to_pylist() for c in batch.columns)
            split = [parts(url) for url in urls]
            scores = [score(host, path, own) if host or path else None for host, path in split]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=["page_id", "host", "path", "score"],
            )

    return run


def _fits(host: str, path: str) -> Column:
    own = F.col("host")
    return ((own == host) | own.endswith(f".{host}")) & F.col("path").startswith(path)


def judged_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: Sequence[tuple[str, int]] = LABELLED,
    most: float = 0.5,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score.

    The longest rule that fits gives the verdict, of equally long ones the first in order of
    their text; else the model blocks a score of `most` or more. A null URL or one without
    `://` has an empty host and path, no score, and is allowed if no rule fits it. Repeated rows are judged alike;
    other columns are ignored; an empty table gives no rows. Rules and labels are small tables
    given by the caller.
    """
    weights = pages.sparkSession.sparkContext.broadcast(fit(labelled))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(
        _judged(weights), "page_id long, host string, path string, score double"
    )
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        best = F.when(_fits(host, path), F.lit(host + path)).otherwise(best)
        verdict = F.when(_fits(host, path), F.lit(what)).otherwise(verdict)
    by_model = F.when(F.col("score") >= most, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", best.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score"
    )

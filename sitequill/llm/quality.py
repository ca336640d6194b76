"""Quality rules as a short-circuit cascade, in SQL expressions only.

A rule has features, which are columns computed from the text, and a condition on them that
rejects the document. The cascade times each feature on a sample and notes which rules reject
which of its rows. The rule with the most rejections per cost comes first, then the best one for
the rows that are left and the features that are there by then, and so on. Features of a rule are
computed only for rows that no earlier rule has rejected. The order changes the price, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, no_text

#: White space between words.
BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Rows of the sample that costs and rejections are estimated on, picked from the first splits
#: at this rate, and characters in its longest text; longer ones count for no estimate.
SAMPLE_ROWS = 512
SAMPLE_RATE = 0.25
SAMPLE_CHARS = 32_768
#: Characters that a feature is timed on: the sample, said again as often as needed.
TIMED_CHARS = 1_000_000
#: Price of a condition whose features are all there, in seconds over TIMED_CHARS.
CONDITION = 0.001


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS), "")


def _covered(sorted_windows: Column) -> Column:
    """Words in windows that occur twice or more, from windows sorted by hash and position."""
    again = F.filter(
        sorted_windows,
        lambda w, i: F.coalesce(w.h == F.get(sorted_windows, i - 1).h, F.lit(False))
        | F.coalesce(w.h == F.get(sorted_windows, i + 1).h, F.lit(False)),
    )
    return F.sort_array(F.transform(again, lambda w: w.i))


#: Features in the order in which they can be computed: each may use the ones before it. The
#: column names are private to this module, so columns of the input can't clash.
FEATURES: dict[str, tuple[tuple[str, ...], Column]] = {}


def _feature(name: str, needs: tuple[str, ...], column) -> None:
    FEATURES[name] = (needs, column)


def _f(name: str) -> Column:
    return F.col(f"__q_{name}")


def _define() -> None:
    text = _f("text")
    letters = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    _feature("word_chars", (), letters(BREAKS).cast("long"))
    _feature("n_symbols", (), letters(r"[^#*$%&|<>]+").cast("long"))
    _feature("n_upper", (), letters(r"[^A-Z]+").cast("long"))
    _feature("words", (), words_of(text))
    _feature("n_words", ("words",), F.size(_f("words")).cast("long"))
    _feature(
        "lines", (), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    _feature("n_lines", ("lines",), F.size(_f("lines")).cast("long"))
    _feature(
        "n_dup_lines", ("lines",), (F.size(_f("lines")) - F.size(F.array_distinct(_f("lines")))).cast("long")
    )
    _feature(
        "n_stutters",
        ("words",),
        F.size(F.filter(_f("words"), lambda w, i: F.coalesce(w == F.get(_f("words"), i - 1), F.lit(False)))).cast("long"),
    )
    _feature("hashes", ("words",), F.transform(_f("words"), lambda w: F.xxhash64(w)))
    _feature(
        "windows",
        ("hashes",),
        F.when(
            F.size(_f("hashes")) > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size(_f("hashes")) - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(_f("hashes"), i, WINDOW)),
            ),
        ),
    )
    _feature(
        "sorted",
        ("windows",),
        F.when(
            F.size(F.array_distinct(_f("windows"))) < F.size(_f("windows")),
            F.sort_array(F.transform(_f("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    _feature("again", ("sorted",), _covered(_f("sorted")))
    _feature(
        "n_repeat_words",
        ("again",),
        F.coalesce(
            F.aggregate(
                F.transform(
                    _f("again"),
                    lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(_f("again"), i + 1) - p, F.lit(WINDOW))),
                ),
                F.lit(0),
                lambda total, n: total + n,
            ),
            F.lit(0),
        ).cast("long"),
    )


@dataclass(frozen=True)
class Rule:
    """Rejects a row if the SQL condition on the features, written as {name}, is true."""

    name: str
    features: tuple[str, ...]
    condition: str

    def column(self) -> Column:
        return F.expr(self.condition.format(**{f: f"__q_{f}" for f in self.features}))


BASE_RULES = (
    Rule("few_words", ("n_words",), "{n_words} < 20"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * {n_repeat_words} > 30 * {n_words}"),
)
METHOD_RULES = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * {n_symbols} > 3 * {n_words}"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "100 * {n_dup_lines} > 50 * {n_lines}"),
    Rule("stutters", ("n_words", "n_stutters"), "100 * {n_stutters} > 30 * {n_words}"),
    Rule("capitals", ("word_chars", "n_upper"), "100 * {n_upper} > 40 * {word_chars}"),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        "{word_chars} > 20 * {n_words} or 2 * {word_chars} < 3 * {n_words}",
    ),
)


def with_features(rows: DataFrame, names: Sequence[str], alive: Column | None = None) -> DataFrame:
    """Add features, and those they need, each in a projection of its own and only if alive."""
    if not FEATURES:
        _define()
    for name in names:
        if f"__q_{name}" in rows.columns:
            continue
        needs, column = FEATURES[name]
        rows = with_features(rows, needs, alive)
        rows = rows.withColumn(f"__q_{name}", column if alive is None else F.when(alive, column))
    return rows


def _closure(names: Sequence[str], there: frozenset[str] = frozenset()) -> frozenset[str]:
    """The features with all that they need, without those that are there."""
    if not FEATURES:
        _define()
    missing = [n for n in names if n not in there]
    return frozenset(missing).union(*(_closure(FEATURES[n][0], there) for n in missing))


def _sample(texts: DataFrame) -> DataFrame | None:
    """At most SAMPLE_ROWS texts as a written table, or none if no row is found.

    A limit at the root of a plan reads one split, and more only while rows are missing, so the
    price doesn't grow with the table. The driver sees no more than the limits above.
    """
    short = F.when(F.length("__q_text") <= SAMPLE_CHARS, F.col("__q_text")).alias("t")
    found = texts.where(F.rand(7) < SAMPLE_RATE).select(short).limit(SAMPLE_ROWS).collect()
    rows = [r.t for r in found if r.t is not None]
    if not rows:
        return None
    spark = texts.sparkSession
    return cut_lineage(spark.sql("select explode(:rows) as __q_text", args={"rows": rows}), "quality-sample")


def _costs(sample: DataFrame, features: frozenset[str], there: frozenset[str]) -> dict[str, float]:
    """Seconds that each feature takes beyond those it needs, on TIMED_CHARS characters.

    One job runs over the sample many times; the time of the job without the feature is taken off.
    """
    chars = sample.agg(F.sum(F.length("__q_text"))).head()[0]
    times = TIMED_CHARS // max(chars, SAMPLE_ROWS) + 1
    again = sample.withColumn("__q_again", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__q_again")
    known: dict[frozenset[str], float] = {}

    def seconds(wanted: frozenset[str]) -> float:
        if wanted not in known:
            names = [n for n in FEATURES if n in wanted]
            job = with_features(again, names).select("__q_text", *[_f(n) for n in names])
            took = []
            for _ in range(2):
                start = time.perf_counter()
                job.write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            known[wanted] = min(took)
        return known[wanted]

    costs = {}
    for name in features - there:
        needs = _closure(FEATURES[name][0])
        costs[name] = max(0.0, seconds(needs | {name}) - seconds(needs))
    return costs


def best_first(
    rules: Sequence[Rule], hits: dict[frozenset[int], int], costs: dict[str, float], there: frozenset[str] = frozenset()
) -> list[int]:
    """Places of the rules in the best order: most rejections per cost, again and again.

    `hits` counts sample rows by the set of rules that reject them. A rule pays for features that
    neither are there nor come with a rule before it, and earns rows that none before it rejects.
    """
    order: list[int] = []
    left = dict(hits)
    while len(order) < len(rules):
        worth = []
        for i, rule in enumerate(rules):
            if i not in order:
                cost = CONDITION + sum(costs[f] for f in _closure(rule.features, there))
                # Rules that reject nothing in the sample stand by their cost alone.
                worth.append((-sum(n for by, n in left.items() if i in by) / cost, cost, i))
        best = min(worth)[2]
        order.append(best)
        there = there | _closure(rules[best].features, there)
        left = {by: n for by, n in left.items() if best not in by}
    return order


def ordered(
    texts: DataFrame, rules: Sequence[Rule], there: Sequence[str] = (), before: Sequence[Rule] = ()
) -> list[Rule]:
    """The rules by rejections per cost on a sample, best first.

    Features in `there` are free. Rows that a rule of `before` rejects don't count.
    """
    sample = _sample(texts) if len(rules) > 1 else None
    if sample is None:
        return list(rules)
    everything = (*rules, *before)
    flags = [rule.column().alias(f"r{i}") for i, rule in enumerate(everything)]
    judged = with_features(sample, [f for rule in everything for f in rule.features]).select(*flags)
    counted = judged.groupBy(*judged.columns).agg(F.count(F.lit(1)).alias("n")).collect()
    hits = {frozenset(i for i in range(len(rules)) if r[i]): r.n for r in counted if not any(r[len(rules) : -1])}
    free = frozenset(there)
    needed = _closure([f for rule in rules for f in rule.features], free)
    return [rules[i] for i in best_first(rules, hits, _costs(sample, needed, free), free)]


def cascade(
    docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", before: Sequence[Rule] = ()
) -> DataFrame:
    """Add column `__q_kept`: false if any rule, or one of `before`, rejects the row.

    Null texts count as empty. An empty table keeps the given order of rules. Features that the
    input already has, added by `with_features`, are used as they are; those of `before` have to
    be there. All columns of the input stay; added ones begin with `__q_`. Repeated rows are
    judged alike, each on its own.
    """
    rules = (*BASE_RULES, *METHOD_RULES) if rules is None else rules
    if "__q_text" not in docs.columns:
        docs = docs.withColumn("__q_text", no_text(F.col(text)))
    there = [c.removeprefix("__q_") for c in docs.columns if c.startswith("__q_")]
    kept = F.lit(True)
    for rule in before:
        kept = kept & ~rule.column()
    rows = docs.withColumn("__q_kept", kept)
    for rule in ordered(docs, rules, there, before):
        rows = with_features(rows, rule.features, F.col("__q_kept"))
        rows = rows.withColumn("__q_kept", F.col("__q_kept") & ~rule.column())
    # Spark moves a later condition on the verdict below all these projections, and so would write
    # out each feature many times in one expression. A condition on a row number stops it.
    return rows.withColumn("__q_at", F.monotonically_increasing_id()).where("__q_at >= 0").drop("__q_at")


def kept_documents(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with the columns of the input."""
    packed = docs.select(F.struct("*").alias("__q_row"), no_text(docs["text"]).alias("__q_text"))
    return cascade(packed, rules).where("__q_kept").select("__q_row.*")


def quality_columns(docs: DataFrame) -> DataFrame:
    """Per document: the base measures, whether they fail it, and the verdict of all rules."""
    texts = docs.select("doc_id", no_text(docs["text"]).alias("__q_text"))
    base = with_features(
        texts, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    )
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | rule.column()
    judged = cascade(base.withColumn("__q_failed", failed), METHOD_RULES, before=BASE_RULES)
    return judged.select(
        "doc_id",
        *[_f(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__q_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"),
    )

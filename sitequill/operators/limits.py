"""Per-client request limits over a log.

The clock counts whole seconds. Two rules exist:

* ``anchored``: the first request opens a window of ``w`` seconds; every request in it counts,
  blocked ones too; a request is blocked when the count passes the maximum.
* ``refreshed``: a request is blocked while the count has reached the maximum; only accepted
  requests count, and each one restarts the ``w``-second expiry.

Both depend on earlier requests of the client only through the counts of earlier seconds, so
the log is first reduced to (client, second, count), combined on the map side. The history of
a client is cut at pauses of a window, and the sequential part runs over the narrow rows of
each piece by itself, at most 86,400 a day however busy the client is. The verdicts come back
by a join on (client, second), which spreads a hot client over its seconds. Only a client that
never pauses for a window stays one piece; its rows still stream through the task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitequill.session import cut_lineage

# Executors get these few functions with the query and need no installed package.
register_pickle_by_value(sys.modules[__name__])

DAY_S = 86_400
ANCHORED = "anchored"
REFRESHED = "refreshed"


def anchored_step(sec, n, limit, window, state):
    """Count before each second for one client; ``state`` is (window start, count)."""
    start, count = state or (None, 0)
    after = np.cumsum(n)
    before = after - n
    base = np.empty(len(sec), dtype="int64")
    i = 0
    while i < len(sec):
        if start is None or sec[i] >= start + window:
            start, count = int(sec[i]), 0
        j = int(np.searchsorted(sec, start + window))
        base[i:j] = count + before[i:j] - before[i]
        count += int(after[j - 1] - before[i])
        i = j
    return base, (start, count)


def refreshed_step(sec, n, limit, window, state):
    """Accepted before each second for one client; ``state`` is (expiry, count)."""
    expiry, count = state or (None, 0)
    after = np.cumsum(n)
    before = after - n
    pauses = np.flatnonzero(np.diff(sec) >= window) + 1
    base = np.empty(len(sec), dtype="int64")
    i, size = 0, len(sec)
    while i < size:
        if expiry is None or sec[i] >= expiry:
            count = 0
        if count >= limit:
            j = size if expiry is None or limit <= 0 else int(np.searchsorted(sec, expiry))
            base[i:j] = limit
            i = j
            continue
        later = np.searchsorted(pauses, i, side="right")
        stop = int(pauses[later]) if later < len(pauses) else size
        full = int(np.searchsorted(after[i:stop], limit - count + before[i]))
        j = min(i + full + 1, stop)
        base[i:j] = count + before[i:j] - before[i]
        count = min(limit, count + int(after[j - 1] - before[i]))
        expiry = int(sec[j - 1]) + window
        i = j
    return base, (expiry, count)


STEPS = {ANCHORED: anchored_step, REFRESHED: refreshed_step}


def chunked(seconds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``chunk`` to rows (keys, sec, window_s): the second after the last pause of a window.

    After a pause at least as long as the window any counter has expired, so chunks are folded
    like clients of their own. Pauses are found inside each day of a client, and then between
    its days, which are one row each; no client is sorted as a whole.
    """
    keys, day = list(keys), [*keys, "_day"]
    in_day = Window.partitionBy(*day).orderBy("sec")
    pause = F.col("sec") - F.lag("sec").over(in_day) >= F.col("window_s")
    marked = seconds.withColumn("_day", F.floor(F.col("sec") / DAY_S)).withColumn("_start", F.when(pause, F.col("sec")))
    days = marked.groupBy(*day).agg(
        F.min("sec").alias("_first"), F.max("sec").alias("_last"), F.max("_start").alias("_start"), F.max("window_s").alias("_window")
    )
    by_day = Window.partitionBy(*keys).orderBy("_day")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(by_day) >= F.col("_window"), F.lit(True))
    days = days.withColumn("_opened", F.when(opens, F.col("_first")))
    newest = F.last(F.coalesce("_start", "_opened"), ignorenulls=True)
    before = newest.over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*day, F.coalesce("_opened", before).alias("_entry"))
    so_far = F.max("_start").over(in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.join(days, day).withColumn("chunk", F.coalesce(so_far, "_entry")).drop("_day", "_start", "_entry")


def _fold(keys: Sequence[str], mode: str):
    """Walk through sorted seconds batch by batch, carrying the state of one key across."""
    step = STEPS[mode]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, state = None, None
        for rows in batches:
            if rows.empty:
                continue
            columns = [rows[k].to_numpy() for k in keys]
            changed = np.zeros(len(rows), dtype=bool)
            changed[0] = True
            for values in columns:
                changed[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(changed)
            ends = np.append(starts[1:], len(rows))
            sec, n = rows["sec"].to_numpy(), rows["n"].to_numpy()
            limits, windows = rows["max_requests"].to_numpy(), rows["window_s"].to_numpy()
            base = np.empty(len(rows), dtype="int64")
            for a, b in zip(starts, ends):
                key = tuple(values[a] for values in columns)
                if key != open_key:
                    open_key, state = key, None
                base[a:b], state = step(
                    sec[a:b], n[a:b], int(limits[a]), int(windows[a]), state
                )
            yield rows[[*keys, "sec"]].assign(base=base)

    return run


def with_limits(
    requests: DataFrame,
    keys: Sequence[str],
    max_requests: Column | int,
    window_s: Column | int,
    mode: str = ANCHORED,
    counted: Column | None = None,
    request_id: str = "request_id",
) -> DataFrame:
    """Add request_count, limited, remaining and reset_at to every counted request.

    ``keys`` name the client and must not be null; ``max_requests`` and ``window_s`` are
    constants or columns that are constant per key. Rows where ``counted`` is false pass
    with ``limited`` false and null counts.
    """
    keys = list(keys)
    as_column = lambda v: F.lit(v) if isinstance(v, int) else v
    marked = requests.select(
        "*",
        F.unix_seconds("ts").alias("sec"),
        (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("_counted"),
        as_column(max_requests).cast("bigint").alias("max_requests"),
        as_column(window_s).cast("bigint").alias("window_s"),
    )
    # Three branches read the counts. Each would work out all requests again, with their routes and
    # addresses, because it needs other columns; so the counts are written once.
    seconds = cut_lineage(
        marked.filter("_counted")
        .groupBy(*keys, "sec")
        .agg(
            F.count("*").alias("n"),
            F.max("max_requests").alias("max_requests"),
            F.max("window_s").alias("window_s"),
        ),
        "seconds",
    )
    folded = [*keys, "chunk"]
    key_fields = [requests.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *[T.StructField(name, T.LongType()) for name in ("chunk", "sec", "base")]])
    bases = (
        chunked(seconds, keys)
        .repartition(*folded)
        .sortWithinPartitions(*folded, "sec")
        .mapInPandas(_fold(folded, mode), schema)
        .drop("chunk")
    )
    same_second = Window.partitionBy(*keys, "sec").orderBy("ts", request_id)
    place = F.sum(F.col("_counted").cast("bigint")).over(
        same_second.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    judged = (
        marked.withColumn("_place", place)
        .join(bases, [*keys, "sec"], "left")
        .withColumn("_reached", F.when(F.col("_counted"), F.col("base") + F.col("_place")))
    )
    shown = (
        F.col("_reached")
        if mode == ANCHORED
        else F.least(F.col("_reached"), F.col("max_requests"))
    )
    return (
        judged.withColumn("limited", F.coalesce(F.col("_reached") > F.col("max_requests"), F.lit(False)))
        .withColumn("request_count", shown)
        .withColumn(
            "remaining", F.greatest(F.lit(0).cast("bigint"), F.col("max_requests") - shown)
        )
        .withColumn("reset_at", F.when(F.col("_counted"), F.col("sec") + F.col("window_s")))
        .drop("_counted", "_place", "_reached", "base", "sec")
    )


def limit_headers(judged: DataFrame, limit_enabled: Column | None = None) -> DataFrame:
    """The three header columns; a switched-off limiter shows 0 remaining."""
    on = F.lit(True) if limit_enabled is None else limit_enabled
    return judged.select(
        "*",
        F.col("max_requests").alias("header_limit"),
        F.when(on, F.greatest(F.lit(0).cast("bigint"), F.col("remaining")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("header_remaining"),
        F.col("reset_at").alias("header_reset"),
    )


def limit_events(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One event per blocked request: who, how many so far, the maximum."""
    return judged.filter("limited").select(
        *keys, "request_id", "ts", "request_count", "max_requests"
    )

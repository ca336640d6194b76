"""Request limits on a stream, with the same rules and the same steps as the batch form."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitequill.operators.limits import ANCHORED, STEPS

# Executors get these few functions with the query and need no installed package.
register_pickle_by_value(sys.modules[__name__])

#: What a session needs for state with a lifetime. Without the second one a query that ends when
#: its input is used up would run empty micro-batches for ever, waiting for lifetimes to pass.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _in_order(ids: np.ndarray, at_us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by time, then id. Whole numbers need no data frame, which costs more than a client's few rows."""
    if ids.dtype.kind in "iu" and at_us.dtype.kind in "iu":
        order = np.lexsort((ids, at_us))
        return ids[order], at_us[order]
    rows = pd.DataFrame({"at_us": at_us, "ids": ids}).sort_values(["at_us", "ids"])
    return rows["ids"].to_numpy(), rows["at_us"].to_numpy()


class LimitState(StatefulProcessor):
    """Three numbers per client: where its counter stands, and the last second that was judged."""

    def __init__(self, keys: Sequence[str], mode: str, ttl_s: int):
        self.keys, self.mode, self.ttl_ms = list(keys), mode, 1000 * ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "mark long, seen long, last_sec long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """Judge the rows of one client in one micro-batch; four numbers of each are held."""
        parts = list(rows)
        top, window = int(parts[0]["max_requests"].iat[0]), int(parts[0]["window_s"].iat[0])
        ids, at_us = _in_order(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("request_id", "at_us")))
        sec = at_us // 1_000_000
        # One question to the state store: without a counter there is no value.
        found = self.counter.get()
        state, last = (None, None) if found is None else (tuple(found[:2]), found[2])
        first = 0 if last is None else int(np.searchsorted(sec, last))
        count = np.zeros(len(sec), dtype="int64")
        fresh = sec[first:]
        if len(fresh):
            seconds, at, n = np.unique(fresh, return_index=True, return_counts=True)
            base, (mark, seen) = STEPS[self.mode](seconds, n, top, window, state)
            count[first:] = np.repeat(base - at, n) + np.arange(len(fresh)) + 1
            self.counter.update((mark, seen, int(seconds[-1])))
        late = np.arange(len(sec)) < first
        limited = count > top
        shown = count if self.mode == ANCHORED else np.minimum(count, top)
        yield pd.DataFrame(
            {
                **{name: [value] * len(sec) for name, value in zip(self.keys, key)},
                "request_id": ids, "at_us": at_us, "request_count": shown, "limited": limited, "late": late,
            }
        )

    def close(self) -> None:
        pass


def limit_stream(
    requests: DataFrame,
    keys: Sequence[str],
    folder: str,
    checkpoint: str,
    mode: str = ANCHORED,
    ttl_s: int = 86_400,
    **trigger,
) -> StreamingQuery:
    """Judge a stream with columns keys, request_id, ts, max_requests, window_s.

    The state store keeps three numbers per client, and drops them ``ttl_s`` seconds after the
    client's last row was judged; it should be the longest window and the delay of the log. Rows
    older than the last second that was judged for their client are written as late and not
    judged; there is no watermark, so no row is lost. A client's rows of one micro-batch come
    to one task, so the source should bound a micro-batch (``files_per_trigger``).
    """
    keys, spark = list(keys), requests.sparkSession
    fields = {f.name: f for f in requests.schema}
    number = T.LongType()
    schema = T.StructType([
        *[fields[k] for k in keys], fields["request_id"], T.StructField("at_us", number),
        T.StructField("request_count", number), T.StructField("limited", T.BooleanType()), T.StructField("late", T.BooleanType()),
    ])
    rows = requests.select(
        *keys, "request_id", F.unix_micros("ts").alias("at_us"),
        *[F.col(c).cast("bigint").alias(c) for c in ("max_requests", "window_s")],
    )
    judged = rows.groupBy(*keys).transformWithStateInPandas(LimitState(keys, mode, ttl_s), schema, "Append", "ProcessingTime")
    judged = judged.select(
        *keys, "request_id", F.timestamp_micros("at_us").alias("ts"),
        F.when(~F.col("late"), F.col("request_count")).alias("request_count"),
        F.when(~F.col("late"), F.col("limited")).alias("limited"), "late",
    )
    # A query takes the settings that its session has when it starts.
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return (
            judged.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/judged")
            .option("checkpointLocation", checkpoint)
            .partitionBy("late")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_limits(spark: SparkSession, folder: str, name: str = "verdicts") -> DataFrame:
    """All rows of ``verdicts`` or ``late``."""
    rows = spark.read.parquet(f"{folder}/judged")
    late = F.col("late").cast("string") == "true"
    return rows.filter(late).drop("late", "request_count", "limited") if name == "late" else rows.filter(~late).drop("late")

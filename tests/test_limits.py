import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sitequill.operators import limits


def plain_fold(rows, top, window, mode):
    """One request after another, as a service would do it."""
    state, out = {}, {}
    for client, sec, request_id in sorted(rows, key=lambda r: (r[1], r[2])):
        mark, count = state.get(client, (None, 0))
        if mode == limits.ANCHORED:
            if mark is None or sec >= mark + window:
                mark, count = sec, 0
            count += 1
            out[request_id] = (count, count > top)
        else:
            if mark is None or sec >= mark:
                count = 0
            blocked = count >= top
            if not blocked:
                count, mark = count + 1, sec + window
            out[request_id] = (count, blocked)
        state[client] = (mark, count)
    return out


def make_rows(seed, clients=3, n=400, span=2000):
    rng = random.Random(seed)
    return [(f"c{rng.randrange(clients)}", rng.randrange(span), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(
        [(c, datetime.fromtimestamp(s, timezone.utc), i) for c, s, i in rows],
        "client string, ts timestamp, request_id long",
    )


@pytest.mark.parametrize("mode", [limits.ANCHORED, limits.REFRESHED])
def test_batch_equals_a_plain_fold(spark, mode):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for seed, (top, window) in enumerate([(3, 60), (1, 10), (20, 300), (0, 30), (5, 1)]):
            rows = make_rows(seed)
            judged = limits.with_limits(frame(spark, rows), ["client"], top, window, mode)
            got = {r.request_id: (r.request_count, r.limited) for r in judged.collect()}
            assert got == plain_fold(rows, top, window, mode), (top, window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("mode", [limits.ANCHORED, limits.REFRESHED])
def test_one_hot_client(spark, mode):
    rows = make_rows(9, clients=1, n=3000, span=500)
    judged = limits.with_limits(frame(spark, rows), ["client"], 30, 60, mode)
    got = {r.request_id: (r.request_count, r.limited) for r in judged.collect()}
    assert got == plain_fold(rows, 30, 60, mode)


def test_counts_headers_and_events(spark):
    rows = [("a", 100, i) for i in range(6)]
    judged = limits.with_limits(frame(spark, rows), ["client"], 5, 60)
    assert [r.limited for r in judged.orderBy("request_id").collect()] == [False] * 5 + [True]
    last = limits.limit_headers(judged).orderBy("request_id").collect()[4]
    assert (last.header_limit, last.header_remaining, last.header_reset) == (5, 0, 160)
    events = limits.limit_events(judged, ["client"]).collect()
    assert [(e.client, e.request_count, e.max_requests) for e in events] == [("a", 6, 5)]


def test_remaining(spark):
    judged = limits.with_limits(frame(spark, [("a", 1, i) for i in range(25)]), ["client"], 100, 60)
    assert judged.agg(F.min("remaining")).first()[0] == 75
    off = limits.limit_headers(judged, F.lit(False))
    assert off.agg(F.max("header_remaining")).first()[0] == 0


def test_rows_that_do_not_count(spark):
    rows = frame(spark, [("a", 5, i) for i in range(6)])
    judged = limits.with_limits(rows, ["client"], 2, 60, counted=F.col("request_id") % 2 == 0)
    got = {r.request_id: (r.request_count, r.limited) for r in judged.collect()}
    assert got == {0: (1, False), 1: (None, False), 2: (2, False), 3: (None, False),
                   4: (3, True), 5: (None, False)}


@pytest.mark.parametrize("mode", [limits.ANCHORED, limits.REFRESHED])
def test_one_client_over_many_chunks(spark, mode):
    """Forty days with pauses inside days and over midnight: no chunk is longer than a day."""
    rng = random.Random(4)
    top, window, rows = 4, 600, []
    for day in range(40):
        for burst in rng.sample([0, 20_000, 50_000, 86_000], rng.choice([1, 2, 3])):
            # The last burst of a day goes on after midnight.
            start = 86_400 * day + burst
            rows += [("a", start + rng.randrange(900), len(rows) + i) for i in range(rng.choice([1, 30]))]
    judged = limits.with_limits(frame(spark, rows), ["client"], top, window, mode)
    got = {r.request_id: (r.request_count, r.limited) for r in judged.collect()}
    assert got == plain_fold(rows, top, window, mode)

    seconds = frame(spark, rows).select("client", F.unix_seconds("ts").alias("sec"), F.lit(window).alias("window_s")).distinct()
    chunks = limits.chunked(seconds, ["client"]).groupBy("chunk").agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(chunks) > 40 and all(c.chunk == c.a and c.b - c.a < 86_400 for c in chunks)
    assert all(y.a - x.b >= window for x, y in zip(chunks, chunks[1:]))
    assert any(c.a // 86_400 < c.b // 86_400 for c in chunks)
    assert max(c.n for c in chunks) < sum(c.n for c in chunks) / 10


def test_requests_are_worked_out_at_most_twice(spark):
    """Once for the counts, which are written, and once for the verdicts; not for each branch."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [("a", datetime.fromtimestamp(s, timezone.utc), s) for s in range(50)]
    frame = spark.createDataFrame(rows, "client string, ts timestamp, request_id long")
    frame = frame.mapInPandas(count, frame.schema)
    assert limits.with_limits(frame, ["client"], 3, 60).count() == 50
    assert seen.value <= 100

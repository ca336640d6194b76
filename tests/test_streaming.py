import time
from datetime import datetime, timezone

import pytest

from sitequill.operators import limits
from sitequill.session import work_folder
from sitequill.streaming import jobs
from sitequill.streaming.limits import limit_stream, read_limits
from tests.test_limits import make_rows, plain_fold

SCHEMA = "client string, ts timestamp, request_id long, max_requests long, window_s long"


def run_stream(spark, batches, mode):
    """Write the batches one after another, then read them as a stream, a file at a time."""
    folder = work_folder(spark, "test-stream")
    for rows in batches:
        spark.createDataFrame(
            [(c, datetime.fromtimestamp(s, timezone.utc), i, 3, 60) for c, s, i in rows], SCHEMA
        ).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    )
    limit_stream(source, ["client"], f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return (read_limits(spark, f"{folder}/out", name) for name in ("verdicts", "late"))


@pytest.mark.parametrize("mode", [limits.ANCHORED, limits.REFRESHED])
def test_stream_equals_batch_over_several_micro_batches(spark, mode):
    rows = sorted(make_rows(5, n=300, span=900), key=lambda r: (r[1], r[2]))
    rows = [(c, s, i) for i, (c, s, _) in enumerate(rows)]
    batches = [rows[:90], rows[90:200], rows[200:]]
    verdicts, late = run_stream(spark, batches, mode)
    got = {r.request_id: (r.request_count, r.limited) for r in verdicts.collect()}
    assert got == plain_fold(rows, 3, 60, mode) and late.count() == 0


def test_late_rows_are_set_aside_and_none_is_lost(spark):
    """However old: a row from long before comes out as late, too."""
    batches = [[("a", 10**6, 0)], [("a", 990, 1), ("a", 10**6 + 1, 2), ("b", 5, 3)], [("a", 10**6, 4)]]
    verdicts, late = run_stream(spark, batches, limits.ANCHORED)
    got = {r.request_id: (r.request_count, r.limited) for r in verdicts.collect()}
    assert got == {0: (1, False), 2: (2, False), 3: (1, False)}
    assert sorted(r.request_id for r in late.collect()) == [1, 4]


def test_state_of_a_client_ends(spark):
    """Clients that stay away leave the state store; one that comes back starts anew."""
    folder = work_folder(spark, "test-stream-ttl")
    sizes = []
    for n, clients in enumerate([[f"c{i}" for i in range(30)], ["x"], ["c0"]]):
        rows = [(c, datetime.fromtimestamp(100 + n, timezone.utc), 100 * n + i, 1, 60) for i, c in enumerate(clients)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        query = limit_stream(source, ["client"], f"{folder}/out", f"{folder}/state", ttl_s=1)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(1.5)
    assert sizes[0] == 30 and sizes[1] < 5 and sizes[2] < 5
    assert not any(r.limited for r in read_limits(spark, f"{folder}/out").collect())


def test_windows_lose_no_row(spark):
    """Rows beyond the watermark go to the late table before the aggregate; its state holds open windows only."""
    folder, schema = work_folder(spark, "test-windows"), "site_id string, ts timestamp, agent string"
    day = lambda d, h=1: datetime.fromtimestamp(86_400 * d + 3600 * h, timezone.utc)
    batches = [
        [("s", day(d), a) for d in range(10) for a in ("A", "B")],
        [("s", day(1), "A"), ("s", day(8), "A"), ("s", day(9), None), ("t", day(12), "A")],
        [("s", day(9, 2), "A"), ("s", day(9, 3), "B"), ("t", day(12), "A"), ("t", day(0), "C")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.split_late(source, folder, f"{folder}/split", "1 day", "2 days").awaitTermination()
        query = jobs.window_stream(spark, folder, f"{folder}/windows", "1 day", "2 days")
        query.awaitTermination()
    got = {(r.site_id, r.window_start.timestamp() // 86_400, r.agent): (r.requests, r.late_requests) for r in jobs.read_windows(spark, folder, "1 day").collect()}
    want = {("s", d, a): (1, 0) for d in range(10) for a in ("A", "B")}
    # After day 9 the windows up to day 6 are closed, after day 12 those up to day 9.
    want |= {("s", 1, "A"): (1, 1), ("s", 8, "A"): (2, 0), ("t", 12, "A"): (2, 0), ("t", 0, "C"): (0, 1)}
    want |= {("s", 9, "A"): (1, 1), ("s", 9, "B"): (1, 1)}
    assert {k: v for k, v in got.items()} == {(s, float(d), a): v for (s, d, a), v in want.items()}
    assert sum(sum(v) for v in got.values()) == sum(a is not None for rows in batches for *_, a in rows)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 4 and state["numRowsDroppedByWatermark"] == 0


def test_a_client_asks_the_state_store_once():
    """Every question is a round trip; a missing counter is an answer of its own."""
    import pandas as pd

    from sitequill.streaming.limits import LimitState

    class Counter:
        asked, value = 0, None

        def exists(self):
            self.asked += 1
            return self.value is not None

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

    for ids in ([3, 1, 2], ["c", "a", "b"]):
        state = LimitState(["client"], limits.ANCHORED, 60)
        state.counter = counter = Counter()
        rows = pd.DataFrame({"request_id": ids, "at_us": [5_000_000, 4_000_000, 4_000_000], "max_requests": 2, "window_s": 60})
        for asked, first, late in ((1, [1, 2, 3], [False] * 3), (2, [0, 0, 4], [True, True, False])):
            out = next(state.handleInputRows(("x",), iter([rows[:2], rows[2:]]), None))
            assert counter.asked == asked and list(out["request_id"]) == sorted(ids)
            assert list(out["request_count"]) == first and list(out["late"]) == late

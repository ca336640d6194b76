import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sitequill.session import local_session

    session = local_session(4, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Run a column function over values, one row each, and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i int, v {kind}")
        out = frame.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitequill.operators import scale


def skewed(spark, n=600):
    """A third of the rows has key "hot", some have no key."""
    keys = ["hot", "hot", "hot", "a", "b", "c", "missing", None, "d"]
    return spark.createDataFrame([(keys[i % 9], i) for i in range(n)], "k string, id long")


def lookup(spark):
    return spark.createDataFrame([(k, k.upper()) for k in ["hot", "a", "b", "c", "d"]], "k string, v string")


def test_lookup_join_equals_a_plain_join(spark):
    fact, side = skewed(spark), lookup(spark)
    side = side.union(spark.createDataFrame([(None, "NONE")], side.schema))
    for how in ("left", "inner"):
        expected = sorted(fact.join(side, "k", how).select("id", "v").collect())
        got = scale.lookup_join(fact, side, ["k"], how)
        assert sorted(got.select("id", "v").collect()) == expected


def test_both_sides_of_a_large_lookup_are_shuffled_for_the_join(spark):
    """Only then adaptive execution can split a hot key; a grouped side is no exception."""
    fact, side = skewed(spark), lookup(spark).groupBy("k").agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = scale.lookup_join(fact, side, ["k"])
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        executed = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and executed.count("hashpartitioning(_key") == 2


def test_top_n_with_ties(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame(
        [(rng.choice(["hot", "hot", "a"]), rng.randrange(20), i) for i in range(500)],
        "k string, x int, id long",
    )
    order = [F.desc("x"), F.desc("id")]
    plain = rows.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    expected = sorted(plain.filter("r <= 7").select("k", "id", "r").collect())
    got = scale.top_n(rows, ["k"], order, 7, "r", "id", salts=5)
    assert sorted(got.select("k", "id", "r").collect()) == expected


def test_positions_equal_row_number(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [
            (rng.choice(["s", "s", "t"]), rng.choice("xy"),
             start + timedelta(seconds=rng.choice([0, 1, 90000, 90001, rng.randrange(10**6)])), i)
            for i in range(800)
        ],
        "site string, label string, ts timestamp_ntz, id long",
    )
    newest = [F.desc("ts"), F.desc("id")]
    plain = (
        rows.withColumn("p", F.row_number().over(Window.partitionBy("site", "label").orderBy(*newest)))
        .withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy(*newest)))
        .withColumn("f", F.min("r").over(Window.partitionBy("site", "label")))
        .withColumn("s", F.dense_rank().over(Window.partitionBy("site").orderBy("f")))
    )
    got = scale.newest_first_position(rows, "site", "label", "ts", "id")
    assert sorted(got.select("id", "position", "section").collect()) == sorted(
        plain.select("id", "p", "s").collect()
    )

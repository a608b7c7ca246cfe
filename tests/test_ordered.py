"""Sliced look-back and spread joins give the same rows as the plain operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewatch.operators.lookup import lookup_join
from scorewatch.operators.ordered import with_last, with_sequence


def events(spark, n=3000, seed=3):
    """A third of the rows share one key; times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(600))
        rows.append((key, i, ts, rng.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "key string, id long, ts timestamp, v string")


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("width", ["hour", "day", "year"])
def test_with_last_is_the_plain_window(spark, inclusive, width):
    df = events(spark)
    window = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("*", F.last("v", True).over(window).alias("x"), F.last(F.struct("v")).over(window).alias("y"))
    got = with_last(df, ["key"], "ts", {"x": F.col("v"), "y": F.struct("v")}, ties=["id"], inclusive=inclusive, width=width)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_with_sequence_is_the_plain_row_number(spark):
    df = events(spark)
    by_key = Window.partitionBy("key")
    want = df.select("*", F.row_number().over(by_key.orderBy("ts", "id")).cast("long").alias("seq"), F.count("*").over(by_key).alias("total"))
    got = with_sequence(df, ["key"], "ts", ties=["id"], width="day")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_broadcast_join(spark, how):
    big = events(spark).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    small = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 40, 2)]], "key string, w long")
    want = lookup_join(big, small, ["key"], how)
    got = lookup_join(big, small, ["key"], how, limit=0)
    assert "BroadcastHashJoin" in want._jdf.queryExecution().executedPlan().toString()
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_keys_are_spread_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = spark.createDataFrame([("hot", 1)], "key string, w long")
        joined = lookup_join(events(spark), small, ["key"], "inner", limit=0)
        used = joined.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert used == 8


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), ["id"], "outer")

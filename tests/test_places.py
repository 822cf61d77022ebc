"""Places of ordered results over many partitions, with ties and without rows."""

import random

from pyspark.sql import functions as F

from shiftspark.operators.places import with_place


def test_places_follow_the_order_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = random.Random(1).sample(range(10_000), 3000)
        df = spark.createDataFrame([(v, f"x{v}") for v in values], "v long, label string").repartition(5)
        got = with_place(df.orderBy(F.desc("v")))
        assert got.columns == ["v", "label", "place"]
        assert {r.v: r.place for r in got.collect()} == {v: i for i, v in enumerate(sorted(values, reverse=True), 1)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_and_nulls_get_each_place_once(spark):
    df = spark.createDataFrame([(k,) for k in [1, 1, 1, None, None, 0] * 50], "k int")
    rows = with_place(df.orderBy("k")).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 301))
    assert [r.k for r in rows] == [None] * 100 + [0] * 50 + [1] * 150


def test_nothing_has_no_places(spark):
    assert with_place(spark.range(0).orderBy("id")).collect() == []
    assert [r.place for r in with_place(spark.range(1).orderBy("id"), "nth").withColumnRenamed("nth", "place").collect()] == [1]

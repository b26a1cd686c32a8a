"""Positions in an order, beside sorting in Python."""

import random

from pyspark.sql import functions as F

from pathloom.operators.ranking import number_in_order
from pathloom.session import clear_stored, shared_folder


def test_positions_of_hot_and_small_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    rows += [("same", 7, 7)] * 500
    df = spark.createDataFrame(rows, "k string, v int, i int")
    out = number_in_order(df, ["k"], [F.col("v"), F.col("i")], "no", "n").collect()
    assert len(out) == len(rows)
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append(r)
    for found in groups.values():
        found.sort(key=lambda r: r.no)
        assert [r.no for r in found] == list(range(1, len(found) + 1)) and {r.n for r in found} == {len(found)}
        order = [(r.v is not None, r.v or 0, r.i) for r in found]
        assert order == sorted(order)


def test_one_group_lies_over_many_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    out = number_in_order(df, ["k"], [F.col("v")], "no")
    assert out.select(F.max("no"), F.countDistinct("no"), F.min("no")).first() == (200_000, 200_000, 1)
    assert out.where("no = 1").first().v == df.agg(F.min("v")).first()[0]
    # the only window is over counts: one row per range
    assert out._jdf.queryExecution().executedPlan().toString().count("Window") >= 1
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_no_keys_and_empty(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "v int")
    assert sorted((r.no, r.v) for r in number_in_order(df, [], [F.col("v")], "no").collect()) == [(1, None), (2, 1), (3, 3)]
    assert number_in_order(df.where("v > 5"), [], [F.col("v")], "no").collect() == []


def test_stored_tables_can_be_cleared(spark):
    number_in_order(spark.range(10).withColumnRenamed("id", "v"), [], [F.col("v")]).count()
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(shared_folder(spark))
    held = lambda: len(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    before = held()
    assert clear_stored(spark) >= 2 and held() < before
    assert clear_stored(spark) == 0

"""Unions of intervals and frame runs over block borders, beside plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import frames


def brute(rows):
    out = {}
    for key, first, last in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if last < first:
            continue
        runs = out.setdefault(key, [])
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return sorted((str(k), f, t) for k, runs in out.items() for f, t in runs)


@pytest.mark.parametrize("seed", range(3))
def test_united_intervals(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", None, "c"):
        for _ in range(rng.randint(1, 400)):
            first = rng.randint(-30_000, 60_000)
            rows.append((key, first, first + rng.choice([0, 1, 5, 100, 5000, 20_000 if seed else 3, -2])))
    df = spark.createDataFrame(rows, "k string, f long, t long").repartition(3)
    got = sorted((str(r.k), r.f, r.t) for r in frames.united_intervals(df, ["k"], "f", "t").collect())
    assert got == brute(rows)


def test_a_million_overlapping_intervals_of_one_key(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (F.col("id") % 250_000).alias("f"), (F.col("id") % 250_000 + F.col("id") % 50).alias("t"))
    assert [tuple(r) for r in frames.united_intervals(df, ["k"], "f", "t").collect()] == [("hot", 0, 249_999 + 49)]


def test_no_lists_are_sorted_by_key(spark):
    df = spark.range(10_000).select(F.expr("if(id < 0, 'x', null)").alias("k"), (F.col("id") * 3 % 10_007).alias("n"))
    out = frames.sequence_ranges(df, ["k"], F.col("n"))
    numbers = sorted({i * 3 % 10_007 for i in range(10_000)})
    runs = sum(1 for i, n in enumerate(numbers) if i == 0 or numbers[i - 1] != n - 1)
    found = out.collect()
    assert len(found) == runs and {r.k for r in found} == {None}
    assert sum(r.LASTFRAME - r.FIRSTFRAME + 1 for r in found) == len(numbers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "hashpartitioning(__key" in line and "__block" not in line]
    assert by_key
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("__local" in line or "__frames" in line for line in by_key + windows)

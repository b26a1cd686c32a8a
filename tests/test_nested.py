"""Nodes of nested cells at any depth, beside a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from pathloom.operators.columns import nested_paths


def grow(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, "x", True, None, [], {}, "é'"])
    if rng.random() < 0.5:
        return {k: grow(rng, depth - 1) for k in rng.sample(["a", "b b", "c", "é"], rng.randint(1, 3))}
    return [grow(rng, depth - 1) for _ in range(rng.randint(1, 3))]


def walk(value, path="(root)"):
    yield path, value
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}['{k}']")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_all_levels(spark):
    rng = random.Random(4)
    cells = [(i, json.dumps(grow(rng, rng.randint(0, 9)))) for i in range(60)]
    chain = "x"
    for i in range(17):
        chain = {"k": chain} if i % 2 else [chain]
    cells.append((100, json.dumps(chain)))
    df = spark.createDataFrame(cells, "path long, cell string")
    # a kept column may have a name of the result's own columns
    out = nested_paths(df.withColumnRenamed("path", "id"), F.col("cell"), ["id"]).collect()
    got = sorted((r.id, r.path, json.dumps(json.loads(r.value), sort_keys=True)) for r in out)
    want = sorted((i, p, json.dumps(v, sort_keys=True)) for i, cell in cells for p, v in walk(json.loads(cell)))
    assert got == want


def test_bad_and_null_cells(spark):
    df = spark.createDataFrame([(1, None), (2, "{no"), (3, "[]")], "id long, cell string")
    rows = {(r.id, r.path, r.value) for r in nested_paths(df, F.col("cell"), ["id"]).collect()}
    assert (3, "(root)", "[]") in rows and all(v is None for i, _, v in rows if i < 3)
    assert nested_paths(df.limit(0), F.col("cell")).collect() == []

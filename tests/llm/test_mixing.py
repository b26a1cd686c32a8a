"""Sources mixed to targets: targets by the resharing rounds, copies by what they must keep to."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size string, part string, m int"


def brute_targets(sizes, share, limit, weights):
    """Targets by the rounds of the definition: cut at the limit, divide what is cut among the rest."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > limit * sizes[s]}
        if not above:
            return out | {s: unit * weight[s] for s in free}
        for s in above:
            out[s] = limit * sizes[s]
            left -= out[s]
        free -= above
    return out


def words(rng, n):
    gaps = [" ", "\n", "\t ", "\x0b", "\x0c\r"]
    return "".join(f"w{rng.randrange(99)}\xa0x\x1f{rng.choice(gaps)}" for _ in range(n))


def sample(seed):
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(700)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \n", "only blanks"), (None, "x y", "a"), (None, None, None), (1003, words(rng, 4000), "b")]
    rows += [(1, "one two three", "c")] * 40 + [(None, "q r", "Z")] * 25
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "s", "p", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_keeps_targets(spark, seed):
    rows = sample(seed)
    out = mixing.mix(frame(spark, rows), seed=seed, fan=8).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((str(r.doc_id), str(r.source), r["size"]) for r in out)) == sorted((str(k), str(s), count(t)) for k, t, s in rows)
    sizes, longest = {}, {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
        longest[source] = max(longest.get(source, 0), count(text))
    targets = brute_targets(sizes, 1.5, 2.0, (3, 1, 2))
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r["size"] and (not r["size"] or int(rate) <= r.copies <= int(rate) + (rate > int(rate)))
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1e-6


def test_same_rows_same_mix(spark):
    rows = sample(3)
    first = mixing.mix(frame(spark, rows, 1), fan=8).collect()
    random.Random(4).shuffle(rows)
    again = mixing.mix(frame(spark, rows, 7), fan=8).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_expected_copies(spark):
    """Over many seeds a document's copies come near its rate."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 12)), "a" if i < 20 else "b") for i in range(40)]
    total = {}
    for seed in range(12):
        for r in mixing.mix(frame(spark, rows, 1), seed=1000 * seed, share=1.3).collect():
            total.setdefault(r.target / r.source_size, []).append(r.copies)
    for rate, copies in total.items():
        assert sum(copies) / len(copies) == pytest.approx(rate, abs=0.12)


def test_targets_where_all_or_none_reach_the_limit(spark):
    for sizes in ({"a": 10, "b": 10}, {"a": 1, "b": 1, "c": 1000, "d": 3}, {"a": 0}, {"x": 5, None: 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        for share in (0.5, 1.5, 2.0):
            want = brute_targets(sizes, share, 2.0, (3, 1, 2))
            got = {r.source: r.target for r in mixing.source_targets(df, share).collect()}
            assert got == pytest.approx(want)


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [], 1)).collect() == []


def test_registered_query_and_plan(spark):
    out = queries.QUERIES["op12_source_mix"](spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    rows = out.collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    words = spark.createDataFrame([("a\x1cb c\x85d\xa0e f",), ("",), (None,)], "t string")
    assert [r[0] for r in words.select(mixing.word_count(F.col("t"))).collect()] == [2, 0, 0]

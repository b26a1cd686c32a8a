"""Merkle manifests beside plain recursion."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pathloom.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, spot string, hash int, total string, nodes string"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def climb(levels, slot, value, arity):
    siblings = []
    for below in levels[:-1]:
        first = slot - slot % arity
        run = below[first : first + arity]
        siblings += run[: slot - first] + run[slot - first + 1 :]
        run[slot - first] = value
        value, slot = h(*run), slot // arity
    return value, siblings


def brute(rows, arity, changed):
    """Sorted (doc_id, leaf, subroot, root, siblings, folded root)."""
    groups = {}
    for k, text, lang in rows:
        groups.setdefault(lang, []).append((k is not None, k or 0, leaf(k, text), k, text))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    top = up([trees[g][-1][0] for g in names], arity)
    out = []
    for at, g in enumerate(names):
        for slot, (_, _, own, k, text) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            value, low = climb(trees[g], slot, changed(k, text) or own, arity)
            value, high = climb(top, at, value, arity)
            out.append((str(k), own, trees[g][-1][0], top[-1][0], h(*low, *high), value))
    return sorted(out)


def run(spark, rows, arity=2, parts=3, levels=8):
    df = spark.createDataFrame([(*r, "s", 1, "t", "n") for r in rows], SCHEMA).repartition(parts)
    other = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_of(F.col("doc_id"), F.lit("changed")))
    found = merkle.manifest(df, ["doc_id", "text"], replacement=other, arity=arity, levels=levels).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, h(*(s.left + s.right for s in r.proof)), r.folded_root) for r in found)


@pytest.mark.parametrize("arity,levels", [(2, 2), (3, 1), (2, 8), (16, 1)])
def test_manifest_is_the_recursive_one(spark, arity, levels):
    rng = random.Random(arity * levels)
    rows = [(i, rng.choice([None, "", "x", "é" * 3, "long " * 2000]), rng.choice(["en", "en", "en", "de", "é", "z", None])) for i in range(90)]
    rows += [(500, "alone", "lone"), (None, "no key", "en"), (None, None, None), (None, "no key", "en"), (7, "again", "de"), (7, "again", "de"), (9, "", "")]
    assert run(spark, rows, arity, levels=levels) == brute(rows, arity, lambda k, t: leaf(k, "changed") if k is not None and k % 3 == 0 else None)


def test_several_rounds_of_real_blocks(spark):
    rows = [(i, str(i), "en" if i < 70_000 else "de") for i in range(70_300)]
    assert run(spark, rows, 2, 5) == brute(rows, 2, lambda k, t: leaf(k, "changed") if k % 3 == 0 else None)


def test_one_row_and_empty(spark):
    assert run(spark, [(1, "a", "en")]) == [("1", leaf(1, "a"), leaf(1, "a"), leaf(1, "a"), h(), leaf(1, "a"))]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        merkle.manifest(spark.range(1), ["id"], "id", "id", arity=1)


def test_states_are_resumed():
    block = merkle.Block([h(str(i)) for i in range(10)], 4, None)
    for slot in range(10):
        nodes = [h(str(i)) for i in range(10)]
        assert block.fold(slot, nodes[slot]) == block.root
        nodes[slot] = h("other")
        assert block.fold(slot, h("other")) == merkle.Block(nodes, 4, None).root


def test_registered_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op11_merkle_manifest"])
    names = [c[0] for c in cursor.description]
    found = queries.QUERIES["op11_merkle_manifest"](spark, sf)
    assert found.columns == names
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(cursor.fetchall()) and {r[-1] for r in rows} == {True, False}

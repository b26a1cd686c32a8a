"""Merkle manifest of a table: a hash tree per group, one tree over the groups, and a proof per row.

Method. A row's leaf is a hash of its fields. Every ``arity`` consecutive nodes have a parent, the hash of their
hashes; a last run is hashed as it is, even if it is one node. While a parent absorbs its children it keeps a
copy of the hash state from before each of them. To fold a changed leaf back into the root, the state kept at its
slot is resumed with the replacement and with the siblings on its right alone; what stands on its left is in
the state.

Trees are built in blocks of ``arity`` to the power of ``LEVELS`` leaves, one row each. Rows find their blocks by
their position in their group (one range exchange), so a hot group has as many blocks as it needs and no task
holds more than a few. The roots of blocks are the leaves of the next round, up to one root per group; groups
then are the leaves of the last tree. Downwards, each block gets the path from its root to the top (the hashes on
the left and on the right, by level), so each row's proof and fold are made beside its block.

Cases. A null field is the text ``-``; so empty and null texts differ. A null group is a group of its own, before the
others. Null keys come first; rows with equal keys are ordered by their leaf, so equal rows need no order. An
empty table gives an empty table. Other columns are not read. A replacement that is null means the leaf itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch
from pathloom.operators.ranking import number_in_order

# levels of a block: 256 leaves for pairs
LEVELS = 8
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """Hash of a row's fields, as lower-case hex."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


class Block:
    """The tree over a run of nodes, with the hash states that its parents keep.

    ``levels``: how far it is raised; None goes on until one node remains.
    """

    def __init__(self, nodes: list[str], arity: int, levels: int | None):
        self.arity = arity
        self.nodes = [nodes]
        # states[i][k]: the state of the parent of node k of level i, before that node
        self.states: list[list] = []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            below, above, states = self.nodes[-1], [], []
            for at in range(0, len(below), arity):
                state = sha256()
                for child in below[at : at + arity]:
                    states.append(state.copy())
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.nodes.append(above)
            self.states.append(states)

    @property
    def root(self) -> str:
        return self.nodes[-1][0]

    def path(self, slot: int) -> list[tuple[str, str]]:
        """Siblings on the left and on the right of a leaf's ancestors, from below."""
        out = []
        for below in self.nodes[:-1]:
            first = slot - slot % self.arity
            out.append(("".join(below[first:slot]), "".join(below[slot + 1 : first + self.arity])))
            slot //= self.arity
        return out

    def fold(self, slot: int, leaf: str) -> str:
        """The root with another leaf at ``slot``."""
        for below, states in zip(self.nodes, self.states):
            state = states[slot].copy()
            state.update(leaf.encode())
            first = slot - slot % self.arity
            for right in below[slot + 1 : first + self.arity]:
                state.update(right.encode())
            leaf = state.hexdigest()
            slot //= self.arity
        return leaf


class Path:
    """The way from a block's root to the top, with the states kept at its slots."""

    def __init__(self, steps: list[dict]):
        self._steps = [(sha256(s["left"].encode()), s["right"].encode()) for s in steps]

    def fold(self, root: str) -> str:
        for kept, right in self._steps:
            state = kept.copy()
            state.update(root.encode())
            state.update(right)
            root = state.hexdigest()
        return root


def _block(nodes: list[str], total: int, arity: int, levels: int) -> Block:
    """A block that is its whole tree is raised to its root, others to their full height."""
    return Block(nodes, arity, None if total <= arity**levels else levels)


def _roots(arity: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                nodes = batch["nodes"][i].values.field("hash").to_pylist()
                found.append(_block(nodes, batch["total"][i].as_py(), arity, levels).root)
            yield pa.record_batch({"grp": batch["grp"], "block": batch["block"], "total": batch["total"], "hash": pa.array(found, pa.string())})

    return run


def _paths(arity: int, levels: int):
    """Path of each node of a block from the path of its root."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes = batch["nodes"][i].values.field("hash").to_pylist()
                block = _block(nodes, batch["total"][i].as_py(), arity, levels)
                above = batch["path"][i].as_py()
                paths = [[{"left": a, "right": b} for a, b in block.path(slot)] + above for slot in range(len(nodes))]
                first = batch["block"][i].as_py() * arity**levels
                yield pa.record_batch({
                    "grp": pa.array([batch["grp"][i].as_py()] * len(nodes), pa.string()),
                    "spot": pa.array(range(first, first + len(nodes)), pa.int64()), "path": pa.array(paths, kind),
                })

    return run


def _proofs(arity: int, levels: int):
    """Rows of a block with their proof and the root that their replacement folds to."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch["nodes"][i].values
                nodes, changed = rows.field("hash").to_pylist(), rows.field("changed").to_pylist()
                block = _block(nodes, batch["total"][i].as_py(), arity, levels)
                steps = batch["path"][i].as_py()
                above = Path(steps)
                folded = [above.fold(block.fold(slot, new or leaf)) for slot, (leaf, new) in enumerate(zip(nodes, changed))]
                paths = [[{"left": a, "right": b} for a, b in block.path(slot)] + steps for slot in range(len(nodes))]
                yield pa.record_batch({
                    "key": rows.field("key"), "grp": pa.array([batch["grp"][i].as_py()] * len(nodes), pa.string()),
                    "leaf": rows.field("hash"), "proof": pa.array(paths, kind), "folded_root": pa.array(folded, pa.string()),
                })

    return run


class _Tree:
    """Blocks of all rounds of the trees of all groups; ``roots`` has ``grp`` and ``hash``."""

    def __init__(self, leaves: DataFrame, arity: int, levels: int, scratch: Scratch, name: str):
        """``leaves``: ``grp``, ``spot`` (from 0), ``total`` of the group, ``hash`` and what the first round is to keep."""
        self.size, self.scratch, self.name = arity**levels, scratch, name
        self.arity, self.levels = arity, levels
        self.rounds: list[DataFrame] = []
        done = []
        while True:
            kept = [c for c in leaves.columns if c not in ("grp", "spot", "total", "hash")]
            blocks = leaves.groupBy("grp", F.floor(F.col("spot") / self.size).alias("block"), "total").agg(
                F.array_sort(F.collect_list(F.struct("spot", "hash", *kept))).alias("nodes")
            )
            blocks = scratch.put(blocks, f"{name}-blocks{len(self.rounds)}")
            self.rounds.append(blocks)
            roots = scratch.put(blocks.mapInArrow(_roots(arity, levels), "grp string, block long, total long, hash string"), f"{name}-roots{len(self.rounds)}")
            done.append(roots.where(F.col("total") <= self.size).select("grp", "hash"))
            above = roots.where(F.col("total") > self.size)
            if above.isEmpty():
                break
            leaves = above.select("grp", F.col("block").alias("spot"), F.ceil(F.col("total") / self.size).alias("total"), "hash")
        self.roots = done[0]
        for more in done[1:]:
            self.roots = self.roots.union(more)

    def with_paths(self, top: DataFrame) -> DataFrame:
        """The first round's blocks with ``path``, from the path ``top`` of each group's root."""
        inner = None
        for i in reversed(range(len(self.rounds))):
            blocks = self.rounds[i]
            last = blocks.where(F.col("total") <= self.size)
            ends = last.join(top.select(F.col("grp").alias("g"), "path"), F.col("grp").eqNullSafe(F.col("g")))
            found = ends.select(*blocks.columns, "path")
            if inner is not None:
                spots = inner.select(F.col("grp").alias("g"), F.col("spot").alias("s"), "path")
                lower = blocks.where(F.col("total") > self.size).join(spots, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("s")))
                found = found.union(lower.select(*blocks.columns, "path"))
            if i == 0:
                return found
            inner = self.scratch.put(found.mapInArrow(_paths(self.arity, self.levels), f"grp string, spot long, path {PATH}"), f"{self.name}-paths{i}")
        raise AssertionError("a tree has a round")


def manifest(
    docs: DataFrame, fields: list[str | Column], key: str = "doc_id", group: str = "lang", replacement: Column | None = None,
    arity: int = 2, levels: int = LEVELS,
) -> DataFrame:
    """Per row ``key``, ``leaf``, ``subroot`` (of its group), ``root``, ``proof`` and ``folded_root``.

    ``proof`` has the siblings of each level, left and right, from the leaf to the root. ``folded_root`` is the root
    that the hash ``replacement`` in place of the leaf leads to.
    """
    if arity < 2:
        raise ValueError("a node has two children or more")
    scratch = Scratch(docs.sparkSession, "manifest")
    values = [F.col(f) if isinstance(f, str) else f for f in fields]
    leaves = docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf_of(*values).alias("hash"),
        (F.lit(None).cast("string") if replacement is None else replacement).alias("changed"),
    )
    placed = number_in_order(leaves, ["grp"], [F.col("key"), F.col("hash")], "spot", "total").withColumn("spot", F.col("spot") - 1)
    trees = _Tree(placed, arity, levels, scratch, "groups")
    subroots = scratch.put(trees.roots.select(F.col("grp").alias("group"), "hash"), "subroots")
    ordered = number_in_order(subroots, [], [F.col("group")], "spot", "total").withColumn("spot", F.col("spot") - 1)
    whole = _Tree(ordered.withColumn("grp", F.lit("")), arity, levels, scratch, "whole")
    root = whole.roots.first()
    top = docs.sparkSession.createDataFrame([("", [])], f"grp string, path {PATH}")
    slots = whole.with_paths(top)
    # each group's place among the groups, with the path from there
    paths = slots.mapInArrow(_paths(arity, levels), f"grp string, spot long, path {PATH}")
    names = slots.select(F.inline("nodes")).select("spot", "group", F.col("hash").alias("subroot"))
    paths = scratch.put(names.join(paths.drop("grp"), "spot").select(F.col("group").alias("grp"), "subroot", "path"), "group-paths")
    kind = leaves.schema["key"].dataType.simpleString()
    found = trees.with_paths(paths).mapInArrow(_proofs(arity, levels), f"key {kind}, grp string, leaf string, proof {PATH}, folded_root string")
    found = found.join(paths.select(F.col("grp").alias("g"), "subroot"), F.col("grp").eqNullSafe(F.col("g")))
    return found.select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(root["hash"] if root else None).alias("root"), "proof", "folded_root"
    )

"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``comp``, the smallest node that it reaches, for each node of the links ``a``, ``b``.

    Each round every node points to its smallest neighbour, and to where that one points; links between
    nodes that point to the same place go. Links shrink at least by half a round, and each round is
    written to the shared folder.
    """
    edges = scratch.put(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    labels, n = None, 0
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        nearest = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to"))
        nearest = scratch.put(nearest, f"{name}-near{n}")
        jump = nearest.select(F.col("node").alias("to"), F.col("to").alias("further"))
        points = scratch.put(nearest.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("to")), f"{name}-points{n}")
        if labels is None:
            labels = points.select("node", F.col("to").alias("comp"))
        else:
            step = points.select(F.col("node").alias("comp"), "to")
            labels = scratch.put(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{name}-labels{n}")
        a, b = points.select(F.col("node").alias("a"), F.col("to").alias("ta")), points.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = edges.join(a, "a").join(b, "b").where("ta <> tb")
        n += 1
        edges = scratch.put(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-edges{n}")
        if edges.isEmpty():
            return labels


def joined(comps: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``comps`` after further ``links`` between the components ``ca`` and ``cb``; a node without one is its own.

    Only the components meet again, each pair of them once; links inside them are not walked again.
    """
    labels = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, name)
    moved = comps.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.put(moved.union(labels.join(comps, "node", "left_anti")), f"{name}-joined")

"""Sources mixed to target sizes by pivotal rounding of copy counts, in DataFrame operations.

Method. A source's rate, its target over its size, is how often each of its documents is taken on average. The
whole part is taken by every document; the fraction is a probability. Pairs of documents settle it: words
move from one to the other, in the direction that chance picks so that no expectation changes, until one of
them has none or all of its words. The other goes on with what it then has. So a source's words stay what
they were, and only its very last document is rounded, to the nearer side: a source misses its target by at
most half a document.

Groups of about ``FAN`` documents are settled first, each leaving at most one; what groups leave is settled in
groups of as many, level by level, up to one per source. A group settles its longest documents first, so
that the shorter ones can round them off. The groups are made by a hash and their number follows the
source's size, so a hot source has many and no group grows with the data. Levels are logarithmic in the
rows and each is stored.

Chance is a hash of the documents that meet and of ``seed``: the same rows give the same result, however they are
split or ordered.

Cases. A null text has no words. Documents without words are taken with none. A null source is a source of its
own. Equal rows (key, source and size) are settled together as one document of many copies, then dealt out
to them; null keys are equal to each other. An empty table gives an empty table. Other columns are not read.
Sources are one row each, with their totals; that table is ordered as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch

FAN = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from ``source`` and ``size`` (one row per source or many).

    Sources in code point order, null last, take ``weights`` in turn and divide ``share`` of all words by them. No
    target is above ``limit`` times the source's size; what is cut off is divided among the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(cycle, (order % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    # the level at which words fill up: sources that reach their cap first come first
    by = Window.orderBy(F.col("cap") / F.col("weight"), "weight", "source")
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (total * F.lit(float(share)) - full) / open_weight).withColumn("nth", F.row_number().over(by))
    below = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))
    level = F.min(below).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) by a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _settle(seed: int, unit: str, done: str):
    """Merge function of one group: the document still open, and those decided."""

    def with_mass(one: Column, mass: Column) -> Column:
        return F.struct(*(one[c].alias(c) for c in ("falls", "h", "key", "size", "m", "whole")), mass.alias("mass"))

    def decided(one: Column, up: Column) -> Column:
        return F.struct(one["key"].alias("key"), one["size"].alias("size"), one["m"].alias("m"), (one["whole"] + up).alias("extra"))

    def meet(acc: Column, new: Column) -> Column:
        old = acc["open"]
        # words that can move to the old one, and to the new one
        moves = F.struct(
            F.least(old["size"] - old["mass"], new["mass"]).alias("up"), F.least(old["mass"], new["size"] - new["mass"]).alias("down")
        )

        def after(move: Column) -> Column:
            rises = _chance(F.lit(seed), old["h"], new["h"]) * (move["up"] + move["down"]) < move["down"]
            return _let(F.struct(rises.alias("rises"), move["up"].alias("up"), move["down"].alias("down")), step)

        def step(x: Column) -> Column:
            rises = x["rises"]
            old_done = F.when(rises, old["size"] - old["mass"] <= new["mass"]).otherwise(old["mass"] <= new["size"] - new["mass"])
            new_done = F.when(rises, new["mass"] <= old["size"] - old["mass"]).otherwise(new["size"] - new["mass"] <= old["mass"])
            moved = F.when(rises, x["up"]).otherwise(-x["down"])
            stays = F.when(old_done & new_done, F.lit(None).cast(unit)).when(old_done, with_mass(new, new["mass"] - moved)).otherwise(with_mass(old, old["mass"] + moved))
            one = F.when(old_done, F.array(decided(old, rises.cast("long")))).otherwise(F.array().cast(done))
            two = F.when(new_done, F.array(decided(new, (~rises).cast("long")))).otherwise(F.array().cast(done))
            return F.struct(stays.alias("open"), F.concat(acc["done"], one, two).alias("done"))

        return F.when(old.isNull(), F.struct(new.alias("open"), acc["done"].alias("done"))).otherwise(_let(moves, after))

    return meet


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0,
    weights: tuple[float, ...] = (3, 1, 2), seed: int = 0, fan: int = FAN,
) -> DataFrame:
    """Per document ``key``, ``source``, ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` (words)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"),
    )
    rows = scratch.put(rows, "rows")
    kind = rows.schema["key"].dataType.simpleString()
    unit = f"struct<falls: bigint, h: bigint, key: {kind}, size: bigint, m: bigint, whole: bigint, mass: double>"
    done = f"array<struct<key: {kind}, size: bigint, m: bigint, extra: bigint>>"

    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"))
    totals = scratch.put(totals, "totals")
    rate = F.col("target") / F.col("source_size")
    depth = F.greatest(F.ceil(F.log(F.col("n") / fan) / F.log(F.lit(float(fan))) - 1e-9), F.lit(0)).cast("int")
    plan = source_targets(totals, share, limit, weights).withColumnRenamed("source", "of")
    plan = plan.join(totals.select("source", "n"), F.col("of").eqNullSafe(F.col("source"))).select(
        "of", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0).alias("each"),
        F.when(F.col("source_size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("fraction"),
        F.when(F.col("n") > 0, depth).otherwise(0).alias("left"),
    )
    plan = scratch.put(plan, "plan")
    same_source = F.col("source").eqNullSafe(F.col("of"))

    classes = rows.where("size > 0").groupBy("source", "key", "size").agg(F.count("*").alias("m"))
    classes = classes.join(plan.select("of", "fraction", "left"), same_source)
    mass = F.col("m") * F.col("fraction")
    classes = classes.select("source", "key", "size", "m", "left", F.floor(mass).alias("whole"), ((mass - F.floor(mass)) * F.col("size")).alias("mass"))
    hashed = F.xxhash64(F.lit(seed), "key", "source", "size")
    classes = scratch.put(classes.withColumn("h", hashed), "classes")
    settled = [classes.where("mass <= 0").select("source", "key", "size", "m", F.col("whole").alias("extra"))]

    open_units = classes.where("mass > 0").select(
        "source", "left", F.pmod("h", F.pow(F.lit(float(fan)), F.col("left")).cast("long")).alias("bucket"),
        F.struct((-F.col("size")).alias("falls"), "h", "key", "size", "m", "whole", "mass").alias("unit"),
    )
    deepest = plan.agg(F.max("left")).first()[0] or 0
    nothing = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(done).alias("done"))
    for level in range(deepest + 1):
        groups = open_units.groupBy("source", "left", "bucket").agg(F.array_sort(F.collect_list("unit")).alias("units"))
        found = groups.select("source", "left", "bucket", F.aggregate("units", nothing, _settle(seed + level, unit, done)).alias("x"))
        found = scratch.put(found.select("source", "left", "bucket", "x.open", "x.done"), f"level{level}")
        settled.append(found.select("source", F.inline("done")))
        rises = 2 * F.col("open.mass") >= F.col("open.size")
        last = found.where("left = 0 AND open IS NOT NULL")
        settled.append(last.select("source", "open.key", "open.size", "open.m", (F.col("open.whole") + rises.cast("long")).alias("extra")))
        open_units = found.where("left > 0 AND open IS NOT NULL").select(
            "source", (F.col("left") - 1).alias("left"), F.expr(f"bucket div {fan}").alias("bucket"), F.col("open").alias("unit")
        )
    extra = reduce(DataFrame.union, settled).select(*(F.col(c).alias(f"x_{c}") for c in ("source", "key", "size")), "m", "extra")
    same_class = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in ("source", "key", "size")))
    found = scratch.put(rows.join(extra, same_class, "left").select("row", "part", "key", "source", "size", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("extra", F.lit(0)).alias("extra")), "settled")

    # equal rows: the first of them get one more, counted by part, so that a class of many rows is in no one task
    single = found.where("m = 1").select("key", "source", "size", "extra")
    many = found.where("m > 1")
    within = many.withColumn("nth", F.row_number().over(Window.partitionBy("key", "source", "size", "part").orderBy("row")))
    counts = many.groupBy("key", "source", "size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key", "source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"x_{c}") for c in ("source", "key", "size", "part")), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    dealt = within.join(counts, same_class & (F.col("part") == F.col("x_part")))
    dealt = dealt.select("key", "source", "size", (F.col("nth") + F.col("before") <= F.col("extra")).cast("long").alias("extra"))

    out = single.union(dealt).join(plan, same_source)
    copies = F.when(F.col("size") > 0, F.col("each") + F.col("extra")).otherwise(0).cast("long")
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

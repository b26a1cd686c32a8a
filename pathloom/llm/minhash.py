"""Near-duplicate documents by MinHash tables with tensored keys, and exact similarity.

Method. Two collections of ``bands`` short keys of ``rows`` minhashes each are made per document; every pair
of a key of the first and a key of the second collection is the key of a table. So bands * bands tables
need 2 * bands * rows minhashes, about the square root of what separate tables would. Documents at
similarity s share a table unless one collection has no equal key: both hold one with
(1 - (1 - s^rows)^bands)^2, which is above 0.9996 at 0.8 for 12 bands of 3 and rises steeply above.

Only short keys that some other document has can be part of a shared table key, so the pairs are formed
of these alone. Documents with equal sets are one class from the start.

Links are confirmed on full sets of 64-bit shingle hashes. No bucket's pairs are all listed: members of a
bucket are compared with one leader; links join components; then buckets that still hold several
components compare who is outside their largest one with all members, in blocks of about ``CHUNK`` of each. Signatures,
set sizes and parity sketches rule out pairs before texts are read. After that no pair of a bucket is untested
unless both are already connected.

A parity sketch holds, for each of ``SKETCH_BITS`` cells, whether an odd number of the set's shingles fall
there. Common shingles cancel in the XOR of two sketches, so its ones never outnumber the shingles that only
one set has. More ones than a link allows prove that there is none; sets too large for the sketch pass.

Cases. Documents without words have an empty set and no links. Rows with equal keys are documents of their
own; null keys are allowed and are never a component's smallest key unless all are null. Whole texts
count, whatever their length. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.components import components, joined
from pathloom.llm.scratch import ROW_BITS, Scratch, by_part, frugal, rows_beside, with_row
from pathloom.llm.shingles import mixed, shingle_sets

CHUNK = 1000
# orders in which a bucket's leader is the first: more of them connect a large group in the first rounds
ORDERS = 16
# a power of two; sketches tell sets apart that differ in up to about as many shingles
SKETCH_BITS = 2048
U = np.uint64


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return seeds[:count] | U(1), seeds[count:]


def minhashes(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    least = np.full(len(multiply), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * multiply + add).min(axis=0))
    return least


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each cell, packed; the cell is the hash's lowest bits."""
    cells = (hashes & U(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def _may_link(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """False where the sketches ``x`` and ``y`` (64-bit words) prove less than ``percent`` in common."""
    ones = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (100 + percent) * ones <= (100 - percent) * sizes


def _sketches(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), SKETCH_BITS // 64)


def _sign(words: int, bands: int, rows: int):
    multiply, add = _functions(2 * bands * rows)
    place = np.arange(1, 2 * bands + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, halves, signs, odds = [], [], [], [], [], []
            for one in shingle_sets(batch["text"], words):
                sizes.append(len(one))
                first.append(int(one.sum(dtype=np.uint64).view(np.int64)) if len(one) else 0)
                again = mixed(one)
                second.append(int(np.bitwise_xor.reduce(again).view(np.int64)) if len(one) else 0)
                if not len(one):
                    halves.append([])
                    signs.append(b"")
                    odds.append(b"")
                    continue
                odds.append(parity_sketch(again).tobytes())
                least = minhashes(one, multiply, add)
                key = place.copy()
                for j in range(rows):
                    key = mixed(key * U(0x9E3779B97F4A7C15) + least.reshape(2 * bands, rows)[:, j])
                halves.append(key.view(np.int64))
                signs.append((least >> U(56)).astype(np.uint8).tobytes())
            # a batch at a time, so that signatures of few documents are held
            yield pa.record_batch({
                "row": batch["row"], "key": batch["key"], "n": pa.array(sizes, pa.int64()),
                "d1": pa.array(first, pa.int64()), "d2": pa.array(second, pa.int64()),
                "halves": pa.array(halves, pa.list_(pa.int64())), "sign": pa.array(signs, pa.binary()),
                "odd": pa.array(odds, pa.binary()),
            })

    return run


def _held(folder: str, keep: bool = True):
    """The rows that were stored for the part, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = None, -1
        for part, batch in (x for whole in batches for x in by_part(whole)):
            if part != known:
                found, known = rows_beside(folder, part, ["rep"]), part
                wanted = np.zeros(0, np.int64) if found is None else np.unique(found["rep"].to_numpy())
            yield batch.filter(pa.array(np.isin(batch["row"].to_numpy(), wanted, invert=not keep)))

    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            rows = batch["a"].to_numpy()
            new = np.append(True, rows[1:] != rows[:-1])
            if batch.num_rows and rows[0] == last:
                new[0] = False
            left = shingle_sets(batch["ta"].filter(pa.array(new)), words)
            keep = []
            for fresh, right in zip(new.tolist(), shingle_sets(batch["tb"], words)):
                if fresh:
                    kept = next(left)
                both = np.concatenate([kept, right])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            if batch.num_rows:
                last = rows[-1]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _least_matches(functions: int, similarity: float) -> int:
    """Fewer equal minhashes than this are as good as impossible at ``similarity`` (five deviations)."""
    return max(0, int(functions * similarity - 5 * (functions * similarity * (1 - similarity)) ** 0.5))


def _cross(percent: int, least: int, bands: int):
    """Pairs of different components of two sides of each block; rows come sorted by block and side.

    Documents that share several buckets are paired in the first of them only.
    """

    def pairs(block: pa.Table) -> np.ndarray:
        side = block["side"].to_numpy()
        cut = int(np.searchsorted(side, 1))
        if cut in (0, len(side)):
            return np.zeros((0, 2), np.int64)
        (n0, c0, r0, s0, h0, o0), (n1, c1, r1, s1, h1, o1) = (
            (
                s["n"].to_numpy(), s["comp"].to_numpy(), s["rep"].to_numpy(),
                np.frombuffer(b"".join(s["sign"].to_pylist()), np.uint8).reshape(len(s), -1),
                np.array(s["halves"].to_pylist(), np.int64), _sketches(s["odd"].to_pylist()),
            ) for s in (block.slice(0, cut), block.slice(cut))
        )
        place = block["place"][0].as_py()
        out = []
        for i in range(len(n0)):
            some = np.flatnonzero((c1 != c0[i]) & (100 * np.minimum(n1, n0[i]) >= percent * np.maximum(n1, n0[i])))
            if len(some):
                some = some[(s1[some] == s0[i]).sum(axis=1) >= least]
                some = some[_may_link(o1[some], o0[i], n1[some] + n0[i], percent)]
                equal = h1[some] == h0[i]
                some = some[equal[:, :bands].argmax(axis=1) * bands + equal[:, bands:].argmax(axis=1) == place]
                out.append(np.stack([np.minimum(r0[i], r1[some]), np.maximum(r0[i], r1[some])], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        both = pairs(block)
        if len(both):
            yield pa.record_batch({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("bucket", "ci", "cj")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if held and (keys[begin] != last).any():
                    yield from found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = keys[begin]
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str | Column = "text", words: int = 5, percent: int = 80,
    bands: int = 12, rows: int = 3,
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key of the component) and ``stays``.

    ``stays`` marks one row of each component, the first with its smallest key. Linked are documents with
    100 * common shingles >= ``percent`` * all shingles.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    source = F.col(text) if isinstance(text, str) else text
    table = with_row(docs, [F.col(key).alias("key"), source.cast("string").alias("text")], scratch)
    return _classes(table, scratch, words, percent, bands, rows).drop("row").withColumnRenamed("key", key)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 12, rows: int = 3) -> DataFrame:
    """One document of each component, with all its columns. Texts are filtered where they are read."""
    scratch = Scratch(docs.sparkSession, "minhash")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = with_row(docs, [F.col(c).alias(n) for c, n in names.items()], scratch)
    table = whole.select("row", F.col(names[key]).alias("key"), F.col(names[text]).cast("string").alias("text"))
    classes = _classes(table, scratch, words, percent, bands, rows)
    gone = classes.where(~F.col("stays")).select(F.shiftright("row", ROW_BITS).cast("int").alias("part"), F.col("row").alias("rep"))
    left = whole.mapInArrow(_held(scratch.beside(gone, "gone"), keep=False), whole.schema)
    scratch.drop_others("input", "gone")
    return left.select(*(F.col(n).alias(c) for c, n in names.items()))


def _classes(table: DataFrame, scratch: Scratch, words: int, percent: int, bands: int, rows: int) -> DataFrame:
    kind = table.schema["key"].dataType.simpleString()
    signed = table.mapInArrow(
        frugal(_sign(words, bands, rows)), f"row long, key {kind}, n long, d1 long, d2 long, halves array<bigint>, sign binary, odd binary"
    )
    signed = scratch.put(signed, "signed")
    classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("rep"))
    member = scratch.put(signed.where("n > 0").select("row", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("row", "rep"), "member")
    halves = signed.join(member.where("row = rep").select("row"), "row", "left_semi").select(F.col("row").alias("rep"), F.posexplode("halves").alias("place", "half"))
    halves = scratch.put(halves, "halves")
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    per = halves.join(shared, "half").groupBy("rep").agg(*(F.collect_list(F.when(which, F.struct("place", "half"))).alias(n) for n, which in (("l", F.col("place") < bands), ("r", F.col("place") >= bands))))
    pair = F.transform("l", lambda x: F.transform("r", lambda y: F.struct(F.xxhash64(x["half"], y["half"]).alias("bucket"), (x["place"] * bands + y["place"] - bands).alias("place"))))
    keys = per.select("rep", F.inline(F.flatten(pair)))
    keys = scratch.put(keys, "keys")
    order = F.struct(F.xxhash64(F.pmod("bucket", F.lit(ORDERS)), "rep"), "rep")
    leaders = keys.groupBy("bucket").agg(F.count("*").alias("c"), F.min(order).alias("first")).where("c > 1").select("bucket", "c", F.col("first.rep").alias("leader"))
    buckets = scratch.put(keys.join(leaders, "bucket"), "buckets")
    scratch.drop("halves", "keys")

    involved = buckets.select("rep").distinct()
    wanted = scratch.beside(involved.select(F.shiftright("rep", ROW_BITS).cast("int").alias("part"), "rep"), "wanted")
    texts = scratch.put(table.select("row", "text").mapInArrow(_held(wanted), "row long, text string"), "texts")
    facts = scratch.put(signed.join(involved.withColumnRenamed("rep", "row"), "row", "left_semi").select("row", "n", "sign", "odd", "halves"), "facts")

    least = _least_matches(2 * bands * rows, percent / 100)

    @F.arrow_udf("int")
    def matches(x: pa.Array, y: pa.Array, ox: pa.Array, oy: pa.Array, sizes: pa.Array) -> pa.Array:
        """Equal minhashes; -1 where the sketches rule out a link."""
        if not len(x):
            return pa.array([], pa.int32())
        left, right = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (x, y))
        may = _may_link(_sketches(ox.to_pylist()), _sketches(oy.to_pylist()), sizes.to_numpy(), percent)
        return pa.array(np.where(may, (left == right).sum(axis=1), -1), pa.int32())

    def side(name: str) -> DataFrame:
        return facts.select(F.col("row").alias(name), F.col("n").alias(f"n{name}"), F.col("sign").alias(f"s{name}"), F.col("odd").alias(f"o{name}"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), texts.select(F.col("row").alias("b"), F.col("text").alias("tb"))
        both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
        return scratch.put(both.mapInArrow(frugal(_verify(words, percent)), "a long, b long"), name)

    pairs = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", matches("sa", "sb", "oa", "ob", F.col("na") + F.col("nb")).alias("same")).where(F.col("same") >= least)
    pairs = scratch.put(pairs, "pairs")
    nearest = pairs.groupBy("b").agg(F.max(F.struct("same", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    nearest = scratch.put(nearest, "nearest")
    comps = components(verified(nearest, "links0"), scratch, "c0")

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        a, b = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        both = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
        return both.where("ca <> cb")

    # a large group has many pairs between the same two components: their best one is tested first, and most others fall away
    rest = scratch.put(across(pairs.join(nearest, ["a", "b"], "left_anti"), comps), "rest")
    best = rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("same", "a", "b")).alias("x")).select("x.a", "x.b")
    best = scratch.put(best, "best")
    comps = joined(comps, across(verified(best, "links1"), comps), scratch, "c1")
    rest = across(rest.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    comps = joined(comps, across(verified(rest, "links2"), comps), scratch, "c2")

    # buckets that still hold several components, in blocks
    placed = buckets.select("bucket", "place", "c", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    held = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = held.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("members"))
    largest = largest.where("members > x.n").select("bucket", F.col("x.comp").alias("main"), (F.col("members") - F.col("x.n")).alias("outside"))
    placed = placed.join(largest, "bucket").join(facts.withColumnRenamed("row", "rep"), "rep")
    # who is outside a bucket's largest component is compared with all members, in blocks
    few, all_of = (F.ceil(F.col(c) / CHUNK).cast("int") for c in ("outside", "c"))
    chunk = F.pmod(F.xxhash64("rep"), all_of).cast("int")
    facts_of = ["rep", "comp", "n", "sign", "odd", "halves"]
    outside = placed.where("comp <> main").withColumn("ci", F.pmod(F.xxhash64("rep"), few).cast("int"))
    outside = outside.select("bucket", "place", "ci", F.explode(F.sequence(F.lit(0), all_of - 1)).alias("cj"), F.lit(0).alias("side"), *facts_of)
    members = placed.select("bucket", "place", F.explode(F.sequence(F.lit(0), few - 1)).alias("ci"), chunk.alias("cj"), F.lit(1).alias("side"), *facts_of)
    blocks = outside.union(members).repartition("bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj", "side")
    found = blocks.mapInArrow(frugal(_cross(percent, least, bands)), "a long, b long").distinct()
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = scratch.put(found.join(tested, ["a", "b"], "left_anti"), "found")
    comps = joined(comps, across(verified(found, "links3"), comps), scratch, "c3")

    comp = member.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("row", F.coalesce("comp", "rep").alias("comp"))
    whole = signed.select("row", "key", "n").join(comp, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    whole = scratch.put(whole, "classes")
    scratch.drop_others("input", "classes")
    smallest = whole.groupBy("comp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("x"))
    return whole.join(smallest, "comp").select(
        "row", "key", F.col("n").alias("n_shingles"), F.col("x.key").alias("component_id"), (F.col("row") == F.col("x.row")).alias("stays")
    )

"""Documents packed into as few token sequences as possible.

Method. Large-item matching: pieces above a third of the capacity are paired at most twice per sequence,
the largest with the largest that fits beside it; smaller pieces, longest first, go where the gap that
they leave is least. Only lengths matter for this, so the plan is made once for the counts of each length
(at most ``capacity`` numbers, whatever the input), with runs of equal sequences kept as one entry. Each
piece then finds its place by its rank among the pieces of its length: its rank in its part, which the
task that cuts it knows, plus the pieces of that length in earlier parts.

Cases. A null text is an empty one; with ``end_id`` it still has one id, without it has no piece.
Repeated rows and ids are packed as separate documents. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch, frugal
from pathloom.llm.tokens import encoder


def _cut(path: str, capacity: int, end_id: int | None, small: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tokens = encoder(path, small)
        for batch in batches:
            ids, ends = tokens.encode(batch["text"])
            starts = np.append(0, ends[:-1])
            sizes = ends - starts + (end_id is not None)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = piece * capacity
            length = np.minimum(sizes[owner] - begin, capacity)
            raw = []
            for o, b, n in zip(owner.tolist(), begin.tolist(), length.tolist()):
                found = ids[starts[o] + b : min(starts[o] + b + n, ends[o])]
                raw.append((found if len(found) == n else np.append(found, np.uint32(end_id))).astype("<u4").tobytes())
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - first
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.record_batch({
                "doc": batch["doc"].take(pa.array(owner)),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(begin, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids": pa.array(raw, pa.binary()),
                "part": pa.array(np.full(len(owner), part), pa.int32()), "rank": pa.array(rank, pa.int64()),
            })

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, scratch: Scratch, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text", small: bool = False) -> DataFrame:
    """Stored pieces of the documents: the key as ``doc``, ``piece``, ``start``, ``length``, ``ids`` (unsigned little-endian 32 bit), ``part`` and ``rank`` among the pieces of that length in the part."""
    df = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = df.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, piece int, start long, length long, ids binary, part int, rank long"
    return scratch.put(df.mapInArrow(frugal(_cut(tokenizer, capacity, end_id, small)), schema), "pieces")


class Plan:
    """Places of all pieces by length and rank. Lists run in step: pieces of one length in equal sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self._gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        left = {n: c for n, c in counts.items() if c > 0}
        self._match(sorted((n for n in left if 3 * n > capacity), reverse=True), left)
        for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fit(length, left[length])

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.slots[length].append((count, first, each, offset))

    def _match(self, lengths: list[int], left: dict[int, int]) -> None:
        """Pairs of large pieces; a piece without a partner opens a sequence alone."""
        for length in lengths:
            while left[length]:
                mate = next((m for m in lengths if m + length <= self.capacity and m <= length and left[m] and (m < length or left[m] > 1)), None)
                if mate is None:
                    n = left[length]
                    first = self._open(n)
                    self._put(length, n, first, 1, 0)
                    left[length] = 0
                    self._gap(self.capacity - length, first, n)
                    continue
                n = left[length] // 2 if mate == length else min(left[length], left[mate])
                first = self._open(n)
                self._put(length, n, first, 1, 0)
                self._put(mate, n, first, 1, length)
                left[length] -= n
                left[mate] -= n
                self._gap(self.capacity - length - mate, first, n)

    def _gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            self._gaps[gap].append((first, count))

    def _fit(self, length: int, count: int) -> None:
        """Best fit of equal small pieces: always the sequence with the least gap that holds one."""
        while count:
            gap = min((g for g in self._gaps if g >= length), default=0)
            if gap:
                first, n = self._gaps[gap].pop()
                if not self._gaps[gap]:
                    del self._gaps[gap]
            else:
                gap, n = self.capacity, -(-count // (self.capacity // length))
                first = self._open(n)
            each = gap // length
            full = min(n, count // each)
            offset = self.capacity - gap
            if full:
                self._put(length, full * each, first, each, offset)
                self._gap(gap - each * length, first, full)
                count -= full * each
            if full < n and count:
                self._put(length, count, first + full, count, offset)
                self._gap(gap - count * length, first + full, 1)
                count, full = 0, full + 1
            self._gap(gap, first + full, n - full)

    def table(self) -> dict[str, np.ndarray]:
        """Slots by length and first rank, and where each length begins."""
        rows, begin = [], np.zeros(self.capacity + 2, np.int64)
        total = 0
        for length in range(self.capacity + 1):
            begin[length] = total
            for count, first, each, offset in self.slots.get(length, ()):
                rows.append((total, first, each, offset, length))
                total += count
        start, first, each, offset, length = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        return {"begin": begin, "start": start, "first": first, "each": each, "offset": offset, "length": length}


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (``part``, ``rank`` and ``length`` among their columns) with ``sequence_id`` and ``offset``.

    ``pieces`` must be a stored table, since it is read twice.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one number for each length: at most `capacity` of them
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(totals, capacity).table()

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        at = plan["begin"][length.to_numpy()] + rank.to_numpy()
        slot = np.searchsorted(plan["start"], at, "right") - 1
        nth = at - plan["start"][slot]
        each = plan["each"][slot]
        sequence, offset = plan["first"][slot] + nth // each, plan["offset"][slot] + nth % each * plan["length"][slot]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("spot", place("length", F.col("rank") + F.col("before")))
    return ranked.select(*(c for c in pieces.columns if c not in ("part", "rank")), "spot.sequence_id", "spot.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each piece with its ids, its sequence and its place there."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = cut_pieces(docs, tokenizer, scratch, capacity, end_id, key, text, small=True)
    return place_pieces(pieces, capacity).withColumnRenamed("doc", key)

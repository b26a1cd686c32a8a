"""Nearest vectors of stated queries by blocks of an int8 matrix product with error bounds.

Method. Vectors are laid out in tiles. A tile keeps its vectors and their int8 codes (one scale per tile) with the
exact length of what rounding took from each. A product of two tiles of codes gives the distances between
the rounded vectors; by the triangle inequality the true distance differs by at most both rounding lengths.
A query's candidates whose least possible distance is above the k-th smallest largest possible one are out;
the others are recomputed in double precision and merged into the query's heap, whose k-th entry tightens
the bound for the next tile. So the result is exact.

Spread. Query tiles meet groups of candidate tiles, one task for each such pair, so work is split on both
sides; a task emits at most k rows a query.

Cases. Vectors that are null, empty, all zero, or hold null or non-finite parts take no part, nor do rows
without id. Rows with equal ids count once, with the smallest of their vectors. Vectors of other lengths
than a query's are not its candidates. Ties go to the smaller id. A query with fewer candidates gets all of
them. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch

TILE = 2048
TILES_PER_TASK = 4
# more than floating point can lose in the distances of codes
SLACK = 1e-6


def encode_tile(vectors: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Int8 codes, their scale, and the length of each vector's rounding error."""
    scale = float(np.abs(vectors).max()) / 127 or 1.0
    codes = np.rint(vectors / scale).astype(np.int8)
    return codes, scale, np.sqrt(((vectors - codes * scale) ** 2).sum(axis=1))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_numpy()
        lists = batch["vector"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        for width in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == width)
            for at in range(0, len(rows), TILE):
                some = rows[at : at + TILE]
                vectors = flat[starts[some][:, None] + np.arange(width)]
                yield pa.record_batch({
                    "width": pa.array([width], pa.int32()), "ids": pa.array([ids[some].astype("<i8").tobytes()], pa.binary()),
                    "vectors": pa.array([vectors.astype("<f8").tobytes()], pa.binary()),
                })


class _Side:
    def __init__(self, width: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(len(self.ids), width)
        self.codes, self.scale, self.error = encode_tile(self.vectors)
        self.codes = self.codes.astype(np.float32)  # sums of products of codes stay exact below 2^24
        self.square = (self.codes.astype(np.float64) ** 2).sum(axis=1) * self.scale**2


def _merge(heaps: list[list], queries: _Side, tile: _Side, k: int) -> None:
    """Candidates of ``tile`` that can be among a query's k nearest, into its heap of (-distance, -id)."""
    width = queries.codes.shape[1]
    step = max(1, (1 << 24) // (127 * 127))
    product = sum(
        (queries.codes[:, i : i + step] @ tile.codes[:, i : i + step].T).astype(np.float64) for i in range(0, width, step)
    ) * (queries.scale * tile.scale)
    near = np.sqrt(np.maximum(queries.square[:, None] + tile.square[None, :] - 2 * product, 0))
    error = queries.error[:, None] + tile.error[None, :] + SLACK * (1 + near)
    near[queries.ids[:, None] == tile.ids[None, :]] = np.inf
    most = near + error
    if most.shape[1] > k:
        bound = np.partition(most, k - 1, axis=1)[:, k - 1]
    else:
        bound = np.full(len(heaps), np.inf)
    bound = np.minimum(bound, [-h[0][0] if len(h) == k else np.inf for h in heaps])
    for q, c in _rows((near - error <= bound[:, None]) & np.isfinite(near)):
        exact = np.sqrt(((tile.vectors[c] - queries.vectors[q]) ** 2).sum(axis=1))
        heap = heaps[q]
        for d, i in zip(exact.tolist(), tile.ids[c].tolist()):
            if len(heap) < k:
                heapq.heappush(heap, (-d, -i))
            elif (-d, -i) > heap[0]:
                heapq.heapreplace(heap, (-d, -i))


def _rows(mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for q in np.flatnonzero(mask.any(axis=1)).tolist():
        yield q, np.flatnonzero(mask[q])


def _search(k: int):
    def emit(queries: _Side, heaps: list[list]) -> pa.RecordBatch:
        rows = [(q, -i, -d) for q, heap in zip(queries.ids.tolist(), heaps) for d, i in heap]
        query, other, distance = zip(*rows) if rows else ((), (), ())
        return pa.record_batch({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(other, pa.int64()), "score": pa.array(distance, pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted: a query tile, then the candidate tiles of its group
        queries, heaps, key = None, [], None
        for batch in batches:
            for block, group, kind, width, ids, vectors in zip(*(batch[c].to_pylist() for c in ("block", "grp", "kind", "width", "ids", "vectors"))):
                if kind == 0:
                    if queries is not None:
                        yield emit(queries, heaps)
                    queries, key = _Side(width, ids, vectors), (block, group)
                    heaps = [[] for _ in queries.ids]
                elif key == (block, group):
                    _merge(heaps, queries, _Side(width, ids, vectors), k)
        if queries is not None:
            yield emit(queries, heaps)

    return run


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the Euclidean distance, for each row that ``is_query`` holds for."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    df = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("q"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    df = df.where(F.col("id").isNotNull() & sound)
    df = df.groupBy("id").agg(F.min("vector").alias("vector"), F.max("q").alias("q"))
    df = scratch.put(df, "vectors")
    schema = "width int, ids binary, vectors binary"
    queries = df.where("q").select("id", "vector").mapInArrow(_tiles, schema)
    queries = scratch.put(queries.withColumn("block", F.monotonically_increasing_id()), "queries")
    tiles = scratch.put(df.select("id", "vector").mapInArrow(_tiles, schema).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    groups = max(1, -(-tiles.count() // TILES_PER_TASK))
    grp = F.pmod(F.xxhash64("tile"), F.lit(groups))
    ours = queries.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tile"), "width", "ids", "vectors")
    blocks = queries.select("block", "width")
    # every query tile against every tile of its width: the stated queries against all rows, in blocks
    theirs = tiles.join(blocks, "width").select("block", grp.alias("grp"), F.lit(1).alias("kind"), "tile", "width", "ids", "vectors")
    pairs = ours.union(theirs).repartition("block", "grp").sortWithinPartitions("block", "grp", "kind", "tile")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

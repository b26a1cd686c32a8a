"""Tables that a job writes to the shared folder, and files that its tasks read there."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import delete_folder, stored_folder

# monotonically_increasing_id() holds the partition above these bits
ROW_BITS = 33


class Scratch:
    """A new folder below the shared one. Tables stay until ``drop``, or ``session.clear_stored`` for all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = stored_folder(spark, name)
        self._names: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back: its tasks never run again."""
        path = f"{self.root}/{name}"
        self._names.append(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def beside(self, df: DataFrame, name: str) -> str:
        """``df`` stored by its column ``part``, so the task of a part can read its rows alone."""
        path = f"{self.root}/{name}"
        self._names.append(name)
        df.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
        return path

    def drop_others(self, *kept: str) -> None:
        """Delete all tables but those named."""
        self.drop(*(n for n in self._names if n not in kept))

    def drop(self, *names: str) -> None:
        self._names = [n for n in self._names if n not in names]
        for name in names:
            delete_folder(self.spark, f"{self.root}/{name}")


def with_row(docs: DataFrame, columns: list, scratch: Scratch) -> DataFrame:
    """``columns`` of ``docs`` after a column ``row``, written once: the number stays with its row, however it is read.

    Rows written by one task have the same number above ``ROW_BITS``, their part.
    """
    df = docs.select(*columns)
    return scratch.put(df.select(F.monotonically_increasing_id().alias("row"), *df.columns), "input")


def by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one part. A task may read several parts, or a piece of one."""
    if not batch.num_rows:
        return
    parts = batch["row"].to_numpy() >> ROW_BITS
    edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
    for begin, end in zip(edges, edges[1:]):
        yield int(parts[begin]), batch.slice(begin, end - begin)


def give_back() -> None:
    """Memory that this Python process no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        # only this C library can be told to
        return


def frugal(run):
    """``run`` for a Python worker that lives on: memory that its last batch used goes back to the system."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder all executors share."""
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def rows_beside(path: str, part: int, columns: list[str]) -> pa.Table | None:
    """The rows that ``Scratch.beside`` stored for ``part``; None if there are none."""
    system, plain = file_system(path)
    folder = f"{plain}/part={part}"
    if system.get_file_info(folder).type != fs.FileType.Directory:
        return None
    return ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=columns)

"""Token ids in files of independent zstandard frames, with a seek table at the end.

A file holds the documents of one range of ids, in order: frames of 32-bit little-endian ids, a skippable
frame with the index of its documents, and the seek table of the public seekable format (a skippable
frame of compressed size, size and checksum of each frame; the checksum is the low half of xxHash64). Any
zstandard program decompresses the file to the plain ids. A reader opens the end of a file, finds the
frames of the documents asked for, and decompresses these alone.

A task writes one file under a new name and reports it; only reported files belong to the output, so files
of failed or repeated attempts are never read. The manifest has a row per file.

Cases. A null text is an empty one and has the end id alone. Null keys come first; rows with equal keys are
ordered by a hash of their text. Long texts run over several frames. An empty table writes no file and
reads as no rows. Other columns are not written.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.scratch import file_system, frugal
from pathloom.llm.tokens import encoder

# fixed values of the seekable format
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_IDS = 64 * 1024
NO_KEY = np.iinfo(np.int64).min


class FrameWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, sink, level: int = 3):
        self._sink = sink
        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._table: list[tuple[int, int, int]] = []
        self._held: list[np.ndarray] = []
        self._size = 0
        self._keys: list[np.ndarray] = []
        self._ends: list[np.ndarray] = []
        self.documents = 0
        self.ids = 0
        self.bytes = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self._keys.append(keys)
        self._ends.append(ends + self.ids)
        self.documents += len(keys)
        self.ids += len(ids)
        at = 0
        while at < len(ids):
            piece = ids[at : at + FRAME_IDS - self._size]
            self._held.append(piece)
            self._size += len(piece)
            at += len(piece)
            if self._size == FRAME_IDS:
                self._flush()

    def _write(self, data: bytes) -> None:
        self._sink.write(data)
        self.bytes += len(data)

    def _flush(self) -> None:
        if self._size:
            raw = np.concatenate(self._held).astype("<u4").tobytes()
            packed = self._zstd.compress(raw)
            self._table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._write(packed)
            self._held, self._size = [], 0

    def close(self) -> None:
        self._flush()
        keys = np.concatenate([np.zeros(0, np.int64), *self._keys]).astype("<i8")
        ends = np.concatenate([np.zeros(0, np.int64), *self._ends]).astype("<i8")
        index = self._zstd.compress(keys.tobytes() + np.diff(ends, prepend=0).astype("<i8").tobytes())
        self._write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self._table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self._table)
        self._write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self._table), 0x80, SEEKABLE_MAGIC))


class FrameReader:
    """Reads one file: its index at once, frames as they are asked for."""

    def __init__(self, source):
        self._source = source
        self.frames_read = 0
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self._packed, self._sizes, self._sums = table.T
        self._places = np.cumsum(self._packed) - self._packed
        self._ends = np.cumsum(self._sizes)
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self._places[-1]) + 8, int(self._packed[-1]) - 8))
        both = np.frombuffer(index, "<i8")
        self.keys, self.counts = both[: len(both) // 2], both[len(both) // 2 :]
        self.starts = np.cumsum(self.counts) - self.counts
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self._source.seek(place)
        return self._source.read(size)

    def _frame(self, number: int) -> bytes:
        if self._last[0] != number:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self._places[number]), int(self._packed[number])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self._sums[number]:
                raise ValueError(f"checksum of frame {number} differs")
            self.frames_read += 1
            self._last = (number, raw)
        return self._last[1]

    def document(self, number: int) -> bytes:
        """Ids of one document of the file, as bytes."""
        begin = 4 * int(self.starts[number])
        end = begin + 4 * int(self.counts[number])
        out = []
        frame = int(np.searchsorted(self._ends, begin, "right"))
        while begin < end:
            top = int(self._ends[frame])
            base = top - int(self._sizes[frame])
            out.append(self._frame(frame)[begin - base : min(end, top) - base])
            begin, frame = min(end, top), frame + 1
        return b"".join(out)


def _write(folder: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, writer, stream = encoder(tokenizer), None, None
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, plain = file_system(folder)
                system.create_dir(plain, recursive=True)
                stream = system.open_output_stream(f"{plain}/{name}", compression=None)
                writer = FrameWriter(stream)
            ids, ends = tokens.encode(batch["text"])
            if end_id is not None:
                ids = np.insert(ids, ends, np.uint32(end_id))
                ends = ends + np.arange(1, len(ends) + 1)
            keys = batch["key"].fill_null(NO_KEY).to_numpy()
            low, high = keys[0] if low is None else low, keys[-1]
            writer.add(keys, ids, ends)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.record_batch({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name],
                "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64()),
                "documents": pa.array([writer.documents], pa.int64()), "ids": pa.array([writer.ids], pa.int64()),
                "bytes": pa.array([writer.bytes], pa.int64()),
            })

    return run


MANIFEST = "part int, file string, low long, high long, documents long, ids long, bytes long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to ``folder`` in ascending order of ``key``; the stored manifest."""
    df = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = df.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("key").asc_nulls_first(), "tie").sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
    ordered.select("key", "text").mapInArrow(frugal(_write(f"{folder}/data", tokenizer, end_id)), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of ``folder`` with ``start``, the ids in the files before. One row per file is ordered, no more."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


READ = "key long, start long, n_tokens long, ids binary"


def _read(folder: str, wanted: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, plain = file_system(folder)
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                with system.open_input_file(f"{plain}/{file}") as source:
                    yield from _documents(FrameReader(source), base, wanted)

    return run


def _documents(reader: FrameReader, base: int, wanted: frozenset | None) -> Iterator[pa.RecordBatch]:
    rows = np.arange(len(reader.keys)) if wanted is None else np.flatnonzero(np.isin(reader.keys, list(wanted)))
    for at in range(0, len(rows), 1000):
        some = rows[at : at + 1000]
        keys = reader.keys[some]
        yield pa.record_batch({
            "key": pa.array(keys, pa.int64(), mask=keys == NO_KEY),
            "start": pa.array(reader.starts[some] + base, pa.int64()), "n_tokens": pa.array(reader.counts[some], pa.int64()),
            "ids": pa.array([reader.document(i) for i in some.tolist()], pa.binary()),
        })


def read_ids(spark: SparkSession, folder: str, keys: list[int] | None = None) -> DataFrame:
    """Documents of ``folder``: ``key``, ``start``, ``n_tokens`` and ``ids``.

    With ``keys``, only files whose range holds one of them are opened and only their frames are read.
    """
    files = read_manifest(spark, folder)
    wanted = None
    if keys is not None:
        wanted = frozenset(keys)
        inside = F.lit(False)
        for k in wanted:
            inside = inside | F.lit(k).between(F.col("low"), F.col("high"))
        files = files.where(inside)
    # one row per file: as many tasks as files
    return files.repartition(max(1, files.count())).select("file", "start").mapInArrow(frugal(_read(f"{folder}/data", wanted)), READ)


def crc32_of(ids: str | Column) -> Column:
    """Unsigned CRC-32 of ids as they are stored."""
    return F.crc32(ids)

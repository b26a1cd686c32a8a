"""Tables as snapshots of immutable files: appended, deleted from and compacted without rewriting what stays.

A table is a folder with data files, files of deleted positions and a log. A log entry names the files that a
snapshot consists of. A change first writes its new files, then puts its entry in place under the next number by a
rename; until then nobody sees it, and two writers cannot both take a number. Deleting rows writes the positions
(file and row) of the rows that go; reading leaves these positions out; compacting rewrites the files that have any.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.filters import deleted_by_keys
from pathloom.session import delete_folder

# a file's path below the table's folder
RELATIVE = r"(data/[^/]+/[^/]+)$"
POSITION = "file string, row long"


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- log ---

    def _at(self, *names: str):
        return self._jvm.Path("/".join([self.path, *names]))

    def _list(self, *names: str) -> list[str]:
        folder = self._at(*names)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n[:-5]) for n in self._list("log") if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()[0])

    def current(self, as_of: str | None = None) -> tuple[int, dict]:
        """Number and entry of the newest version, or of the newest whose stamp is not above ``as_of``."""
        for version in reversed(self.versions()):
            entry = self.entry(version)
            if as_of is None or entry["stamp"] <= as_of:
                return version, entry
        return 0, {"stamp": "", "files": [], "deletes": [], "hit": [], "schema": None}

    def commit(self, after: int, entry: dict) -> int:
        """Put an entry in place as the version after ``after``; fails if that number is taken."""
        version = after + 1
        draft, final = self._at("log", f".{uuid.uuid4().hex}.draft"), self._at("log", f"{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    # --- writing ---

    def _write(self, df: DataFrame) -> list[str]:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return [f"data/{name}/{f}" for f in sorted(self._list("data", name)) if f.endswith(".parquet")]

    def append(self, df: DataFrame, stamp: str) -> int:
        """Rows added to the newest snapshot."""
        version, old = self.current()
        files = self._write(df)
        return self.commit(version, {**old, "stamp": stamp, "files": old["files"] + files, "schema": df.schema.json()})

    def overwrite(self, df: DataFrame, stamp: str) -> int:
        """A snapshot of its own; older ones stay readable until they expire."""
        version, _ = self.current()
        return self.commit(version, {"stamp": stamp, "files": self._write(df), "deletes": [], "hit": [], "schema": df.schema.json()})

    # --- reading ---

    def _scan(self, entry: dict, files: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        files = entry["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema).select("*", F.lit("").alias("__file"), F.lit(0).cast("long").alias("__row"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])
        # file names of Spark's writers hold nothing that a URI would escape
        return rows.select("*", F.regexp_extract("_metadata.file_path", RELATIVE, 1).alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _gone(self, entry: dict) -> DataFrame | None:
        if not entry["deletes"]:
            return None
        gone = self.spark.read.schema(POSITION).parquet(*[f"{self.path}/{d}" for d in entry["deletes"]])
        return gone.select(F.col("file").alias("__file"), F.col("row").alias("__row"))

    def _live(self, entry: dict, files: Sequence[str] | None = None) -> DataFrame:
        """Rows without the deleted positions; only files that have any take part in a join."""
        gone = self._gone(entry)
        if gone is None:
            return self._scan(entry, files)
        hit = set(entry["hit"])
        files = entry["files"] if files is None else files
        left = self._scan(entry, [f for f in files if f in hit]).join(gone, ["__file", "__row"], "left_anti")
        clean = [f for f in files if f not in hit]
        return left.unionByName(self._scan(entry, clean)) if clean else left

    def read(self, as_of: str | None = None) -> DataFrame:
        """The newest snapshot, or the one that was newest at ``as_of``."""
        _, entry = self.current(as_of)
        if entry["schema"] is None:
            raise FileNotFoundError(f"no snapshot in {self.path}")
        return self._live(entry).drop("__file", "__row")

    # --- deleting ---

    def delete(self, hit: DataFrame, stamp: str) -> int:
        """Leave out the rows of ``hit``: rows of ``positions()``. Only their positions are written."""
        version, old = self.current()
        name = f"deletes/{uuid.uuid4().hex}"
        # positions of one file lie together, a file with very many in several tasks
        rows = hit.select(F.col("__file").alias("file"), F.col("__row").alias("row")).hint("rebalance", "file")
        rows.write.parquet(f"{self.path}/{name}")
        # one name for each file with a hit: no more than there are files
        found = self.spark.read.schema(POSITION).parquet(f"{self.path}/{name}").select("file").distinct().collect()
        hit_files = sorted({*old["hit"], *(r[0] for r in found)})
        return self.commit(version, {**old, "stamp": stamp, "deletes": [*old["deletes"], name], "hit": hit_files})

    def positions(self) -> DataFrame:
        """Live rows with their ``__file`` and ``__row``."""
        return self._live(self.current()[1])

    def delete_by_keys(self, deletions: DataFrame, stamp: str, file: str = "FILE", sequence: str = "SEQUENCENAME", fallback: bool = False) -> int:
        """Rows whose file or sequence is in ``deletions``; with ``fallback`` sequences only if no file is found."""
        return self.delete(deleted_by_keys(self.positions(), deletions, file, sequence, fallback), stamp)

    def compact(self, stamp: str) -> int:
        """Files with deleted positions written again without them; all others stay as they are."""
        version, old = self.current()
        if not old["deletes"]:
            return version
        hit = [f for f in old["files"] if f in set(old["hit"])]
        kept = [f for f in old["files"] if f not in set(hit)]
        files = self._write(self._live(old, hit).drop("__file", "__row")) if hit else []
        return self.commit(version, {**old, "stamp": stamp, "files": kept + files, "deletes": [], "hit": []})

    def expire(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete what only they had; the number of files and folders deleted.

        Files of writers that have not committed yet look the same as left-overs: run it when none is at work.
        """
        versions = self.versions()
        stay, go = versions[-keep:], versions[:-keep] if keep else versions
        entries = [self.entry(v) for v in stay]
        wanted = {f for e in entries for f in (*e["files"], *e["deletes"])}
        for version in go:
            self._fs.delete(self._at("log", f"{version:012d}.json"), False)
        found = [f"data/{d}/{f}" for d in self._list("data") for f in self._list("data", d) if f.endswith(".parquet")]
        left = [f for f in found if f not in wanted]
        for f in left:
            self._fs.delete(self._at(f), False)
        loose = [f"deletes/{d}" for d in self._list("deletes") if f"deletes/{d}" not in wanted]
        for d in loose:
            delete_folder(self.spark, f"{self.path}/{d}")
        return len(left) + len(loose)


"""Session settings and lineage handling."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. All are runtime SQL settings, so a cluster
# session can take them over as they are; partition counts come from AQE.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join partitions even where the next step has to shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "8", name: str = "pathloom", **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SQL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the recommended SQL settings on an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster. Only a local session may make one of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="pathloom-checkpoint-")
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so a lost executor costs no replay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# folders that a session's jobs have stored tables in, by application
_stored: dict[str, list[str]] = defaultdict(list)


def stored_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, noted for ``clear_stored``."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _stored[spark.sparkContext.applicationId].append(path)
    return path


def stored_folders(spark: SparkSession) -> list[str]:
    """Folders noted so far for ``clear_stored``."""
    return list(_stored[spark.sparkContext.applicationId])


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_stored(spark: SparkSession) -> int:
    """Delete all that this application's jobs stored so far; the number of folders.

    For the end of a job, once its results are written: DataFrames made before read these tables.
    """
    folders = _stored.pop(spark.sparkContext.applicationId, [])
    for path in folders:
        delete_folder(spark, path)
    return len(folders)


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    For wide tables that several steps read: each of them reads only the columns it needs.
    """
    spark = df.sparkSession
    path = stored_folder(spark, "stored")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

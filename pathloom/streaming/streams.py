"""File streams: append, latest state, changes, running sums, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery



def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder; the schema is given, so no file is read to guess it."""
    return (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def stream_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived, then stop; each run goes on where the last ended."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )


def drop_repeats(df: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First arrival per key within the delay; state older than the watermark is forgotten."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


# state per key in RocksDB: a batch writes a change log of the keys it touches, and two old versions are kept
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def apply_state_settings(spark: SparkSession) -> SparkSession:
    """Settings of keyed state, for sessions that run or read ``stream_latest`` and ``stream_diff``."""
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _falling(column: str, kind: T.DataType) -> Column:
    """A number that falls as the value rises; nulls have none."""
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(column)
    if isinstance(kind, T.NumericType):
        return -F.col(column)
    raise TypeError(f"{column} has to be a time or a number")


def _per_key(df: DataFrame, key: str, time: str, ties: Sequence[str]) -> DataFrame:
    """Per key its latest row so far, when it first came and when it was last touched.

    Rows that arrive in one batch have the time of that batch, which is part of its log, so a batch that is run
    again gives the same. Among equal rows the first to arrive stays.
    """
    rest = [c for c in df.columns if c != key]
    rows = df.withColumn("__came", F.current_timestamp())
    latest_first = F.struct(
        F.col(time).isNull().alias("none"), _falling(time, df.schema[time].dataType).alias("t"),
        *[F.col(c).alias(f"tie{i}") for i, c in enumerate([*ties, *rest])], F.col("__came").alias("came"),
    )
    return rows.groupBy(key).agg(
        F.min_by(F.struct(*rest, "__came"), latest_first).alias("__row"),
        F.min("__came").alias("__first"), F.max("__came").alias("__touched"),
    )


def stream_latest(df: DataFrame, checkpoint: str, key: str, time: str, ties: Sequence[str] = ()) -> StreamingQuery:
    """Latest row per key, by ``time``, then the smallest ``ties``; ``read_latest_state`` reads it.

    The state is Spark's own, spread by key: a batch costs what its keys cost, whatever the state holds.
    """
    apply_state_settings(df.sparkSession)

    def settle(batch: DataFrame, number: int) -> None:
        batch.write.format("noop").mode("overwrite").save()

    return (
        _per_key(df, key, time, ties).writeStream.outputMode("update").foreachBatch(settle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_diff(df: DataFrame, changes: str, checkpoint: str, key: str, time: str, ties: Sequence[str] = ()) -> StreamingQuery:
    """Rows added or updated by each batch against the latest state, written to ``batch=<number>`` of ``changes``.

    The state is kept as in ``stream_latest``. A batch that is run again replaces its own changes.
    """
    apply_state_settings(df.sparkSession)
    columns = df.columns

    def step(batch: DataFrame, number: int) -> None:
        change = F.when(F.col("__first") == F.col("__touched"), "added").when(F.col("__row.__came") == F.col("__touched"), "updated")
        found = batch.withColumn("CHANGE", change).where("CHANGE IS NOT NULL")
        shown = [F.col(c) if c == key else F.col(f"__row.{c}") for c in columns]
        found.select(*shown, "CHANGE").write.mode("overwrite").parquet(f"{changes}/batch={number:012d}")

    return (
        _per_key(df, key, time, ties).writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_latest_state(spark: SparkSession, checkpoint: str, columns: Sequence[str]) -> DataFrame:
    """Latest row per key as the last finished batch of a state stream left it."""
    apply_state_settings(spark)
    state = spark.read.format("statestore").load(checkpoint)
    keys = state.schema["key"].dataType.names
    # the first buffer of the value is the row itself
    row = state.schema["value"].dataType.names[0]
    return state.select(*[F.col(f"key.{c}") if c in keys else F.col("value")[row][c].alias(c) for c in columns])


def windowed_sums(df: DataFrame, time: str, length: str, delay: str, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums per tumbling window and keys; rows later than the delay are left out."""
    return (
        df.withWatermark(time, delay).groupBy(F.window(time, length), *keys)
        .agg(F.count(F.lit(1)).alias("ROWS"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .select(F.col("window.start").alias("WINDOW_START"), F.col("window.end").alias("WINDOW_END"), *keys, "ROWS", *sums)
    )


def stream_sums(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended to a table."""
    return stream_append(df, path, checkpoint)


def stale_events(df: DataFrame, keys: Sequence[str], time: str, minutes: int, delay: str = "0 seconds") -> DataFrame:
    """A row for a key whenever no row of it has come for ``minutes``: its last ``LOADED`` and ``STALE_AT``.

    A key's rows form a session that ends ``minutes`` after the last of them; the session is emitted when the
    watermark has passed its end, which needs no further row of that key.
    """
    rows = df.withWatermark(time, delay).groupBy(F.session_window(time, f"{minutes} minutes"), *keys)
    return rows.agg(F.max(time).alias("LOADED")).select(*keys, "LOADED", F.col("session_window.end").alias("STALE_AT"))


def stream_freshness(df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str, minutes: int = 5, delay: str = "0 seconds") -> StreamingQuery:
    """``stale_events`` appended to a table."""
    return stream_append(stale_events(df, keys, time, minutes, delay), path, checkpoint)


def is_stale(loaded: Column, now: Column, minutes: int = 5) -> Column:
    """Whether a result was loaded more than ``minutes`` ago, or never."""
    age = F.unix_timestamp(now) - F.unix_timestamp(loaded)
    return loaded.isNull() | (age > minutes * 60)


def stale_keys(loads: DataFrame, keys: Sequence[str], now: Column, minutes: int = 5, time: str = "LOADED") -> DataFrame:
    """Keys whose latest load is too old and has to be fetched again."""
    return loads.groupBy(*keys).agg(F.max(time).alias(time)).where(is_stale(F.col(time), now, minutes))

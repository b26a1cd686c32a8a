"""Whole jobs on file inventories: build, compact, delete, refresh, snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import items, names, paths
from pathloom.operators import columns, dedup, filters, frames, joins, tables
from pathloom.operators.grouping import split_rows
from pathloom.schemas import JUNK_TEXTS
from pathloom.session import store
from pathloom.sources import sinks
from pathloom.sources.files import conform_scan, scan_files
from pathloom.sources.snapshots import SnapshotTable


def build_inventory(
    scan: DataFrame, client: str, project: str, shots: DataFrame, entry_time: Column,
    order_by: Sequence[str] = ("FILE",),
) -> DataFrame:
    """Scan rows enriched, grouped into sequences and cleaned.

    Adds project, shot, sequence, extension, hash and item columns. Sequences are shuffled once to be grouped, and of
    the paths only those with a project, to find their shots. The rows are stored once, because the steps after part
    them. Digests, which do not shrink, are made of the rows that are left: until then their texts stand in their place.
    """
    text = scan.schema["FILE"].dataType
    late = isinstance(text, T.StringType) and "HASHEDFILE" not in order_by
    enriched = columns.with_sequence(joins.assign_project(scan, client, project)).withColumns(
        {
            "DOTEXTENSION": names.extension(F.col("FILE")),
            "HASHEDFILE": F.lit("") if late else paths.hash_key(F.col("FILE"), text),
            "ENTRYTIME": entry_time,
        }
    )
    # junk is dropped before grouping: a junk sequence name keeps the junk text of its files
    stored = store(filters.drop_containing_any(enriched, "FILE", JUNK_TEXTS), compression="zstd")
    own, other = split_rows(stored, joins.has_project())
    typed = joins.assign_shot(own, shots).unionByName(other)
    if late:
        typed = typed.withColumn("HASHEDFILE", F.col("FILE"))
    texts = [f.name for f in typed.schema if isinstance(f.dataType, T.StringType) and f.name != "HASHEDFILE"]
    grouped = frames.summarize_sequences(columns.conform_slashes(typed, texts), order_by)
    if late:
        grouped = grouped.withColumn("HASHEDFILE", paths.hash_key(F.col("HASHEDFILE"), text))
    filled = columns.fill_and_stringify(grouped)
    sized = filled.withColumn("FILESIZE", paths.size_text(F.col("FILESIZE")))
    named = sized.withColumns(items.item_columns(F.col("FILE")))
    stripped = named.withColumn("STRIPPEDITEMNAME", items.strip_item_name(F.col("ITEMNAME"), F.col("SHOTNAME")))
    return stripped.withColumn("ITEMVERSION", items.item_version(F.col("STRIPPEDITEMNAME")))


def inventory_of_roots(
    spark: SparkSession, roots: Sequence[str], client: str, project: str, shots: DataFrame, entry_time: Column
) -> DataFrame:
    """The same for folders that are scanned first."""
    return build_inventory(scan_files(spark, roots), client, project, shots, entry_time)


def scan_to_snapshot(spark: SparkSession, roots: Sequence[str], base: str, stamp: str) -> str:
    """Scan, tag with scan id and hash, and write as a new snapshot."""
    rows = conform_scan(scan_files(spark, roots))
    root_list = F.array(*[F.lit(r) for r in roots])
    tagged = rows.withColumns(
        {
            "HASHEDFILE": paths.hash_key(F.col("FILE"), rows.schema["FILE"].dataType),
            "SCANID": paths.scan_id(root_list, F.lit(stamp)),
        }
    )
    return sinks.write_with_history(tagged, base, stamp)


def compact_inventory(snapshots: DataFrame, distinct_files: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Latest rows per hash over all snapshots, or one row per file."""
    if distinct_files:
        return dedup.keep_latest_then_distinct(snapshots, ties=ties)
    return dedup.keep_latest_ties(snapshots)


def write_with_partitions(df: DataFrame, path: str, base: str, columns: Sequence[str]) -> list[str]:
    """Write the main table, then its partitioned copies from the written files.

    The plan of ``df`` runs once; copies read the stored result. Digests, which hold no repeats, only shrink in
    an entropy code, so all are written with zstd.
    """
    sinks.write_table(df, path, compression="zstd")
    stored = df.sparkSession.read.parquet(path)
    return sinks.write_partitioned(stored, path, base, columns, compression="zstd")


def dedup_and_write(spark: SparkSession, source: str, path: str, base: str, columns: Sequence[str]) -> list[str]:
    return write_with_partitions(compact_inventory(spark.read.parquet(source)), path, base, columns)


def delete_and_rewrite(
    spark: SparkSession, source: str, deletions: DataFrame, target: str, base: str,
    columns: Sequence[str], fallback: bool = False,
) -> list[str]:
    """Rows deleted by file and sequence, written to a new place.

    Reading and overwriting one path in the same plan loses data, so the target has to differ.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the target has to differ from the source")
    rows = spark.read.parquet(source)
    delete = filters.delete_by_keys_fallback if fallback else filters.delete_by_keys
    return write_with_partitions(delete(rows, deletions), target, base, columns)


def delete_rows(table: SnapshotTable, deletions: DataFrame, stamp: str, fallback: bool = False, compact: bool = False) -> int:
    """Rows deleted by file and sequence from a table of snapshots; the new version.

    Only positions are written. With ``compact``, the files that have any are then written again, and no others.
    """
    version = table.delete_by_keys(deletions, stamp, fallback=fallback)
    return table.compact(stamp) if compact else version


def refresh_files(
    existing: DataFrame, scan: DataFrame, client: str, project: str, shots: DataFrame,
    template: Sequence[str] = (), order_by: Sequence[str] = ("FILE",),
) -> DataFrame:
    """New scan rows grouped into sequences and added to the existing table, duplicates removed."""
    typed = joins.assign_shot(joins.assign_project(scan, client, project), shots)
    named = columns.with_sequence(typed).withColumn("DOTEXTENSION", names.extension(F.col("FILE")))
    grouped = columns.fill_and_stringify(frames.summarize_sequences(named, order_by))
    return tables.append_then_dedup(existing, grouped, template)


def refresh_links(
    existing: DataFrame, links: DataFrame, client: str, project: str, shots: DataFrame, template: Sequence[str] = ()
) -> DataFrame:
    """New link rows with receiver and sender, added to the existing table."""
    rows = joins.assign_shot(joins.assign_project(links.where("ISLINK <> 'no'"), client, project), shots)
    sided = rows.withColumns(items.who_to(F.col("ISLINK"), F.col("FILE"), F.col("TARGET")))
    return tables.append_then_dedup(existing, columns.fill_and_stringify(sided), template)

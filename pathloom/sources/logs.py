"""Farm and storage reports in text form, as tables of lines turned into rows.

A table of lines has ``FILE_NAME``, ``LINE_NO`` and ``LINE``; see ``tables.read_lines``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.nested import region_of_zone
from pathloom.operators.dedup import carry_header_down

_HEADER = r"^\[(.+)\]$"


def farm_fields(lines: DataFrame) -> DataFrame:
    """``[id]`` headers and ``key=value`` lines as one row per job and key; the last value wins."""
    text = F.trim(F.col("LINE"))
    header = F.when(text.rlike(_HEADER), F.regexp_extract(text, _HEADER, 1))
    owned = carry_header_down(lines.where(text != ""), header, "JobId")
    fields = owned.where(F.col("JobId").isNotNull() & F.contains(text, F.lit("=")) & ~text.rlike(_HEADER))
    at = F.instr(text, F.lit("="))
    key = F.trim(F.substring(text, F.lit(1), at - 1))
    value = F.trim(F.substring(text, at + 1, F.length(text)))
    return (
        fields.select("FILE_NAME", "JobId", "LINE_NO", key.alias("KEY"), value.alias("VALUE"))
        .groupBy("FILE_NAME", "JobId", "KEY").agg(F.max_by("VALUE", "LINE_NO").alias("VALUE"))
    )


def parse_farm_jobs(lines: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per job: chosen keys as columns, or all keys as a map."""
    fields = farm_fields(lines)
    if keys is not None:
        return fields.where(F.col("KEY").isin(list(keys))).groupBy("FILE_NAME", "JobId").agg(
            *[F.max(F.when(F.col("KEY") == k, F.col("VALUE"))).alias(k) for k in keys]
        )
    return fields.groupBy("FILE_NAME", "JobId").agg(
        F.map_from_entries(F.collect_list(F.struct("KEY", "VALUE"))).alias("FIELDS")
    )


def task_fields(block: Column) -> Column:
    """Map of a block of ``key=value`` lines."""
    lines = F.filter(F.split(block, "\r?\n"), lambda s: F.contains(s, F.lit("=")))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.trim(F.split_part(s, F.lit("="), F.lit(1))).alias("key"),
            F.trim(F.substring(s, F.instr(s, F.lit("=")) + 1, F.length(s))).alias("value"),
        ),
    )
    # a key that is given twice keeps its last value
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]
        ),
    )
    return F.map_from_entries(last)


def parse_task_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Blocks of ``key=value`` lines as one map each; blank blocks are dropped."""
    rows = blocks.where(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")) != "")
    return rows.withColumn("TASK", task_fields(F.col(column)))


def read_task_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks split by blank lines, read straight from text files."""
    return parse_task_blocks(spark.read.option("lineSep", "\n\n").text(path)).select("TASK")


def parse_listing_table(lines: DataFrame) -> DataFrame:
    """Rows between the heading line and the first blank line after it, with their first word."""
    text = F.trim(F.col("LINE"))
    heading = (
        F.contains(F.col("LINE"), F.lit("NAME")) & F.contains(F.col("LINE"), F.lit("KIND"))
        & F.contains(F.col("LINE"), F.lit("SNAP"))
    )
    starts = lines.groupBy(F.col("FILE_NAME").alias("__f")).agg(
        F.min(F.when(heading, F.col("LINE_NO"))).alias("__start")
    )
    inside = lines.join(starts, F.col("FILE_NAME") == F.col("__f")).where(F.col("LINE_NO") > F.col("__start"))
    blanks = inside.where(text == "").groupBy(F.col("FILE_NAME").alias("__h")).agg(F.min("LINE_NO").alias("__end"))
    rows = inside.join(blanks, F.col("FILE_NAME") == F.col("__h"), "left")
    kept = rows.where((text != "") & ~heading & (F.col("__end").isNull() | (F.col("LINE_NO") < F.col("__end"))))
    return kept.select(
        "FILE_NAME", "LINE_NO", F.get(F.split(text, r"\s+"), 0).alias("NAME"), text.alias("ROW_TEXT"),
        F.array_join(F.split(text, "T"), "    ").alias("DISPLAY"),
    )


def parse_tsv_report(report: DataFrame, id_column: str = "AWS Instance ID", zone_column: str = "AWS Availability Zone") -> DataFrame:
    """Well-formed instance ids with their region."""
    if id_column not in report.columns or zone_column not in report.columns:
        return report.sparkSession.createDataFrame([], "InstanceId string, Region string")
    ident = F.col(f"`{id_column}`")
    return report.where(F.startswith(ident, F.lit("i-")) & (F.length(ident) > 18)).select(
        ident.alias("InstanceId"), region_of_zone(F.col(f"`{zone_column}`")).alias("Region")
    )


def read_tsv_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv_report(spark.read.csv(path, sep="\t", header=True))

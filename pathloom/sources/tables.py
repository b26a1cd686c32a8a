"""Reading tables: Parquet, CSV, text, snapshots and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.tables import union_tables
from pathloom.schemas import INIT_SCHEMA, SCAN_SCHEMA


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_matching(spark: SparkSession, prefix: str, pattern: str = "*.parquet", schema: T.StructType | None = None) -> DataFrame:
    """All files of a prefix and wildcard, stacked.

    With a schema no footer has to be read first; without one the schemas are merged.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(prefix + pattern)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType = SCAN_SCHEMA) -> DataFrame:
    """The table at a path, or an empty one if there is none."""
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def init_table(spark: SparkSession, path: str, schema: T.StructType = INIT_SCHEMA) -> DataFrame:
    """Write an empty table with the scan headers and return it."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_csv_typed(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header. Every column is text, so ``0007`` keeps its zeros, unless a type is given."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"')
    known = {c: t for c, t in (types or {}).items() if c in df.columns}
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in known.items()}) if known else df


def read_template_csv(
    spark: SparkSession, path: str, header: bool = True, column: int | str = 0, name: str = "PROVISIONEDLINK"
) -> DataFrame:
    """Template table whose chosen column is renamed to the path column; all-null rows are dropped."""
    df = spark.read.csv(path, header=header, quote='"', escape='"')
    index = df.columns.index(column) if isinstance(column, str) else column
    return df.toDF(*[name if i == index else c for i, c in enumerate(df.columns)]).dropna(how="all")


def read_with_provenance(
    spark: SparkSession, paths: Sequence[str], object_type: str = "Directory", first: str = "Item"
) -> DataFrame:
    """Stacked CSVs with the path they came from and a default type."""
    tables = []
    for path in paths:
        df = spark.read.csv(path, header=True, quote='"', escape='"')
        source = F.col("_metadata.file_path")
        df = df.select(*[F.col(f"`{c}`").alias(first if i == 0 else c) for i, c in enumerate(df.columns)], source.alias("Path"))
        if "OBJECTTYPE" not in df.columns:
            df = df.withColumn("OBJECTTYPE", F.lit(object_type))
        tables.append(df)
    return union_tables(tables)


def stamped_name(path: Column) -> tuple[Column, Column]:
    """Name and time stamp of ``name-yyyyMMddHHmmss.csv``."""
    pattern = r"([^/]*)-(\d{14})\.csv$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def flag_latest(df: DataFrame, path: str = "SOURCE_PATH") -> DataFrame:
    """Name, stamp and whether the file is the newest of its name.

    Works on distinct files: their number, not the rows, decides the cost.
    """
    name, stamp = stamped_name(F.col(path))
    files = df.select(F.col(path).alias("__path")).distinct()
    fname, fstamp = stamped_name(F.col("__path"))
    newest = files.groupBy(fname.alias("__name")).agg(F.max(fstamp).alias("__newest"))
    rows = df.withColumns({"NAME": name, "STAMP": stamp})
    joined = rows.join(newest, F.col("NAME") == F.col("__name"))
    return joined.withColumn("is_latest", F.col("STAMP") == F.col("__newest")).drop("__name", "__newest")


def read_latest_per_name(spark: SparkSession, folder: str) -> DataFrame:
    """The newest ``name-yyyyMMddHHmmss.csv`` of each name, stacked, all text."""
    df = spark.read.csv(f"{folder.rstrip('/')}/*.csv", header=True, quote='"', escape='"')
    df = df.withColumn("SOURCE_PATH", F.col("_metadata.file_path"))
    return flag_latest(df).where("is_latest")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row with its whole text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and an order number that rises within each file.

    A long file is read in splits. The number is the byte block of the split joined with the
    place in it, so it needs no count over the file.
    """
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("FILE_NAME"),
        F.col("_metadata.file_block_start").alias("__at"),
        F.col("value").alias("LINE"), F.monotonically_increasing_id().alias("__id"),
    )
    starts = Window.partitionBy("FILE_NAME", "__at")
    return df.withColumn("LINE_NO", F.col("__at") + (F.col("__id") - F.min("__id").over(starts))).drop("__at", "__id")


def load_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table. Spark broadcasts it when its measured size allows."""
    return spark.read.parquet(path)


def union_region_inventories(spark: SparkSession, paths: Mapping[str, str], fmt: str = "json") -> DataFrame:
    """Inventories of several regions stacked; regions without a file are left out."""
    tables = [
        spark.read.format(fmt).load(path).withColumn("Region", F.lit(region))
        for region, path in paths.items() if _exists(spark, path)
    ]
    if not tables:
        raise FileNotFoundError("no inventory found for any region")
    return union_tables(tables)

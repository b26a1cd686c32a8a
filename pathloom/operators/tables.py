"""Whole tables: union, order, edits, schemas as rows, validation, tiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.columns import order_columns, stringify_and_slash
from pathloom.operators.dedup import first_by_key


def sort_rows(df: DataFrame, by: Sequence[str | Column], ascending: bool | Sequence[bool] = True) -> DataFrame:
    return df.orderBy(*by, ascending=ascending)


def reset_order(df: DataFrame, source_order: str) -> DataFrame:
    """Back to the order a kept column records."""
    return df.orderBy(source_order)


def top_one(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The first row by the given order; each task hands on one row."""
    return df.orderBy(*by).limit(1)


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def align_headers(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns of both, blanks where a column was missing."""
    columns = a.columns + [c for c in b.columns if c not in a.columns]

    def fill(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])

    return fill(a), fill(b)


def union_dedup(tables: Sequence[DataFrame], key: str = "FILE", order_by: Sequence[str] = ()) -> DataFrame:
    """Stacked tables, first row per key by table and order, everything as text."""
    ranked = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    rest = [c for c in tables[0].columns if c not in order_by]
    picked = first_by_key(union_tables(ranked), [key], ["__table", *order_by, *rest]).drop("__table")
    return stringify_and_slash(picked, [])


def append_then_dedup(existing: DataFrame, new: DataFrame, template: Sequence[str] = ()) -> DataFrame:
    """Existing and new rows, exact duplicates removed, columns in template order."""
    return order_columns(union_tables([existing, new]).distinct(), template)


def set_minus(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    """Rows of ``a`` that ``b`` does not have."""
    return a.exceptAll(b) if keep_copies else a.subtract(b)


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    gone = keys.select(F.col(key).alias("__k"))
    return df.join(gone, F.col(key) == F.col("__k"), "left_anti")


def add_blank_rows(df: DataFrame, count: int = 1) -> DataFrame:
    blank = df.sparkSession.range(count).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(blank)


def duplicate_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Chosen rows once more."""
    chosen = keys.select(F.col(key).alias("__k")).distinct()
    return df.unionByName(df.join(chosen, F.col(key) == F.col("__k"), "left_semi"))


def classify(dtype: T.DataType) -> str:
    return {T.ArrayType: "list", T.MapType: "map", T.StructType: "struct"}.get(type(dtype), "simple")


def classify_columns(df: DataFrame) -> DataFrame:
    rows = [(f.name, classify(f.dataType)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "COLUMN string, KIND string")


def schema_to_table(df: DataFrame) -> DataFrame:
    """Columns, types and field metadata as rows."""
    rows = [(f.name, f.dataType.simpleString(), str(dict(f.metadata)), "None", "None") for f in df.schema]
    return df.sparkSession.createDataFrame(
        rows, "Field string, `Data Type` string, Metadata string, Compression string, Encryption string"
    )


# Type names of the schema editor, with the Spark types they stand for.
EDITOR_TYPES = {"int64": "bigint", "float": "double", "float64": "double", "string": "string"}

# Rows of a new schema table.
DEFAULT_SCHEMA_ROWS = [
    ("field1", "int64", "NONE", "None"),
    ("field2", "float", "SNAPPY", "None"),
    ("field3", "string", "GZIP", "AES-GCM-V1"),
]


def default_schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_SCHEMA_ROWS, "Field string, `Data Type` string, Compression string, Encryption string")


def table_to_schema(rows: Sequence[tuple[str, str]]) -> T.StructType:
    """Schema from field names and type names; unknown types are refused."""
    fields = []
    for name, kind in rows:
        try:
            dtype = T.StructType.fromDDL(f"c {EDITOR_TYPES.get(kind, kind)}")[0].dataType
        except Exception as error:
            raise ValueError(f"field {name!r} has an unknown type {kind!r}") from error
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


# Metadata keys a package has to carry.
REQUIRED_METADATA = ["compression", "version"]


def validate_table(
    df: DataFrame, schema: T.StructType, metadata: Mapping[str, str] | None = None
) -> DataFrame:
    """Violations of a table against a schema and its metadata; no row means valid."""
    problems = []
    names = [f.name for f in schema]
    if len(set(names)) != len(names):
        problems.append(("schema", "field names are not unique"))
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    for f in schema:
        if f.name not in have:
            problems.append(("data", f"missing column {f.name}"))
        elif have[f.name] != f.dataType.simpleString():
            problems.append(("data", f"column {f.name} is {have[f.name]}, not {f.dataType.simpleString()}"))
    problems += [("data", f"unexpected column {c}") for c in have if c not in names]
    if not problems and df.columns != names:
        problems.append(("data", "column order differs"))
    if metadata is not None:
        problems += [("metadata", f"missing key {k}") for k in REQUIRED_METADATA if k not in metadata]
    return df.sparkSession.createDataFrame(problems, "PART string, PROBLEM string")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def metadata_entry(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("Key") == key)


def typed_empty_columns(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema: the first one filled from the rows, the others typed nulls."""
    value = F.col(rows.columns[0])
    first, rest = schema[0], schema[1:]
    return rows.select(
        value.cast(first.dataType).alias(first.name),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest],
    )


def embed_first_cell(df: DataFrame, text: str, order_by: str) -> DataFrame:
    """Text put into the first column of the first row; it is stored, never run.

    The order column has to be unique. The first row is found with a minimum, not a sort.
    """
    first = df.columns[0]
    lowest = df.agg(F.min(order_by)).scalar()
    return df.withColumn(
        first, F.when(F.col(order_by) == lowest, F.lit(text)).otherwise(F.col(first).cast("string"))
    )


TRAVERSALS = ("column_by_column", "row_by_row", "row_by_row_bounce", "column_by_column_bounce")


def tile_grid(jobs: DataFrame, traversal: str = "column_by_column", origin: str = "top_left") -> DataFrame:
    """Tile number, row and column for each job's ``X_TILES`` by ``Y_TILES`` grid."""
    if traversal not in TRAVERSALS:
        raise ValueError(f"unknown traversal {traversal!r}")
    x, y, nx, ny = F.col("COLUMN"), F.col("__y"), F.col("X_TILES"), F.col("Y_TILES")
    rows = jobs.withColumn("COLUMN", F.explode(F.sequence(F.lit(0), nx.cast("int") - 1)))
    rows = rows.withColumn("__y", F.explode(F.sequence(F.lit(0), ny.cast("int") - 1)))
    number = {
        "column_by_column": y + x * ny,
        "row_by_row": x + y * nx,
        "row_by_row_bounce": F.when(y % 2 == 0, x).otherwise(nx - 1 - x) + y * nx,
        "column_by_column_bounce": F.when(x % 2 == 0, y).otherwise(ny - 1 - y) + x * ny,
    }[traversal]
    row = (ny - 1 - y) if origin == "bottom_left" else y
    return rows.withColumns({"TILE": number.cast("bigint"), "ROW": row.cast("bigint")}).drop("__y")


def tile_bounds(jobs: DataFrame, tiles: Sequence[int] | None = None) -> DataFrame:
    """Pixel bounds of each tile of an ``WIDTH`` by ``HEIGHT`` image.

    The last row and column take the remainder.
    """
    grid = tile_grid(jobs)
    if tiles is not None:
        grid = grid.where(F.col("TILE").isin(list(tiles)))
    out = grid
    for size, count, at, low, high in (
        ("WIDTH", "X_TILES", "COLUMN", "LEFT", "RIGHT"), ("HEIGHT", "Y_TILES", "ROW", "TOP", "BOTTOM"),
    ):
        step = F.expr(f"{size} div {count}")
        extra = F.when(F.col(at) == F.col(count) - 1, F.col(size) % F.col(count)).otherwise(0)
        out = out.withColumns({low: F.col(at) * step, high: step * (F.col(at) + 1) - 1 + extra})
    return out

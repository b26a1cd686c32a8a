"""Column work: fills, casts, order, names, pluggable details."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.names import sequence_struct
from pathloom.functions.nested import json_levels
from pathloom.functions.paths import conform_slashes as slash_text
from pathloom.functions.paths import map_roots as root_text
from pathloom.schemas import STORAGE_ROOTS
from pathloom.session import store


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def with_sequence(df: DataFrame, file: str = "FILE", style: str = "last_sep") -> DataFrame:
    """The columns of ``names.sequence_columns``, worked out once per row.

    They come as an inlined list of one, because Spark puts filters below a plain select and there repeats what they read.
    """
    made = ("SEQUENCENAME", "SEQUENCEPOSITION", "PADDING")
    found = df.select(*[_col(c) for c in df.columns if c not in made], F.inline(F.array(sequence_struct(_col(file), style))))
    return found.select(*[_col(c) for c in df.columns], *[c for c in made if c not in df.columns])


def fill_and_stringify(df: DataFrame, floats: Sequence[str] = ()) -> DataFrame:
    """Everything text with blanks for nulls; listed columns double with 0.0 for nulls."""
    return df.select(
        *[
            F.coalesce(_col(c).cast("double"), F.lit(0.0)).alias(c)
            if c in floats
            else F.coalesce(_col(c).cast("string"), F.lit("")).alias(c)
            for c in df.columns
        ]
    )


def fill_blanks(df: DataFrame, floats: Sequence[str] = ()) -> DataFrame:
    """Blanks for nulls in text columns; listed columns double with 0.0 for nulls."""
    out = []
    for f in df.schema:
        c = _col(f.name)
        if f.name in floats:
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def stringify_and_slash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = df.columns if columns is None else columns
    return df.select(
        *[
            (slash_text(_col(c).cast("string")) if c in wanted else _col(c).cast("string")).alias(c)
            for c in df.columns
        ]
    )


def conform_slashes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Backslashes to slashes in listed columns, else in every text column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wanted = texts if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({c: slash_text(_col(c).cast("string")) for c in wanted}) if wanted else df


def map_roots(df: DataFrame, columns: Sequence[str], root: str, roots: Mapping[str, str] = STORAGE_ROOTS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: root_text(_col(c), df.schema[c].dataType, root, roots) for c in present})


def select_columns(df: DataFrame, columns: Sequence[str], default: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns that exist; the default list if none does."""
    chosen = [c for c in columns if c in df.columns] or [c for c in default or df.columns if c in df.columns]
    return df.select(*[_col(c) for c in chosen])


def order_columns(df: DataFrame, template: Sequence[str]) -> DataFrame:
    """Template columns first, the rest after in their order."""
    first = [c for c in template if c in df.columns]
    return df.select(*[_col(c) for c in first + [c for c in df.columns if c not in first]])


def ensure_columns(
    df: DataFrame, columns: Mapping[str, str], fill: str | None = None, index: int | None = None
) -> DataFrame:
    """Missing columns added as typed nulls or with ``fill``, at the end or at ``index``."""
    missing = [c for c in columns if c not in df.columns]
    added = df.withColumns({c: F.lit(fill).cast(columns[c]) for c in missing}) if missing else df
    if index is None:
        return added
    names = df.columns[:index] + missing + df.columns[index:]
    return added.select(*[_col(c) for c in names])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def cast_or_clear(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Column cast to a type; values that do not fit become null."""
    return df.withColumn(column, _col(column).try_cast(dtype))


def combine_details(df: DataFrame, details: Sequence[str], registry: Mapping[str, Callable[[DataFrame], Mapping[str, Column]]]) -> DataFrame:
    """Several named groups of derived columns added at once, blanks for null text."""
    new: dict[str, Column] = {}
    for name in details:
        if name in registry:
            new.update(registry[name](df))
    return fill_blanks(df.withColumns(new)) if new else fill_blanks(df)


def merge_processed(original: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Processed values where present, else the original ones; rows of ``original`` are never multiplied.

    Of several processed rows with one key the greatest is taken, whole: compared by its shared plain
    columns in their order, nulls lowest. They are combined before the shuffle.
    """
    shared = [c for c in original.columns if c in processed.columns and c != key]
    if not shared:
        return original
    plain = [c for c in shared if isinstance(processed.schema[c].dataType, T.AtomicType)]
    row, order = F.struct(*[_col(c).alias(f"__new_{c}") for c in shared]), F.struct(F.lit(0), *[_col(c) for c in plain])
    keyed = processed.where(_col(key).isNotNull()).groupBy(_col(key).alias("__k"))
    new = keyed.agg(F.max_by(row, order).alias("__new")).select("__k", "__new.*")
    joined = original.join(new, _col(key) == F.col("__k"), "left")
    return joined.select(
        *[F.coalesce(F.col(f"`__new_{c}`"), _col(c)).alias(c) if c in shared else _col(c) for c in original.columns]
    )


def row_text(df: DataFrame, columns: Sequence[str] | None = None, name: str = "ROW_TEXT") -> DataFrame:
    """Columns of a row joined by spaces."""
    cols = [_col(c).cast("string") for c in columns or df.columns]
    return df.withColumn(name, F.concat_ws(" ", *cols))


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Struct columns become ``parent.child`` columns; lists stay."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.StructType):
            out += [_col(f.name)[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType]
        else:
            out.append(_col(f.name))
    return df.select(*out)


def constant_tag(df: DataFrame, name: str = "THISDFSTATUS", value: str = "fresh") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def records_json(df: DataFrame, name: str = "RECORD") -> DataFrame:
    """One JSON object per row; dots in column names become underscores."""
    plain = df.toDF(*[c.replace(".", "_") for c in df.columns])
    return plain.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def nested_paths(df: DataFrame, json: Column, keep: Sequence[str] = (), step: int = 3) -> DataFrame:
    """Every node of a JSON cell at any depth, a row each: ``keep``, ``path``, ``data_type`` and ``value``.

    ``step`` levels are built inside the rows at a time. Nodes at the last of them that have children are the cells
    of the next round, so there are as many rounds as the deepest cell needs and only what is deep takes part.
    """
    kept = [f"__k{i}" for i in range(len(keep))]
    cells = df.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], json.alias("__cell"), F.lit("(root)").alias("__root"))
    rounds: list[DataFrame] = []
    while True:
        nodes = store(cells.select(*kept, F.inline(json_levels(F.col("__cell"), F.col("__root"), step))))
        # the root of a later round is a node of the round before
        rounds.append(nodes if not rounds else nodes.where("level > 0"))
        deeper = nodes.where((F.col("level") == step) & F.col("data_type").isin("dict", "list") & ~F.col("value").isin("{}", "[]"))
        if deeper.isEmpty():
            break
        cells = deeper.select(*kept, F.col("value").alias("__cell"), F.col("path").alias("__root"))
    whole = reduce(DataFrame.unionByName, rounds)
    return whole.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "path", "data_type", "value")

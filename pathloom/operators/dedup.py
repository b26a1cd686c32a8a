"""Keeping the latest, the first or the undisputed rows.

One-row-per-key picks are ``row_number() = 1``: Spark limits each group before the shuffle,
so a hot key moves one row per task. Where ties must stay, rows are shuffled once, to meet the maximum
of their key. If a key is hot, the maximum is aggregated and joined back on key and value instead, so
that the key spreads over its values; keys are counted first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.paths import conform_slashes, is_digest, pack_digest, unpack_digest
from pathloom.operators.grouping import number_rows, spread
from pathloom.schemas import REVIEW_STATES


def _first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    # led by a hash, so that the sort compares numbers and not long keys that begin alike
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    window = Window.partitionBy(F.xxhash64(*columns), *columns).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


# a key is hot if it may have more rows than this, and more than so many tasks have on average
HOT_ROWS, HOT_TASKS = 1_000_000, 4


def keep_latest_ties(df: DataFrame, key: str = "HASHEDFILE", time: str = "ENTRYTIME") -> DataFrame:
    """Rows whose time equals the latest of their key; several may stay.

    Text keys are shuffled packed, which halves digests. Keys are counted when this is called.
    """
    packs = isinstance(df.schema[key].dataType, T.StringType)
    kept = _latest(_with_packed(df, key) if packs else df, key, time, _key_facts(df, key)[0])
    return _with_unpacked(kept, key) if packs else kept


def _latest(df: DataFrame, key: str, time: str, hot: bool) -> DataFrame:
    if not hot:
        newest = F.max(time).over(Window.partitionBy(F.col(f"`{key}`")))
        rows = df.where(F.col(time).isNotNull()).withColumn("__t", newest)
        return rows.where(F.col(time) == F.col("__t")).drop("__t")
    latest = df.groupBy(F.col(key).alias("__k")).agg(F.max(time).alias("__t"))
    return df.join(
        latest.where("__t is not null"),
        F.col(key).eqNullSafe(F.col("__k")) & (F.col(time) == F.col("__t")),
        "left_semi",
    )


def _key_facts(df: DataFrame, key: str) -> tuple[bool, bool]:
    """Whether a key is hot, and whether all keys are digests or null.

    Rows are counted by buckets of the key's hash, so only counts are shuffled, and however many keys there are, few.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(f"`{key}`").alias("__k"))
    digest = is_digest(F.col("__k")) if isinstance(df.schema[key].dataType, T.StringType) else F.lit(False)
    counts = keys.groupBy(F.pmod(F.xxhash64("__k"), F.lit(64 * tasks)).alias("__b")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.coalesce(digest, F.lit(True))).alias("__d")
    )
    rows, most, digests = counts.agg(F.sum("__n"), F.max("__n"), F.min("__d")).first()
    return (most or 0) > max(HOT_ROWS, HOT_TASKS * (rows or 0) / tasks), bool(digests)


def _with_packed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, pack_digest(F.col(f"`{key}`")))


def _with_unpacked(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, unpack_digest(F.col(f"`{key}`")))


def keep_latest_then_distinct(
    df: DataFrame, key: str = "HASHEDFILE", time: str = "ENTRYTIME", file: str = "FILE",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Latest rows per key, then one row per file by the given tie columns.

    Digests stay packed through both shuffles. Other keys are put in order as the texts they are.
    """
    packs = isinstance(df.schema[key].dataType, T.StringType)
    hot, digests = _key_facts(df, key)
    latest = _latest(_with_packed(df, key) if packs else df, key, time, hot)
    if packs and not digests:
        latest = _with_unpacked(latest, key)
    first = _first(latest, [file], [F.col(time).desc(), F.col(key), *[F.col(c) for c in ties]])
    return _with_unpacked(first, key) if packs and digests else first


def keep_latest_two_stage(
    df: DataFrame, key: str = "HASHEDFILE", time: str = "ENTRYTIME", file: str = "FILE",
    second_order: str = "key", ties: Sequence[str] = (),
) -> DataFrame:
    """Last row per key by time, then first row per file by key or by earliest time."""
    tie = [F.col(c) for c in ties]
    latest = _first(df, [key], [F.col(time).desc(), *tie])
    order = [F.col(key)] if second_order == "key" else [F.col(time).asc(), F.col(key)]
    return _first(latest, [file], [*order, *tie])


def first_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order."""
    return _first(df, keys, [F.col(c) if isinstance(c, str) else c for c in order_by])


def distinct_rows(df: DataFrame, slash_columns: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicates removed after the slashes are conformed."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    wanted = texts if slash_columns is None else [c for c in slash_columns if c in texts]
    return df.withColumns({c: conform_slashes(F.col(c)) for c in wanted}).distinct() if wanted else df.distinct()


def drop_double_dupes(df: DataFrame, key: str, choice: str, order_by: Sequence[str]) -> DataFrame:
    """First row per key and choice."""
    return first_by_key(df, [key, choice], order_by)


def _with_group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of the group joined to each row; sizes are added up before the shuffle."""
    sizes = df.groupBy(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias(name)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    return df.join(sizes, same).drop(*[f"__s{i}" for i in range(len(keys))])


def only_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    several = (
        df.groupBy(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)])
        .agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    return df.join(several, same, "left_semi")


def review_status(df: DataFrame, key: str, status: str = "STATUS") -> DataFrame:
    """Open rows are invalid in groups of several rows and valid in groups of one."""
    known = F.when(F.col(status).isin(REVIEW_STATES), F.col(status)).otherwise(F.lit("pending"))
    decided = F.when(F.col("__size") > 1, F.lit("invalid")).otherwise(F.lit("valid"))
    sized = _with_group_size(df, [key], "__size").withColumn(status, known)
    return sized.withColumn(
        status, F.when(F.col(status) == "pending", decided).otherwise(F.col(status))
    ).select(*df.columns)


def choose_valid(df: DataFrame, decisions: DataFrame, key: str, choice: str, status: str = "STATUS") -> DataFrame:
    """Decided keys: the chosen value is valid, every other row invalid. Others stay.

    ``decisions`` has one row per key with the chosen value; of several, the greatest value counts,
    so rows of ``df`` are never multiplied.
    """
    chosen = decisions.groupBy(F.col(key).alias("__k")).agg(F.max(choice).alias("__c"))
    joined = df.join(chosen, F.col(key) == F.col("__k"), "left")
    value = (
        F.when(F.col("__k").isNull(), F.col(status))
        .when(F.col(choice).eqNullSafe(F.col("__c")), F.lit("valid"))
        .otherwise(F.lit("invalid"))
    )
    return joined.withColumn(status, value).select(*df.columns)


def version_in_name(path: Column) -> Column:
    """Number after the last ``_v`` of the file name, 0 without one."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    digits = F.regexp_replace(F.element_at(F.split(stem, "_v"), -1), r"\D", "")
    return F.when(F.contains(stem, F.lit("_v")), F.coalesce(digits.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0).cast("bigint"))


def version_duplicates(df: DataFrame, prefix: str = "v", padding: int = 3) -> DataFrame:
    """Rows that share ``DEST``, in the order of the version in ``SRC``, get rising versions.

    ``VERSIONED_DEST`` is ``DEST`` with its ``VERSION`` filled for every row after the first;
    ``DUPLICATE_NO`` is the place in the group. Rows alone on their ``DEST`` stay.
    """
    ranked = number_rows(
        df.withColumn("__v", version_in_name(F.col("SRC"))),
        ["DEST"], [F.col("__v"), spread(F.col("SRC"))], [F.col("SRC")], "DUPLICATE_NO",
    )
    digits = F.col("DUPLICATE_NO").cast("string")
    text = F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(padding)), "0"))
    filled = F.when(F.col("DUPLICATE_NO") > 1, F.replace(F.col("DEST"), F.lit("VERSION"), text))
    return ranked.withColumn("VERSIONED_DEST", F.coalesce(filled, F.col("DEST"))).select(
        *df.columns, F.col("__v").alias("SRC_VERSION"), "DUPLICATE_NO", "VERSIONED_DEST"
    )


def carry_header_down(
    lines: DataFrame, header: Column, name: str, file: str = "FILE_NAME", line: str = "LINE_NO",
    block: int = 65536,
) -> DataFrame:
    """The last header value at or above each line, within one file.

    Lines are handled per block of line numbers, and a block passes its last header on, so
    one huge file still spreads over many tasks.
    """
    rows = lines.withColumns({"__h": header, "__block": F.floor(F.col(line) / block)})
    inside = Window.partitionBy(file, "__block").orderBy(line)
    marked = rows.withColumn(
        "__inside", F.last("__h", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    last_of_block = rows.groupBy(F.col(file).alias("__file"), F.col("__block").alias("__b")).agg(
        F.max_by("__h", F.when(F.col("__h").isNotNull(), F.col(line))).alias("__last")
    )
    before = Window.partitionBy("__file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_block.withColumn("__carry", F.last("__last", ignorenulls=True).over(before))
    joined = marked.join(
        carried, F.col(file).eqNullSafe(F.col("__file")) & F.col("__block").eqNullSafe(F.col("__b")), "left"
    )
    return joined.withColumn(name, F.coalesce("__inside", "__carry")).select(*lines.columns, name)

"""Numbering and listing inside groups of any size.

A window over a plain group key sends the whole group to one task. Here rows are sorted by range
(``operators.ranking``), so a group lies over as many tasks as it has ranges, and only the
counts of ranges meet per group, never the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.ranking import number_in_order

# rows per list cell; a group below this size gives exactly one list
CHUNK_ROWS = 10_000


def spread(*cols: Column) -> Column:
    """A 4096-way bucket of the given text columns, the same in every engine (md5)."""
    return F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 3)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[Column],
    fine: Sequence[Column],
    name: str = "ROW_NO",
) -> DataFrame:
    """1-based position of each row in its ``keys`` group, ordered by ``coarse`` then ``fine``."""
    return number_in_order(df, keys, [*coarse, *fine], name)


def chunked_lists(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str,
    coarse: Sequence[Column],
    fine: Sequence[Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Values of each group as ordered lists of at most ``chunk_rows`` entries.

    ``CHUNK`` counts the lists of a group from 0. Nothing is left out: a larger group has
    more lists.
    """
    numbered = number_rows(
        df.select(*keys, value.alias("__v"), *[c.alias(f"__c{i}") for i, c in enumerate(coarse)],
                  *[c.alias(f"__f{i}") for i, c in enumerate(fine)]),
        keys,
        [F.col(f"__c{i}") for i in range(len(coarse))],
        [F.col(f"__f{i}") for i in range(len(fine))],
        "__no",
    ).withColumn("CHUNK", F.expr(f"int((__no - 1) div {int(chunk_rows)})"))
    listed = numbered.groupBy(*keys, "CHUNK").agg(
        F.array_sort(F.collect_list(F.struct("__no", "__v"))).alias("__l")
    )
    return listed.select(*keys, "CHUNK", F.transform("__l", lambda x: x["__v"]).alias(name))


def salted_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equality join for keys with few values, such as file extensions.

    Rows of the left side get a salt from their values and their partition, and rows of the
    right side appear once per salt, so a key that holds most rows spreads over ``salts`` tasks,
    also if those rows are copies of each other: as many as there are shuffle partitions, unless
    given. When Spark finds the right side small enough
    to broadcast, the salt costs nothing.
    """
    if salts is None:
        salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in left.schema if isinstance(f.dataType, T.AtomicType)]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) + F.spark_partition_id()
    salted = left.withColumn("__salt", F.pmod(row, F.lit(salts)))
    copies = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__copy"))
    return salted.join(copies, same, how).drop("__salt", "__copy")


def spread_blank(key: Column) -> Column:
    """A join key whose blanks and nulls match nothing and do not meet in one task.

    Both sides of the join have to use it; blanks get the number of their partition.
    """
    blank = F.coalesce(key.cast("string"), F.lit("")) == ""
    return F.when(blank, F.concat(F.lit("!"), F.spark_partition_id().cast("string"))).otherwise(
        F.concat(F.lit("="), key.cast("string"))
    )


def split_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the others. Over a stored table both reach its scan."""
    meets = F.coalesce(condition, F.lit(False))
    return df.where(meets), df.where(~meets)

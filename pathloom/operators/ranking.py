"""Positions of rows in an order, for groups of any size, by one range exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import store


def number_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ROW_NO", total: str | None = None
) -> DataFrame:
    """``df`` with the 1-based position of each row in its group of ``keys``, and with the group's rows as ``total``.

    Rows are sorted by range: split points come from a sample, so a group that holds most rows lies over as many
    tasks as it has ranges, also where its rows are equal. A range knows the place of its rows; only the counts
    of the ranges of a group meet, never its rows. The order is ascending,
    nulls first; rows equal in it keep any order among each other. The input is computed once and stored.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [f"__o{i}" for i in range(len(order))]
    plain = [F.col(k).asc_nulls_first() for k in keys]
    directed = [F.col(b).asc_nulls_first() for b in by]
    rows = store(df.withColumns(dict(zip(by, order))).withColumn("__tie", F.monotonically_increasing_id()))
    spread = rows.repartitionByRange(n, *plain, *directed, "__tie").sortWithinPartitions(*plain, *directed, "__tie")
    placed = store(spread.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).drop(*by, "__tie"))

    own = [f"__k{i}" for i in range(len(keys))]
    spans = placed.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("__part").alias("__of")).agg(
        F.min("__at").alias("__from"), F.count(F.lit(1)).alias("__n")
    )
    group = Window.partitionBy(*own)
    before = group.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__all": F.sum("__n").over(group)})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)), F.col("__part") == F.col("__of"))
    out = placed.join(spans, same)
    position = (F.col("__at") - F.col("__from") + F.col("__before") + 1).alias(name)
    return out.select(*df.columns, position, *([F.col("__all").alias(total)] if total else []))

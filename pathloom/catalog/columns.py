"""Queries: fills, casts, column order and names."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import instances, inv, table, with_views
from pathloom.functions import nested
from pathloom.operators import columns

HOLES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, concat('a\\b', o_orderpriority) AS place FROM orders"""
HOLES = HOLES.replace("\\\\", "\\")


def holes(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 3 != 0, F.col("o_orderstatus")).alias("state"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.concat(F.lit("a\\b"), "o_orderpriority").alias("place"),
    )


@query(
    "fill_and_stringify",
    f"WITH h AS ({HOLES}) SELECT cast(o_orderkey AS string) AS o_orderkey, coalesce(state, '') AS state, coalesce(price, 0.0::double) AS price, place FROM h",
)
def fill_and_stringify(spark, sf):
    return columns.fill_and_stringify(holes(spark, sf), ["price"])


@query(
    "fill_blanks",
    f"WITH h AS ({HOLES}) SELECT o_orderkey, coalesce(state, '') AS state, coalesce(price, 0.0::double) AS price, place FROM h",
)
def fill_blanks(spark, sf):
    return columns.fill_blanks(holes(spark, sf), ["price"])


@query(
    "stringify_and_slash",
    f"WITH h AS ({HOLES}) " + r"SELECT cast(o_orderkey AS string) AS o_orderkey, state, cast(price AS string) AS price, replace(place, '\', '/') AS place FROM h",
)
def stringify_and_slash(spark, sf):
    return columns.stringify_and_slash(holes(spark, sf))


@query(
    "conform_slashes",
    f"WITH h AS ({HOLES}) " + r"SELECT o_orderkey, state, price, replace(place, '\', '/') AS place FROM h",
)
def conform_slashes(spark, sf):
    return columns.conform_slashes(holes(spark, sf))


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, sf):
    return columns.select_columns(table(spark, sf, "orders"), ["o_orderkey", "not_there", "o_totalprice"])


@query("order_columns", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def order_columns(spark, sf):
    return columns.order_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@query(
    "ensure_columns",
    "SELECT s_suppkey, NULL::varchar AS DEST, NULL::bigint AS FRAMES, s_name, s_nationkey, s_acctbal FROM supplier",
)
def ensure_columns(spark, sf):
    return columns.ensure_columns(table(spark, sf, "supplier"), {"DEST": "string", "s_name": "string", "FRAMES": "bigint"}, index=1)


@query("drop_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return columns.drop_columns(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_acctbal"])


@query("rename_columns", "SELECT c_custkey AS id, c_mktsegment AS CLIENT FROM customer")
def rename_columns(spark, sf):
    return columns.rename_columns(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), {"c_custkey": "id", "c_mktsegment": "CLIENT"})


@query(
    "cast_or_clear",
    "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 2 = 0 THEN cast(o_custkey AS string) ELSE o_orderpriority END AS bigint) AS mixed FROM orders",
)
def cast_or_clear(spark, sf):
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    return columns.cast_or_clear(table(spark, sf, "orders").select("o_orderkey", mixed.alias("mixed")), "mixed", "bigint")


@query(
    "combine_details",
    with_views("instances") + "SELECT InstanceId, Name, Region, split_part(InstanceType, '.', 1) AS InstanceFamily, split_part(InstanceType, '.', 2) AS InstanceXlarge FROM instances",
)
def combine_details(spark, sf):
    registry = {
        "name": lambda df: {"Name": nested.tag_value(F.col("Tags"), "Name")},
        "region": lambda df: {"Region": nested.region_of_zone(F.col("Placement.AvailabilityZone"))},
        "family": lambda df: nested.family_and_size(F.col("InstanceType")),
    }
    out = columns.combine_details(instances(spark, sf), ["name", "region", "family", "unknown"], registry)
    return out.select("InstanceId", "Name", "Region", "InstanceFamily", "InstanceXlarge")


@query(
    "merge_processed",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN concat('done-', o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice FROM orders""",
)
def merge_processed(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    done = rows.where("o_orderkey % 4 = 0").select(
        "o_orderkey", F.concat(F.lit("done-"), "o_orderstatus").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice")
    )
    return columns.merge_processed(rows, done, "o_orderkey")


@query("row_text", "SELECT o_orderkey, concat_ws(' ', cast(o_custkey AS string), o_orderstatus, o_orderpriority) AS ROW_TEXT FROM orders")
def row_text(spark, sf):
    rows = columns.row_text(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return rows.select("o_orderkey", "ROW_TEXT")


@query(
    "flatten_one_level",
    with_views("instances") + 'SELECT InstanceId, InstanceType, State_Name AS "State.Name", Zone AS "Placement.AvailabilityZone", \'default\' AS "Placement.Tenancy" FROM instances',
)
def flatten_one_level(spark, sf):
    return columns.flatten_one_level(instances(spark, sf)).drop("Tags")


@query("constant_tag", "SELECT s_suppkey, 'fresh' AS THISDFSTATUS FROM supplier")
def constant_tag(spark, sf):
    return columns.constant_tag(table(spark, sf, "supplier").select("s_suppkey"))


@query(
    "map_roots",
    with_views("inv") + r"""
SELECT FILE, concat('F:', FILE) AS moved, concat('http://x', FILE) AS url,
  concat('F:', FILE, '|F:/a/b') AS listed FROM inv""",
)
def map_roots(spark, sf):
    rows = inv(spark, sf).select(
        "FILE", F.concat(F.lit("\\mnt\\localF/"), "FILE").alias("moved"), F.concat(F.lit("http://x"), "FILE").alias("url"),
        F.array(F.concat(F.lit("/Volumes/localF"), "FILE"), F.lit("F:/a//b")).alias("listed"),
    )
    out = columns.map_roots(rows, ["moved", "url", "listed"], "F:/")
    return out.withColumn("listed", F.array_join("listed", "|"))

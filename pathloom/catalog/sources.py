"""Queries: reading tables, scans and reports."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import dirs, inv, table, with_views
from pathloom.operators import aggregates, columns, trees
from pathloom.session import stored_folder
from pathloom.sources import files, logs, sinks, tables
from pathloom.sources.snapshots import SnapshotTable


@query("read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def read_table(spark, sf):
    return tables.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("read_matching", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def read_matching(spark, sf):
    return tables.read_matching(spark, f"{sf}/line", "*.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("write_with_history", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2")
def write_with_history(spark, sf):
    """Two arrivals and a new state; the table as it was after the second arrival."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    held = SnapshotTable(spark, stored_folder(spark, "history"))
    held.append(rows.where("o_orderkey % 3 = 0"), "20240101000000")
    held.append(rows.where("o_orderkey % 3 = 1"), "20240102000000")
    held.overwrite(rows.where("o_orderkey % 3 = 2"), "20240103000000")
    return held.read("20240102120000")


@query("append_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def append_table(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    folder = stored_folder(spark, "appended")
    for left in range(2):
        sinks.append_table(rows.where(F.col("o_orderkey") % 2 == left), folder)
    return spark.read.schema(rows.schema).parquet(folder)


RAW_SCAN = r"""
SELECT concat('\jobs\\', c_mktsegment, '//', cast(o_orderkey AS string)) AS FILE,
  CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE cast(o_orderkey * 7 AS string) END AS FILESIZE,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE concat(substr(cast(o_orderdate AS string), 1, 10), ' 10:20:30') END AS CREATION_TIME,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'file' END AS ISLINK,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '..\a\b' END AS TARGET
FROM orders JOIN customer ON o_custkey = c_custkey"""


def raw_scan(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 10:20:30"))
    return rows.select(
        F.concat(F.lit("\\jobs\\\\"), "c_mktsegment", F.lit("//"), key.cast("string")).alias("FILE"),
        F.when(key % 11 == 0, "N/A").otherwise((key * 7).cast("string")).alias("FILESIZE"),
        F.when(key % 7 == 0, "N/A").otherwise(time).alias("CREATION_TIME"),
        F.when(key % 7 == 0, None).otherwise(time).alias("MODIFICATION_TIME"),
        F.when(key % 5 != 0, "file").alias("ISLINK"),
        F.when(key % 3 != 0, "..\\a\\b").alias("TARGET"),
    )


@query(
    "conform_scan",
    f"WITH raw AS ({RAW_SCAN})" + r"""
SELECT replace(replace(FILE, '\', '/'), '//', '/') AS FILE,
  coalesce(try_cast(FILESIZE AS bigint), 0) AS FILESIZE,
  CASE WHEN CREATION_TIME = 'N/A' THEN '1999-12-31 23:59:59' ELSE CREATION_TIME END AS CREATION_TIME,
  CASE WHEN CREATION_TIME = 'N/A' THEN '1999-12-31 23:59:59' ELSE CREATION_TIME END AS MODIFICATION_TIME,
  coalesce(ISLINK, 'no') AS ISLINK, replace(coalesce(TARGET, ''), '\', '/') AS TARGET FROM raw""",
)
def conform_scan(spark, sf):
    typed = files.conform_scan(raw_scan(spark, sf))
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("CREATION_TIME", "MODIFICATION_TIME")}
    return typed.withColumns(shown)


@query(
    "files_by_directory",
    with_views("dirs") + r"""
SELECT CASE WHEN d = '' THEN 'Root' ELSE d END AS DIRECTORY, 0 AS CHUNK,
  string_agg(n, '|' ORDER BY n) AS FILES, count(*) AS FILE_COUNT
FROM (SELECT regexp_replace(substr(FILE, 6), '/?[^/]*$', '') AS d, regexp_extract(FILE, '[^/]*$') AS n FROM dirs)
WHERE NOT contains(n, 'ref=x') GROUP BY 1""",
)
def files_by_directory(spark, sf):
    lists = aggregates.files_by_directory(dirs(spark, sf), ["ref=x"], root="/web")
    return lists.select(
        "DIRECTORY", "CHUNK", F.array_join("FILES", "|").alias("FILES"), F.size("FILES").cast("bigint").alias("FILE_COUNT")
    )


@query(
    "directory_chunks",
    with_views("dirs") + r"""
, names AS (SELECT 'pages' AS DIRECTORY, FILE AS n FROM dirs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY DIRECTORY ORDER BY substr(md5(replace(n, '/', chr(2))), 1, 3), n) AS r FROM names)
SELECT DIRECTORY, cast((r - 1) // 100 AS int) AS CHUNK, string_agg(n, '|' ORDER BY n) AS FILES
FROM numbered GROUP BY 1, 2""",
)
def directory_chunks(spark, sf):
    """One directory that holds everything, listed in chunks of 100."""
    flat = dirs(spark, sf).withColumn("FILE", F.concat(F.lit("pages/"), F.replace("FILE", F.lit("/"), F.lit("\x02"))))
    lists = aggregates.files_by_directory(flat, (), 100)
    # slashes were hidden so that the whole URL counts as one name
    return lists.select("DIRECTORY", "CHUNK", F.array_join("FILES", "|").alias("FILES")).withColumn(
        "FILES", F.replace("FILES", F.lit("\x02"), F.lit("/"))
    )


@query(
    "list_directories",
    with_views("dirs") + r"""
, parts AS (SELECT DISTINCT string_split(regexp_replace(FILE, '/[^/]*$', ''), '/') AS p FROM dirs),
ups AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS DIRECTORY FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM parts))
SELECT DIRECTORY FROM ups WHERE DIRECTORY <> ''""",
)
def list_directories(spark, sf):
    return trees.list_directories(dirs(spark, sf))


@query(
    "list_directories_below",
    with_views("inv") + r"""
SELECT DISTINCT DIRECTORY FROM (
  SELECT unnest([CLIENT, concat(CLIENT, '/', PROJECT)]) AS DIRECTORY FROM inv)""",
)
def list_directories_below(spark, sf):
    return trees.list_directories(inv(spark, sf), root="/jobs", depth=2)


@query(
    "file_status",
    with_views("inv") + """
SELECT DISTINCT FILE, CASE WHEN FILE IN (SELECT FILE FROM inv WHERE ISLINK = 'no') THEN 'online' ELSE 'offline' END AS STATUS FROM inv""",
)
def file_status(spark, sf):
    rows = inv(spark, sf)
    return files.file_status(rows.select("FILE").distinct(), rows.where("ISLINK = 'no'"))


@query(
    "to_records_json",
    """SELECT to_json({'o_orderkey': o_orderkey, 'o_status': o_orderstatus, 'customer_key': o_custkey,
       'note': CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END})::varchar AS RECORD FROM orders""",
)
def to_records_json(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("o.status"), F.col("o_custkey").alias("customer.key"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"),
    )
    return columns.records_json(rows)


def farm_lines(spark, sf):
    """Farm report text with one job per event; all in one file."""
    parts = F.array(
        F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")),
        F.concat(F.lit("JobStatus="), F.col("event_type")),
        F.concat(F.lit(" Value = "), F.col("value").cast("string")),
        F.concat(F.lit("Props="), F.col("props"), F.lit("=x")), F.lit(""),
    )
    rows = table(spark, sf, "events").select("event_id", F.posexplode(parts).alias("__i", "LINE"))
    return rows.select(
        F.lit("farm.txt").alias("FILE_NAME"), (F.col("event_id") * 5 + F.col("__i")).alias("LINE_NO"), "LINE"
    )


@query(
    "parse_farm_jobs",
    """SELECT cast(event_id AS string) AS JobId, event_type AS JobStatus, cast(value AS string) AS "Value",
       concat(props, '=x') AS Props FROM events""",
)
def parse_farm_jobs(spark, sf):
    return logs.parse_farm_jobs(farm_lines(spark, sf), ["JobStatus", "Value", "Props"]).drop("FILE_NAME")


@query(
    "parse_task_blocks",
    "SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS TaskId, cast(l_linenumber AS string) AS TaskFrameList FROM lineitem",
)
def parse_task_blocks(spark, sf):
    block = F.concat(
        F.lit("\nTaskId="), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit("\n TaskFrameList = "), F.col("l_linenumber").cast("string"), F.lit("\n"),
    )
    tasks = logs.parse_task_blocks(table(spark, sf, "lineitem").select(block.alias("value")))
    return tasks.select(F.col("TASK")["TaskId"].alias("TaskId"), F.col("TASK")["TaskFrameList"].alias("TaskFrameList"))


@query(
    "parse_listing_table",
    """WITH ends AS (SELECT o_custkey % 100 AS f, min(o_orderkey) AS e FROM orders WHERE o_orderkey % 60 = 59 GROUP BY 1)
SELECT concat('list', cast(o_custkey % 100 AS string)) AS FILE_NAME, concat('snap', cast(o_orderkey AS string)) AS NAME
FROM orders LEFT JOIN ends ON o_custkey % 100 = f WHERE e IS NULL OR o_orderkey < e""",
)
def parse_listing_table(spark, sf):
    orders = table(spark, sf, "orders")
    name = F.concat(F.lit("list"), (F.col("o_custkey") % 100).cast("string")).alias("FILE_NAME")
    row = F.concat(F.lit(" snap"), F.col("o_orderkey").cast("string"), F.lit("  bucket 2024-01-01T00:00 "))
    rows = orders.select(
        name, (F.col("o_orderkey") + 10).alias("LINE_NO"),
        F.when(F.col("o_orderkey") % 60 == 59, "").otherwise(row).alias("LINE"),
    )
    heads = orders.select(name).distinct().withColumn(
        "LINE", F.explode(F.array(F.lit("banner text"), F.lit(""), F.lit("NAME KIND SNAP")))
    )
    heads = heads.withColumn("LINE_NO", F.when(F.col("LINE") == "", 1).when(F.col("LINE").startswith("N"), 2).otherwise(0).cast("bigint"))
    return logs.parse_listing_table(rows.unionByName(heads)).select("FILE_NAME", "NAME")


@query(
    "parse_tsv_report",
    """SELECT concat('i-', lpad(cast(c_custkey AS string), 17, '0')) AS InstanceId,
       concat('zone-', cast(c_nationkey AS string)) AS Region FROM customer WHERE c_custkey % 4 <> 0""",
)
def parse_tsv_report(spark, sf):
    key = F.col("c_custkey")
    ident = F.when(key % 4 == 0, "i-short").otherwise(F.concat(F.lit("i-"), F.lpad(key.cast("string"), 17, "0")))
    report = table(spark, sf, "customer").select(
        F.col("c_name").alias("Job"), ident.alias("AWS Instance ID"),
        F.concat(F.lit("zone-"), F.col("c_nationkey").cast("string"), F.lit("a")).alias("AWS Availability Zone"),
    )
    return logs.parse_tsv_report(report)


@query(
    "load_dimension",
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def load_dimension(spark, sf):
    lookup = tables.load_dimension(spark, f"{sf}/nation.parquet")
    return table(spark, sf, "customer").join(lookup, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(
    "union_region_inventories",
    """SELECT 'east' AS Region, s_suppkey, s_name, NULL::bigint AS c_custkey FROM supplier
       UNION ALL SELECT 'west', NULL, NULL, c_custkey FROM customer""",
)
def union_region_inventories(spark, sf):
    paths = {"east": f"{sf}/supplier.parquet", "west": f"{sf}/customer.parquet", "north": f"{sf}/no_such.parquet"}
    return tables.union_region_inventories(spark, paths, "parquet").select("Region", "s_suppkey", "s_name", "c_custkey")


@query(
    "read_latest_per_name",
    """WITH f AS (SELECT o_orderkey, concat('name', cast(o_custkey % 200 AS string)) AS NAME,
  concat(replace(substr(cast(o_orderdate AS string), 1, 10), '-', ''), '101010') AS STAMP FROM orders)
SELECT o_orderkey, NAME, STAMP, STAMP = max(STAMP) OVER (PARTITION BY NAME) AS is_latest FROM f""",
)
def read_latest_per_name(spark, sf):
    """Flag the newest file of each name; the file names are made from orders."""
    path = F.concat(
        F.lit("/requests/name"), (F.col("o_custkey") % 200).cast("string"), F.lit("-"),
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("101010.csv"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", path.alias("SOURCE_PATH"))
    return tables.flag_latest(rows).drop("SOURCE_PATH")

"""File inventories, shots, templates and logs derived from the test tables.

Each view exists twice with equal rows: as a DataFrame and as a SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import names, paths
from pathloom.operators.columns import with_sequence


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by the key of the join that follows, always.

    The test files have one row group each, so a scan alone is one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _text(col) -> F.Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def inv(spark: SparkSession, sf: str) -> DataFrame:
    """File inventory: one row per line item; paths repeat.

    Orders meet their customers first, so that line items, the most rows, are shuffled once, with sizes as whole numbers.
    """
    sized = table(spark, sf, "lineitem").withColumn("FILESIZE", F.floor("l_extendedprice").cast("bigint"))
    line, orders = spread(sized, "l_orderkey"), table(spark, sf, "orders")
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    ordered = (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    rows = line.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
    project = F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))
    kind = F.col("l_orderkey") % 3
    ext = F.when(kind == 0, ".exr").when(kind == 1, ".PNG").otherwise(".mov")
    file = F.concat(
        F.lit("/jobs/"), "c_mktsegment", F.lit("/"), project, F.lit("/IN/client/SH"),
        F.lpad(_text(F.col("o_custkey") % 50), 3, "0"), F.lit("/ord"), _text("l_orderkey"),
        F.lit("_v"), F.lpad(_text(F.col("l_orderkey") % 7), 3, "0"), F.lit("."),
        F.lpad(_text("l_linenumber"), 4, "0"), ext,
    )
    return rows.select(
        file.alias("FILE"),
        "FILESIZE",
        F.col("l_shipdate").alias("CREATION_TIME"), F.col("l_shipdate").alias("ENTRYTIME"),
        F.when(F.col("l_returnflag") == "R", "file").otherwise("no").alias("ISLINK"),
        F.col("c_mktsegment").alias("CLIENT"), project.alias("PROJECT"),
        F.col("l_orderkey").alias("OID"), F.col("l_linenumber").alias("FRAME"),
        F.col("l_partkey").alias("PK"), F.col("l_suppkey").alias("SK"),
    )


INV = """
SELECT concat('/jobs/', c.c_mktsegment, '/', replace(n.n_name, ' ', '_'), '/IN/client/SH',
         lpad(cast(o.o_custkey % 50 AS string), 3, '0'), '/ord', cast(l.l_orderkey AS string),
         '_v', lpad(cast(l.l_orderkey % 7 AS string), 3, '0'), '.',
         lpad(cast(l.l_linenumber AS string), 4, '0'),
         CASE l.l_orderkey % 3 WHEN 0 THEN '.exr' WHEN 1 THEN '.PNG' ELSE '.mov' END) AS FILE,
  cast(floor(l.l_extendedprice) AS bigint) AS FILESIZE,
  l.l_shipdate AS CREATION_TIME, l.l_shipdate AS ENTRYTIME,
  CASE WHEN l.l_returnflag = 'R' THEN 'file' ELSE 'no' END AS ISLINK,
  c.c_mktsegment AS CLIENT, replace(n.n_name, ' ', '_') AS PROJECT,
  l.l_orderkey AS OID, l.l_linenumber AS FRAME, l.l_partkey AS PK, l.l_suppkey AS SK
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory with sequence, extension and hash columns."""
    df = with_sequence(inv(spark, sf))
    return df.withColumns(
        {
            "DOTEXTENSION": names.extension(F.col("FILE")),
            "HASHEDFILE": paths.hash_key(F.col("FILE"), df.schema["FILE"].dataType),
        }
    )


ENRICHED = r"""
SELECT *, regexp_extract(FILE, '\.([^.]*)$', 1) AS DOTEXTENSION, sha256(trim(FILE)) AS HASHEDFILE,
  CASE WHEN lower(regexp_extract(FILE, '\.[^.]*$')) IN ('.exr', '.png') THEN
    regexp_replace(FILE, '\d+\.[^.]*$', '') || '%0' ||
    cast(length(regexp_extract(FILE, '(\d+)\.[^.]*$', 1)) AS string) || 'd' ||
    lower(regexp_extract(FILE, '\.[^.]*$')) ELSE '' END AS SEQUENCENAME,
  CASE WHEN lower(regexp_extract(FILE, '\.[^.]*$')) IN ('.exr', '.png') THEN
    regexp_extract(FILE, '(\d+)\.[^.]*$', 1) ELSE '' END AS SEQUENCEPOSITION,
  CASE WHEN lower(regexp_extract(FILE, '\.[^.]*$')) IN ('.exr', '.png') THEN
    cast(length(regexp_extract(FILE, '(\d+)\.[^.]*$', 1)) AS string) ELSE '' END AS PADDING
FROM inv"""


def shots(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("c_custkey") % 50
    return table(spark, sf, "customer").select(
        F.concat(F.lit("SH"), F.lpad(_text(number), 3, "0")).alias("SHOTNAME"),
        F.concat(F.lit("sh"), _text(number), F.lit("_alt")).alias("ALTSHOTNAME"),
    ).distinct()


SHOTS = """
SELECT DISTINCT concat('SH', lpad(cast(c_custkey % 50 AS string), 3, '0')) AS SHOTNAME,
  concat('sh', cast(c_custkey % 50 AS string), '_alt') AS ALTSHOTNAME FROM customer"""

# Template rows used by the template queries.
TEMPLATE_ROWS = [
    ("exr", "CLIENT/PROJECT/plates/SHOTNAME_YYYYMMDD.DOTEXTENSION"),
    ("png", "CLIENT/PROJECT/stills/SHOTNAME.PADDING.DOTEXTENSION"),
    ("png", "CLIENT/review/CUSTOMVAR-SHOTNAME.DOTEXTENSION"),
    ("mov", "CLIENT/review/SHOTNAME.DOTEXTENSION"),
]


def template(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(TEMPLATE_ROWS, "DOTEXTENSION string, PROVISIONEDLINK string")


TEMPLATE = " UNION ALL ".join(
    f"SELECT '{e}' AS DOTEXTENSION, '{link}' AS PROVISIONEDLINK" for e, link in TEMPLATE_ROWS
)


def version_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        (F.col("o_orderkey") % 23).cast("int").alias("VERSION"),
        F.col("o_orderpriority").alias("user"),
        F.concat(F.lit("item"), _text("o_custkey")).alias("item"),
    )


VERSION_LOG = """
SELECT replace(substr(cast(o_orderdate AS string), 1, 10), '-', '') AS date,
  cast(o_orderkey % 23 AS int) AS VERSION, o_orderpriority AS user_name,
  concat('item', cast(o_custkey AS string)) AS item FROM orders"""


def dirs(spark: SparkSession, sf: str) -> DataFrame:
    web = F.lit("/web/")
    url = F.replace(F.replace(F.col("url"), F.lit("https://"), web), F.lit("http://"), web)
    return table(spark, sf, "pages").select("page_id", url.alias("FILE"))


DIRS = """
SELECT page_id, replace(replace(url, 'https://', '/web/'), 'http://', '/web/') AS FILE FROM pages"""


def farm_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("Frames"), F.col("l_quantity").alias("RENDERTIME"),
        "l_shipdate", F.col("l_returnflag").alias("LAYER"),
    )


FARM_STATS = """
SELECT cast(l_linenumber AS int) AS Frames, l_quantity AS RENDERTIME, l_shipdate,
  l_returnflag AS LAYER FROM lineitem"""


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """Nested instance records made from suppliers."""
    key = F.col("s_suppkey")
    state = F.when(key % 4 == 0, "stopped").when(key % 4 == 1, "terminated").otherwise("running")
    group = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("group"), _text(key % 5)))
    kind = F.concat(F.lit("c"), _text(key % 6), F.lit("."), _text(F.lit(2) + key % 3), F.lit("xlarge"))
    return (
        table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("i-"), F.lpad(_text(key), 17, "0")).alias("InstanceId"),
            kind.alias("InstanceType"), F.struct(state.alias("Name")).alias("State"),
            F.struct(
                F.concat(F.lit("zone-"), F.lower("n_name"), F.lit("-1"), F.when(key % 2 == 0, "a").otherwise("b")).alias("AvailabilityZone"),
                F.lit("default").alias("Tenancy"),
            ).alias("Placement"),
            F.array(
                F.struct(F.lit("Owner").alias("Key"), _text("s_acctbal").alias("Value")),
                F.struct(F.lit("Name").alias("Key"), F.col("s_name").alias("Value")),
                F.struct(F.lit("renderGroup").alias("Key"), group.alias("Value")),
            ).alias("Tags"),
        )
    )


INSTANCES = """
SELECT concat('i-', lpad(cast(s_suppkey AS string), 17, '0')) AS InstanceId,
  concat('c', cast(s_suppkey % 6 AS string), '.', cast(2 + s_suppkey % 3 AS string), 'xlarge') AS InstanceType,
  CASE s_suppkey % 4 WHEN 0 THEN 'stopped' WHEN 1 THEN 'terminated' ELSE 'running' END AS State_Name,
  concat('zone-', lower(n_name), '-1', CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END) AS Zone,
  concat('zone-', lower(n_name), '-1') AS Region, s_name AS Name, s_suppkey AS k,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('group', cast(s_suppkey % 5 AS string)) END AS RenderGroup
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Nested status records; every fifth instance has none."""
    key = F.col("s_suppkey")

    def check(name: str, passed) -> F.Column:
        return F.struct(F.lit(name).alias("Name"), F.when(passed, "passed").otherwise("failed").alias("Status"))

    state = F.when(key % 4 == 0, "stopped").when(key % 4 == 1, "terminated").otherwise("running")
    return table(spark, sf, "supplier").where(key % 5 != 0).select(
        F.concat(F.lit("i-"), F.lpad(_text(key), 17, "0")).alias("InstanceId"),
        F.struct(state.alias("Name")).alias("InstanceState"),
        F.struct(F.array(check("reachability", key % 2 == 0)).alias("Details")).alias("InstanceStatus"),
        F.struct(F.array(check("reachability", key % 3 == 0), check("power", key % 7 == 0)).alias("Details")).alias("SystemStatus"),
        F.struct(F.lit("status").alias("AvailabilityZone")).alias("Placement"),
    )


_VIEWS = {
    "inv": INV, "enriched": ENRICHED, "shots": SHOTS, "template": TEMPLATE, "version_log": VERSION_LOG,
    "dirs": DIRS, "farm_stats": FARM_STATS, "instances": INSTANCES,
}


def with_views(*wanted: str, **more: str) -> str:
    """A ``WITH`` clause for the named views and further ones."""
    parts = [f"{n} AS ({_VIEWS[n]})" for n in wanted] + [f"{n} AS ({s})" for n, s in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"

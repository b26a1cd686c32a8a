"""Queries: joins, shot and project matching, snapshots."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import instances, inv, shots, statuses, table, with_views
from pathloom.operators import columns, joins


@query(
    "join_status",
    with_views("instances") + """
SELECT InstanceId, Zone AS "Placement.AvailabilityZone", CASE WHEN k % 5 = 0 THEN NULL ELSE State_Name END AS "InstanceState.Name",
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'status' END AS "Placement.AvailabilityZone_vSTATUS" FROM instances""",
)
def join_status(spark, sf):
    left = columns.flatten_one_level(instances(spark, sf))
    right = columns.flatten_one_level(statuses(spark, sf))
    names = ["InstanceId", "Placement.AvailabilityZone", "InstanceState.Name", "Placement.AvailabilityZone_vSTATUS"]
    return joins.join_status(left, right, "InstanceId").select(*[F.col(f"`{c}`") for c in names])


@query(
    "anti_by_normalized_key",
    with_views("inv") + "SELECT FILE, PK FROM inv WHERE OID % 2 = 0 AND lower(FILE) NOT IN (SELECT lower(FILE) FROM inv WHERE OID % 3 = 0)",
)
def anti_by_normalized_key(spark, sf):
    rows = inv(spark, sf)
    known = rows.where("OID % 3 = 0").select(F.concat(F.lit(" "), F.upper("FILE"), F.lit("  ")).alias("FILE"))
    return joins.anti_by_normalized_key(rows.where("OID % 2 = 0").select("FILE", "PK"), known, "FILE")


@query(
    "orphans",
    with_views("instances") + "SELECT InstanceId, Region FROM instances WHERE State_Name = 'running' AND RenderGroup <> '' AND k % 7 <> 2",
)
def orphans(spark, sf):
    from pathloom.functions import nested

    rows = instances(spark, sf).select(
        F.concat(F.lit(" "), "InstanceId").alias("InstanceId"), F.col("State.Name").alias("State_Name"),
        nested.tag_value(F.col("Tags"), "renderGroup").alias("RenderGroup"), nested.region_of_zone(F.col("Placement.AvailabilityZone")).alias("Region"),
    )
    known = table(spark, sf, "supplier").where("s_suppkey % 7 = 2").select(F.concat(F.lit("i-"), F.lpad(F.col("s_suppkey").cast("string"), 17, "0")).alias("id"))
    return joins.orphans(rows, known).select("InstanceId", "Region")


@query(
    "assign_project",
    with_views("inv") + "SELECT FILE, PK, CASE WHEN PROJECT = 'NATION_1' THEN 'acme' ELSE '' END AS CLIENT, CASE WHEN PROJECT = 'NATION_1' THEN 'NATION_1' ELSE '' END AS PROJECT, '' AS SHOTNAME FROM inv",
)
def assign_project(spark, sf):
    return joins.assign_project(inv(spark, sf).select("FILE", "PK"), "acme", "NATION_1")


@query(
    "assign_projects",
    with_views("inv") + "SELECT FILE, PK, concat('client of ', PROJECT) AS CLIENT, PROJECT FROM inv WHERE PROJECT <> 'NATION_3' UNION ALL SELECT FILE, PK, '', '' FROM inv WHERE PROJECT = 'NATION_3'",
)
def assign_projects(spark, sf):
    jobs = table(spark, sf, "nation").where("n_nationkey <> 3").select(
        F.concat(F.lit("client of "), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("CLIENT"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("PROJECT")
    )
    return joins.assign_projects(inv(spark, sf).select("FILE", "PK"), jobs).select("FILE", "PK", "CLIENT", "PROJECT")


_LAST_SHOT = """
, b AS (SELECT FILE, max(SHOTNAME) AS SHOTNAME FROM (SELECT DISTINCT FILE FROM inv WHERE PROJECT <> 'NATION_3') f JOIN shots ON contains(f.FILE, SHOTNAME) GROUP BY FILE)
"""


def _no_third(spark, sf):
    project = F.when(F.col("PROJECT") == "NATION_3", "").otherwise(F.col("PROJECT"))
    return inv(spark, sf).select("FILE", "PK", project.alias("PROJECT"))


@query(
    "assign_shot",
    with_views("inv", "shots") + _LAST_SHOT + "SELECT inv.FILE, PK, CASE WHEN PROJECT = 'NATION_3' THEN '' ELSE coalesce(b.SHOTNAME, '') END AS SHOTNAME FROM inv LEFT JOIN b ON inv.FILE = b.FILE",
)
def assign_shot(spark, sf):
    return joins.assign_shot(_no_third(spark, sf), shots(spark, sf)).select("FILE", "PK", "SHOTNAME")


@query(
    "assign_alt_shot",
    with_views("inv", "shots") + """
, alt AS (SELECT SHOTNAME, concat('/ord', cast((cast(substr(SHOTNAME, 3) AS int) + 1) * 11 AS string)) AS ALT FROM shots),
b AS (SELECT FILE, max(SHOTNAME) AS S FROM (SELECT DISTINCT FILE FROM inv WHERE OID % 2 = 0) f JOIN alt ON contains(FILE, ALT) GROUP BY FILE)
SELECT inv.FILE, PK, CASE WHEN OID % 2 = 1 THEN 'has' ELSE coalesce(S, '') END AS SHOTNAME, CASE WHEN OID % 2 = 0 AND S IS NOT NULL THEN 'yes' ELSE '' END AS ALTSHOTNAME
FROM inv LEFT JOIN b ON inv.FILE = b.FILE""",
)
def assign_alt_shot(spark, sf):
    rows = inv(spark, sf).select("FILE", "PK", "PROJECT", F.when(F.col("OID") % 2 == 1, "has").otherwise("").alias("SHOTNAME"))
    number = (F.substring("SHOTNAME", 3, 3).cast("int") + 1) * 11
    alt = shots(spark, sf).withColumn("ALTSHOTNAME", F.concat(F.lit("/ORD"), number.cast("string")))
    return joins.assign_alt_shot(rows, alt).drop("PROJECT")


@query(
    "assign_shot_multi",
    with_views("inv", "shots") + """
, b AS (SELECT FILE, min(SHOTNAME) AS S FROM (SELECT DISTINCT FILE FROM inv) f JOIN shots ON contains(FILE, substr(SHOTNAME, 3)) GROUP BY FILE)
SELECT inv.FILE, PK, CASE WHEN OID % 4 = 0 THEN 'SH007' ELSE coalesce(S, '') END AS SHOTNAME FROM inv LEFT JOIN b ON inv.FILE = b.FILE""",
)
def assign_shot_multi(spark, sf):
    link = F.when(F.col("OID") % 4 == 0, "/x/007").otherwise("")
    rows = inv(spark, sf).select("FILE", "PK", link.alias("LINK"))
    return joins.assign_shot_multi(rows, shots(spark, sf), "SH").drop("LINK")


@query(
    "thumb_lookup",
    with_views("inv") + """
SELECT DISTINCT FILE, CASE OID % 3 WHEN 1 THEN replace(regexp_extract(FILE, '[^/]*$'), '.png', '_thumbnail.png') WHEN 2 THEN 'mov_icon.png' ELSE '' END AS THUMBNAME FROM inv""",
)
def thumb_lookup(spark, sf):
    rows = inv(spark, sf).select("FILE", F.regexp_extract("FILE", r"[^/]*$", 0).alias("ITEMNAME"), F.regexp_extract("FILE", r"\.([^.]*)$", 1).alias("DOTEXTENSION"))
    defaults = spark.createDataFrame([("Png", "thumb", None), ("MOV", "icon", "mov_icon.png")], "DOTEXTENSION string, THUMBNAILTYPE string, DEFAULTTHUMBNAME string")
    return joins.thumb_lookup(rows.distinct(), defaults).select("FILE", "THUMBNAME")


@query(
    "fixed_thumbs",
    with_views("inv") + "SELECT DISTINCT FILE, CASE WHEN OID % 3 = 2 THEN replace(regexp_extract(FILE, '[^/]*$'), '.mov', '_thumbnail.png') ELSE '' END AS THUMBNAME FROM inv",
)
def fixed_thumbs(spark, sf):
    item, ext = F.regexp_extract("FILE", r"[^/]*$", 0), F.regexp_extract("FILE", r"\.([^.]*)$", 1)
    return inv(spark, sf).select("FILE", joins.fixed_thumbs(item, ext).alias("THUMBNAME")).distinct()


_LEAVES = "SELECT concat('/pkg/', p_brand, '/p', cast(p_partkey % 40 AS string), CASE p_partkey % 5 WHEN 0 THEN '.%04d.EXR' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tif' WHEN 3 THEN '.exr.bak' ELSE '.only' END) AS leaf FROM part WHERE p_partkey % 5 < 4 OR p_partkey = 4"


def leaves(spark, sf):
    key = F.col("p_partkey")
    end = (
        F.when(key % 5 == 0, ".%04d.EXR").when(key % 5 == 1, ".jpg").when(key % 5 == 2, ".tif").when(key % 5 == 3, ".exr.bak").otherwise(".only")
    )
    name = F.concat(F.lit("/pkg/"), "p_brand", F.lit("/p"), (key % 40).cast("string"), end)
    return table(spark, sf, "part").where("p_partkey % 5 < 4 OR p_partkey = 4").select(name.alias("DEST"))


@query(
    "match_destinations",
    f"""WITH l AS (SELECT DISTINCT leaf FROM ({_LEAVES})),
s AS (SELECT o_orderkey, o_orderkey % 6 AS t, CASE o_orderkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.tif' WHEN 2 THEN '.exr' WHEN 3 THEN '.only' WHEN 4 THEN '.mov' ELSE '.jpg' END AS ext FROM orders),
o AS (SELECT e.ext, string_agg(leaf, ', ' ORDER BY leaf) AS opts, count(*) AS n, min(leaf) AS one FROM (SELECT DISTINCT ext FROM s) e JOIN l ON contains(lower(regexp_extract(leaf, '[^/]*$')), e.ext) GROUP BY e.ext)
SELECT o_orderkey, CASE WHEN n = 1 THEN one END AS DEST, opts AS DESTOPTIONS, 0 AS OPTION_CHUNK FROM s LEFT JOIN o ON s.ext = o.ext""",
)
def match_destinations(spark, sf):
    t = F.col("o_orderkey") % 6
    ext = F.when(t == 0, ".jpeg").when(t == 1, ".TIFF").when(t == 2, ".%04d.exr").when(t == 3, ".only").when(t == 4, ".mov").otherwise(".jpg")
    src = F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), ext)
    sources = table(spark, sf, "orders").select("o_orderkey", src.alias("SRC"))
    return joins.match_destinations(sources, leaves(spark, sf)).select("o_orderkey", "DEST", "DESTOPTIONS", "OPTION_CHUNK")


@query(
    "semi_anti_split",
    "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 'button' ELSE 'item' END AS KIND FROM orders",
)
def semi_anti_split(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    hit, miss = joins.semi_anti_split(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", rich)
    kind = {"KIND": F.lit("button")}, {"KIND": F.lit("item")}
    return hit.withColumns(kind[0]).unionByName(miss.withColumns(kind[1])).select("o_orderkey", "KIND")


@query(
    "map_tasks",
    """WITH t AS (SELECT l_orderkey % 500 AS JobId, l_linenumber AS Frame, min(concat('t', cast(l_partkey AS string))) AS TaskId FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1, 2)
SELECT JobId, 0 AS CHUNK, string_agg(TaskId, ',' ORDER BY Frame, TaskId) AS TASKS FROM t WHERE Frame <= 3 GROUP BY JobId""",
)
def map_tasks(spark, sf):
    rows = table(spark, sf, "lineitem")
    tasks = rows.where("l_partkey % 2 = 0").select(
        (F.col("l_orderkey") % 500).alias("JobId"), F.col("l_linenumber").cast("string").alias("TaskFrameList"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("TaskId")
    )
    wanted = rows.where("l_linenumber <= 3").select((F.col("l_orderkey") % 500).alias("JobId"), F.col("l_linenumber").alias("Frame")).distinct()
    return joins.map_tasks(wanted, tasks).withColumn("TASKS", F.array_join("TASKS", ","))


_SNAPSHOTS = """
old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0)"""


def snapshots(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    state = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    return rows.where("o_orderkey % 5 <> 0"), rows.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", state)


@query(
    "snapshot_diff",
    f"WITH {_SNAPSHOTS}" + """
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
  coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS CHANGE
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""",
)
def snapshot_diff(spark, sf):
    return joins.snapshot_diff(*snapshots(spark, sf), ["o_orderkey"])


@query("apply_diff", f"WITH {_SNAPSHOTS} SELECT * FROM new")
def apply_diff(spark, sf):
    old, new = snapshots(spark, sf)
    return joins.apply_diff(old, joins.snapshot_diff(old, new, ["o_orderkey"]), ["o_orderkey"])


_INGEST = "SELECT page_id, FILE AS PATH FROM dirs UNION ALL SELECT page_id, regexp_replace(FILE, '/[^/]*$', '') FROM dirs WHERE page_id % 3 = 0"


def ingest_paths(spark, sf):
    from pathloom.catalog.views import dirs

    rows = dirs(spark, sf).withColumnRenamed("FILE", "PATH")
    return rows.unionByName(rows.where("page_id % 3 = 0").withColumn("PATH", F.regexp_replace("PATH", "/[^/]*$", "")))


@query(
    "prefix_duplicates",
    with_views("dirs") + f", p AS ({_INGEST}) SELECT page_id, PATH, EXISTS (SELECT 1 FROM p q WHERE starts_with(p.PATH, concat(rtrim(q.PATH, '/'), '/')) AND (q.page_id, q.PATH) <> (p.page_id, p.PATH)) AS ISDUPLICATE FROM p",
)
def prefix_duplicates(spark, sf):
    return joins.prefix_duplicates(ingest_paths(spark, sf))


@query(
    "placement_scores",
    "SELECT p_type AS InstanceType, concat('r', cast(p_size % 3 AS string)) AS Region, concat('az', cast(z AS string)) AS AvailabilityZone, p_partkey * z AS Score FROM part, (SELECT unnest([1, 2]) AS z)",
)
def placement_scores(spark, sf):
    def score(z):
        return F.struct(F.lit(f"az{z}").alias("AvailabilityZone"), (F.col("p_partkey") * z).alias("Score"))

    rows = table(spark, sf, "part").select(
        F.col("p_type").alias("InstanceType"), F.concat(F.lit("r"), (F.col("p_size") % 3).cast("string")).alias("Region"), F.array(score(1), score(2)).alias("SpotPlacementScores")
    )
    return joins.placement_scores(rows)


@query(
    "link_row_lookup",
    """WITH p AS (SELECT sha256(cast(o_custkey AS string)) AS HASHEDFILE, min(o_orderkey) AS SRC FROM orders GROUP BY o_custkey)
SELECT concat(c_name, '-file') AS FIELD, HASHEDFILE, SRC FROM customer JOIN p ON sha256(cast(c_custkey AS string)) = HASHEDFILE WHERE c_custkey % 2 = 0""",
)
def link_row_lookup(spark, sf):
    ident = F.when(F.col("c_custkey") % 2 == 0, F.sha2(F.col("c_custkey").cast("string"), 256))
    fields = table(spark, sf, "customer").select(F.concat("c_name", F.lit("-file")).alias("FIELD"), ident.alias("HASHEDFILE"))
    package = table(spark, sf, "orders").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("HASHEDFILE"), F.col("o_orderkey").alias("SRC"))
    return joins.link_row_lookup(fields, package)

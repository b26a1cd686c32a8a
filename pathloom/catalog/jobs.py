"""Queries: templates, versions and whole jobs."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.frames import _RANGES
from pathloom.catalog.views import enriched, instances, inv, shots, statuses, table, template, version_log, with_views
from pathloom.operators import aggregates, filters, templates
from pathloom.plans import instances as instance_jobs
from pathloom.plans import inventory, packages
from pathloom.session import store


def template_rows(spark, sf):
    shot = F.concat(F.lit("SH"), F.lpad((F.col("SK") % 50).cast("string"), 3, "0"))
    rows = enriched(spark, sf)
    return rows.select(
        "FILE", "PK", "SK", "CLIENT", "PROJECT", shot.alias("SHOTNAME"), F.lower("DOTEXTENSION").alias("DOTEXTENSION"), "PADDING"
    )


_ROWS = """
rows_in AS (SELECT FILE, PK, SK, CLIENT, PROJECT, concat('SH', lpad(cast(SK % 50 AS string), 3, '0')) AS SHOTNAME, lower(DOTEXTENSION) AS DOTEXTENSION, PADDING FROM enriched),
expanded AS (SELECT r.*, replace(replace(replace(replace(replace(PROVISIONEDLINK, 'CLIENT', CLIENT), 'PROJECT', PROJECT), 'SHOTNAME', SHOTNAME), 'DOTEXTENSION', r.DOTEXTENSION),
  'PADDING', CASE WHEN PADDING = '' THEN 'PADDING' ELSE concat('%0', PADDING, 'd') END) AS PROVISIONEDLINK FROM rows_in r JOIN template t ON r.DOTEXTENSION = t.DOTEXTENSION)
"""


@query("expand_templates", with_views("inv", "enriched", "template") + f", {_ROWS} SELECT * FROM expanded")
def expand_templates(spark, sf):
    return templates.expand_templates(template_rows(spark, sf), template(spark, sf))


@query(
    "expand_templates_without_extension",
    with_views("template") + "SELECT c_custkey, '' AS DOTEXTENSION, replace(PROVISIONEDLINK, 'CLIENT', c_mktsegment) AS PROVISIONEDLINK FROM customer, template",
)
def expand_templates_without_extension(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.lit("").alias("DOTEXTENSION"), F.col("c_mktsegment").alias("CLIENT"))
    out = templates.expand_templates(rows, template(spark, sf), add_source="append", source_columns=["c_custkey", "DOTEXTENSION"])
    return out.select("c_custkey", "DOTEXTENSION", "PROVISIONEDLINK")


def mapping(spark, sf):
    """Variables known by the mapping table, made from the parts table."""
    kind = F.when(F.col("p_partkey") % 2 == 0, "remap").otherwise("ignore")
    return table(spark, sf, "part").select(
        F.concat(F.lit("VAR"), (F.col("p_partkey")).cast("string")).alias("Variable"), kind.alias("Action"), F.concat(F.lit("val"), F.col("p_partkey").cast("string")).alias("Value")
    )


def variable_links(spark, sf):
    number = (F.col("o_orderkey") % 3000).cast("string")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("a/VAR"), number, F.lit("_x.VAR"), number, F.lit("/OTHER")).alias("LINK"))


@query(
    "resolve_variables",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3000 < (SELECT count(*) FROM part) AND o_orderkey % 2 = 0 THEN concat('a/val', cast(o_orderkey % 3000 AS string), '_x.val', cast(o_orderkey % 3000 AS string), '/OTHER')
       ELSE concat('a/VAR', cast(o_orderkey % 3000 AS string), '_x.VAR', cast(o_orderkey % 3000 AS string), '/OTHER') END AS LINK FROM orders""",
)
def resolve_variables(spark, sf):
    return templates.resolve_variables(variable_links(spark, sf), "LINK", mapping(spark, sf))


@query(
    "unknown_variables",
    "SELECT DISTINCT concat('VAR', cast(o_orderkey % 3000 AS string)) AS Variable FROM orders WHERE o_orderkey % 3000 >= (SELECT count(*) FROM part) UNION SELECT 'OTHER'",
)
def unknown_variables(spark, sf):
    return templates.unknown_variables(variable_links(spark, sf), ["LINK"], mapping(spark, sf))


@query(
    "replace_mapped_text",
    "SELECT doc_id, concat(text, ' see /new/', cast(doc_id % 50 AS string), ' and /keep/x end') AS t FROM documents WHERE NOT regexp_matches(text, '[/\\\\]')",
)
def replace_mapped_text(spark, sf):
    number = (F.col("doc_id") % 50).cast("string")
    rows = table(spark, sf, "documents").where(~F.col("text").rlike(r"[/\\]")).select(
        "doc_id", F.concat("text", F.lit(" see F:/old/p"), number, F.lit(".exr and /keep/x end")).alias("t")
    )
    known = table(spark, sf, "documents").select(
        F.concat(F.lit("F:/old/p"), number, F.lit(".exr")).alias("OLD"), F.concat(F.lit("/new/"), number).alias("NEW")
    )
    return templates.replace_mapped_text(rows, "t", known, "OLD", "NEW")


@query(
    "replace_mapped_files",
    "SELECT o_orderkey, concat('copy /new/c', cast(o_custkey AS string), ' to x') AS t FROM orders",
)
def replace_mapped_files(spark, sf):
    cust = F.col("o_custkey").cast("string")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("copy \\srv/a/f"), cust, F.lit(".exr to x")).alias("t"))
    known = table(spark, sf, "customer").select(
        F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(".exr")).alias("RAWITEMNAME"), F.concat(F.lit("/new/c"), F.col("c_custkey").cast("string")).alias("FILE")
    )
    return templates.replace_mapped_text(rows, "t", known, "RAWITEMNAME", "FILE", "raw_item_name")


@query(
    "virtual_columns",
    with_views("version_log") + """
, h AS (SELECT item, max(VERSION) AS h FROM version_log GROUP BY item)
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('v', lpad(cast(coalesce(h, 0) + 1 AS string), 4, '0')) END AS VERSION, '20240506' AS YYYYMMDD,
  (SELECT lpad(cast(coalesce(max(VERSION), 0) + 1 AS string), 3, '0') FROM version_log WHERE item = 'item7' AND date = '20240506') AS PKGVERSION3PADDED
FROM customer LEFT JOIN h ON concat('item', cast(c_custkey AS string)) = item""",
)
def virtual_columns(spark, sf):
    item = F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("item"), F.col("c_custkey").cast("string")))
    rows = table(spark, sf, "customer").select("c_custkey", item.alias("PARENTITEM"))
    return templates.add_virtual_columns(rows, version_log(spark, sf), "2024-05-06 10:00:00", package_item="item7").drop("PARENTITEM")


@query(
    "fill_session",
    """SELECT o_orderkey, concat('c', o_orderstatus) AS CLIENT, concat('c', o_orderstatus, '/', CASE WHEN o_orderkey % 3000 < (SELECT count(*) FROM part) AND o_orderkey % 2 = 0 THEN 'val' ELSE 'VAR' END, cast(o_orderkey % 3000 AS string)) AS LINK,
       concat('note c', o_orderstatus) AS NOTE FROM orders""",
)
def fill_session(spark, sf):
    number = (F.col("o_orderkey") % 3000).cast("string")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), "o_orderstatus").alias("CLIENT"), F.concat(F.lit("CLIENT/VAR"), number).alias("LINK"), F.concat(F.lit("note "), F.lit("c"), "o_orderstatus").alias("NOTE")
    )
    return templates.fill_session(rows, mapping(spark, sf))


@query(
    "dollar_externals",
    "SELECT o_orderkey, concat('/', n_name, '/$UNKNOWN/', n_name, '.x') AS DEST FROM orders JOIN nation ON o_custkey % 25 = n_nationkey",
)
def dollar_externals(spark, sf):
    name = F.concat(F.lit("/$N"), (F.col("o_custkey") % 25).cast("string"), F.lit("/$UNKNOWN/$N"), (F.col("o_custkey") % 25).cast("string"), F.lit(".x"))
    values = table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("NAME"), F.col("n_name").alias("VALUE"))
    return templates.dollar_externals(table(spark, sf, "orders").select("o_orderkey", name.alias("DEST")), "DEST", values)


@query(
    "fill_version",
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN concat('/a/shot', cast(o_custkey AS string), '_VERSION.exr')
       ELSE concat('/a/shot', cast(o_custkey AS string), '_v', lpad(cast(o_custkey % 50 + 1 AS string), 3, '0'), '.exr') END AS DEST FROM orders""",
)
def fill_version(spark, sf):
    cust = F.col("c_custkey")
    registry = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.concat(F.lit("shot"), cust.cast("string"), F.lit("_VERSION")).alias("IDENTIFIER"), F.concat((cust % 50).cast("string"), F.lit("-20240101-v-3")).alias("ENTRY")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("/a/shot"), F.col("o_custkey").cast("string"), F.lit("_VERSION.exr")).alias("DEST"))
    return templates.fill_version(rows, "DEST", registry)


@query(
    "next_registry",
    "SELECT concat('shot', cast(c_custkey AS string)) AS IDENTIFIER, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0) THEN concat(cast(c_custkey % 50 + 1 AS string), '-20240506_101010-v-3') ELSE concat(cast(c_custkey % 50 AS string), '-20240101-v-3') END AS ENTRY FROM customer",
)
def next_registry(spark, sf):
    cust = F.col("c_custkey")
    registry = table(spark, sf, "customer").select(F.concat(F.lit("shot"), cust.cast("string")).alias("IDENTIFIER"), F.concat((cust % 50).cast("string"), F.lit("-20240101-v-3")).alias("ENTRY"))
    used = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderkey % 4 = 0").select(F.concat(F.lit("shot"), F.col("o_custkey").cast("string")).alias("IDENTIFIER"))
    return templates.next_registry(registry, used, "20240506_101010")


@query(
    "next_versions",
    with_views("version_log") + """
, h AS (SELECT item, max(CASE WHEN NOT contains(item, 'item1') OR date >= '19980101' AND date = '19980506' THEN VERSION END) AS h FROM version_log GROUP BY item)
SELECT concat('item', cast(c_custkey AS string)) AS item, coalesce(h, 0) AS HIGHEST, coalesce(h, 0) + 1 AS WORKING, concat('v', lpad(cast(coalesce(h, 0) + 1 AS string), 4, '0')) AS VERSION_ID
FROM customer LEFT JOIN h ON concat('item', cast(c_custkey AS string)) = item""",
)
def next_versions(spark, sf):
    items = table(spark, sf, "customer").select(F.concat(F.lit("item"), F.col("c_custkey").cast("string")).alias("item"))
    return templates.next_version(items, version_log(spark, sf), day="19980506", dated="item1")


@query(
    "version_log_rows",
    with_views("version_log") + "SELECT '20240506' AS date, cast(max(VERSION) AS string) AS VERSION, 'me' AS user_name, item FROM version_log GROUP BY item",
)
def version_log_rows(spark, sf):
    log = version_log(spark, sf)
    working = templates.next_version(log.select("item").distinct(), log, "current")
    return templates.version_log_rows(working, "20240506", "me").withColumnRenamed("user", "user_name")


_INVENTORY = with_views("inv", "enriched", "shots") + """
, frames AS (SELECT SEQUENCENAME AS k, cast(SEQUENCEPOSITION AS bigint) AS f FROM enriched WHERE SEQUENCENAME <> ''),
""" + _RANGES + r""",
grouped AS (SELECT SEQUENCENAME AS FILE, SEQUENCENAME, cast(sum(FILESIZE) AS bigint) AS sz, min(FILE) AS F1, any_value(PROJECT) AS P FROM enriched WHERE SEQUENCENAME <> '' GROUP BY 1, 2
  UNION ALL SELECT FILE, '', FILESIZE, FILE, PROJECT FROM enriched WHERE SEQUENCENAME = ''),
shot AS (SELECT f AS F2, max(SHOTNAME) AS SHOT FROM (SELECT DISTINCT F1 AS f FROM grouped WHERE P = 'NATION_1') JOIN shots ON contains(f, SHOTNAME) GROUP BY 1),
named AS (SELECT g.*, coalesce(SHOT, '') AS SHOTNAME, replace(regexp_extract(FILE, '[^/]*$'), '.%04d', '') AS ITEMNAME FROM grouped g LEFT JOIN shot ON F1 = F2)
SELECT FILE, SEQUENCENAME, sha256(F1) AS HASHEDFILE, CASE WHEN P = 'NATION_1' THEN 'acme' ELSE '' END AS CLIENT, CASE WHEN P = 'NATION_1' THEN P ELSE '' END AS PROJECT, SHOTNAME, ITEMNAME,
  CASE WHEN sz < 1024 THEN concat(cast(sz::double AS string), ' B') WHEN sz < 1048576 THEN concat(cast(round_even(sz / 1024.0::double, 2) AS string), ' KB') ELSE concat(cast(round_even(sz / 1048576.0::double, 2) AS string), ' MB') END AS FILESIZE,
  coalesce(cast(lo AS string), '') AS FIRSTFRAME, coalesce(cast(hi AS string), '') AS LASTFRAME, coalesce(span, '') AS FRAMERANGE, coalesce(gaps, '') AS MISSINGFRAMES,
  regexp_replace(ITEMNAME, '\.[^.]*$', '') AS STRIPPEDITEMNAME, CASE WHEN regexp_extract(ITEMNAME, '_v(\d+)', 1) = '000' THEN '' ELSE concat('v', regexp_extract(ITEMNAME, '_v(\d+)', 1)) END AS ITEMVERSION
FROM named LEFT JOIN texts ON SEQUENCENAME = k AND SEQUENCENAME <> ''"""


def _scan(spark, sf):
    return inv(spark, sf).select(
        "FILE", "FILESIZE", "CREATION_TIME", F.col("CREATION_TIME").alias("MODIFICATION_TIME"), "ISLINK", F.lit("").alias("TARGET"), F.lit("online").alias("STATUS")
    )


@query("build_inventory", _INVENTORY)
def build_inventory(spark, sf):
    now = F.lit("2024-05-06 10:00:00").cast("timestamp")
    out = inventory.build_inventory(_scan(spark, sf), "acme", "NATION_1", shots(spark, sf), now)
    return out.select(
        "FILE", "SEQUENCENAME", "HASHEDFILE", "CLIENT", "PROJECT", "SHOTNAME", "ITEMNAME", "FILESIZE", "FIRSTFRAME", "LASTFRAME",
        "FRAMERANGE", "MISSINGFRAMES", "STRIPPEDITEMNAME", "ITEMVERSION",
    )


@query(
    "compact_inventory",
    with_views("inv", "enriched") + """
SELECT PROJECT, count(*) AS FILES, cast(sum(FILESIZE) AS bigint) AS FILESIZE FROM (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY ENTRYTIME DESC, HASHEDFILE, PK, SK, FILESIZE) AS r FROM enriched) WHERE r = 1 GROUP BY PROJECT""",
)
def compact_inventory(spark, sf):
    """Compacted snapshots, summed per partition value."""
    rows = inventory.compact_inventory(enriched(spark, sf), True, ["PK", "SK", "FILESIZE"])
    return rows.groupBy("PROJECT").agg(F.count(F.lit(1)).alias("FILES"), F.sum("FILESIZE").alias("FILESIZE"))


@query(
    "delete_and_compact",
    with_views("inv", "enriched") + """
, latest AS (SELECT * FROM (SELECT *, max(ENTRYTIME) OVER (PARTITION BY HASHEDFILE) AS m FROM enriched) WHERE ENTRYTIME = m)
SELECT PROJECT, FILE, PK, SK FROM latest WHERE FILE NOT IN (SELECT FILE FROM enriched WHERE OID % 10 = 3) AND SEQUENCENAME NOT IN (SELECT SEQUENCENAME FROM enriched WHERE OID % 10 = 6 AND SEQUENCENAME <> '')""",
)
def delete_and_compact(spark, sf):
    from pathloom.catalog.filters import deletions

    rows = enriched(spark, sf).select("PROJECT", "FILE", "SEQUENCENAME", "HASHEDFILE", "ENTRYTIME", "OID", "PK", "SK")
    kept = filters.delete_by_keys(inventory.compact_inventory(rows), deletions(rows))
    return kept.select("PROJECT", "FILE", "PK", "SK")


_PROVISION = with_views("inv", "enriched", "template", "version_log") + f""", {_ROWS},
final AS (SELECT FILE, PK, SK, replace(replace(PROVISIONEDLINK, 'YYYYMMDD', '20240506'), 'CUSTOMVAR', 'final') AS PROVISIONEDLINK FROM expanded),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PROVISIONEDLINK, FILE ORDER BY PK, SK) AS r FROM final) WHERE r = 1)
"""


def _provision(spark, sf):
    known = spark.createDataFrame([("CUSTOMVAR", "remap", "final")], "Variable string, Action string, Value string")
    rows = template_rows(spark, sf).withColumn("PARENTITEM", F.lit(""))
    links = packages.provision_links(rows, template(spark, sf), known, version_log(spark, sf), "2024-05-06 10:00:00", ["PK", "SK"])
    return links.select("FILE", "PK", "SK", "PROVISIONEDLINK")


@query("provision_links", _PROVISION + "SELECT FILE, PK, SK, PROVISIONEDLINK FROM links")
def provision_links(spark, sf):
    return _provision(spark, sf)


@query(
    "provision_links_versions",
    _PROVISION + """, top AS (SELECT item, max("VERSION") AS m FROM version_log GROUP BY item),
named AS (SELECT FILE, PK, SK, concat(replace(replace(PROVISIONEDLINK, 'YYYYMMDD', '20240506'), 'CUSTOMVAR', 'final'), '/',
  'v', lpad(cast(coalesce(m, 0) + 1 AS varchar), 4, '0')) AS PROVISIONEDLINK FROM expanded LEFT JOIN top ON item = concat('item', cast(SK AS varchar)))
SELECT FILE, PK, SK, PROVISIONEDLINK FROM (SELECT *, row_number() OVER (PARTITION BY PROVISIONEDLINK, FILE ORDER BY PK, SK) AS r FROM named) WHERE r = 1""",
)
def provision_links_versions(spark, sf):
    """Items with versions in the log; of the rows of a variable the one with the lowest order decides."""
    known = spark.createDataFrame(
        [("CUSTOMVAR", "ignore", "no", 2), ("CUSTOMVAR", "remap", "final", 1), ("PROJECT", "ignore", "", 3)], "Variable string, Action string, Value string, n int")
    rows = template_rows(spark, sf).withColumn("PARENTITEM", F.concat(F.lit("item"), F.col("SK").cast("string")))
    layout = template(spark, sf).withColumn("PROVISIONEDLINK", F.concat("PROVISIONEDLINK", F.lit("/VERSION")))
    links = packages.provision_links(rows, layout, known, version_log(spark, sf), "2024-05-06 10:00:00", ["PK", "SK"], mapping_order=F.col("n"))
    return links.select("FILE", "PK", "SK", "PROVISIONEDLINK")


@query(
    "reviewed_links",
    _PROVISION + "SELECT FILE, PK, PROVISIONEDLINK, CASE WHEN count(*) OVER (PARTITION BY PROVISIONEDLINK) > 1 THEN 'invalid' ELSE 'valid' END AS STATUS FROM links",
)
def reviewed_links(spark, sf):
    return packages.reviewed_links(_provision(spark, sf)).select("FILE", "PK", "PROVISIONEDLINK", "STATUS")


@query(
    "package_links",
    _PROVISION + """
, d AS (SELECT PROVISIONEDLINK AS l, min(FILE) AS c FROM links GROUP BY 1)
SELECT FILE, PROVISIONEDLINK, concat(CASE WHEN len(string_split(PROVISIONEDLINK, '/')) = 4 THEN '../../../../' ELSE '../../../' END, substr(FILE, 2)) AS TARGET FROM links JOIN d ON PROVISIONEDLINK = l AND FILE = c""",
)
def package_links(spark, sf):
    links = store(_provision(spark, sf))
    decisions = links.groupBy("PROVISIONEDLINK").agg(F.min("FILE").alias("FILE"))
    reviewed = packages.reviewed_links(links, decisions)
    blank = {c: F.lit(None).cast("string") for c in ("FIRSTFRAME", "LASTFRAME", "PADDING")}
    return packages.package_links(reviewed.withColumns(blank), "/pkg").drop("FRAME")


@query(
    "instance_inventory",
    with_views("instances") + """
SELECT InstanceId, Name, RenderGroup, Region, split_part(InstanceType, '.', 1) AS InstanceFamily, CASE WHEN k % 5 = 0 THEN '' ELSE State_Name END AS State,
  CASE WHEN k % 5 = 0 THEN 0 ELSE (k % 2 = 0)::int + (k % 3 = 0)::int + (k % 7 = 0)::int END AS StatusCheckSummary
FROM instances WHERE k % 5 = 0 OR State_Name <> 'terminated'""",
)
def instance_inventory(spark, sf):
    out = instance_jobs.instance_inventory(instances(spark, sf), statuses(spark, sf))
    return out.select("InstanceId", "Name", "RenderGroup", "Region", "InstanceFamily", "State", "StatusCheckSummary")


@query(
    "instance_chart",
    with_views("instances") + """
SELECT Region, InstanceType, cast(sum(CASE WHEN k % 5 = 0 THEN 0 WHEN State_Name = 'running' THEN 1 WHEN State_Name = 'stopped' THEN -1 ELSE 0 END) AS bigint) AS COUNT
FROM instances WHERE k % 5 = 0 OR State_Name <> 'terminated' GROUP BY ALL""",
)
def instance_chart(spark, sf):
    rows = instance_jobs.instance_inventory(instances(spark, sf), statuses(spark, sf))
    return aggregates.signed_counts(rows, state="State")


@query(
    "refresh_files",
    with_views("inv", "enriched", "shots") + """
, frames AS (SELECT SEQUENCENAME AS k, cast(SEQUENCEPOSITION AS bigint) AS f FROM enriched WHERE SEQUENCENAME <> ''),
""" + _RANGES + """
SELECT k AS FILE, span AS FRAMERANGE, gaps AS MISSINGFRAMES FROM texts UNION SELECT FILE, '', '' FROM enriched WHERE SEQUENCENAME = ''""",
)
def refresh_files(spark, sf):
    scan = _scan(spark, sf).select("FILE", "FILESIZE", "CREATION_TIME")
    columns = "FILE string, FRAMERANGE string, MISSINGFRAMES string"
    none = spark.createDataFrame([], columns)
    out = inventory.refresh_files(none, scan, "acme", "NATION_1", shots(spark, sf))
    return out.select("FILE", "FRAMERANGE", "MISSINGFRAMES").distinct()

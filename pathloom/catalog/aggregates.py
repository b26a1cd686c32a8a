"""Queries: counts, sums, lists and hashes."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.joins import _INGEST, ingest_paths
from pathloom.catalog.views import dirs, farm_stats, instances, inv, table, version_log, with_views
from pathloom.functions import nested
from pathloom.operators import aggregates, joins


@query("count_states", "SELECT count(*) FILTER (event_type = 'click') AS QUEUED, count(*) FILTER (event_type = 'error') AS RUNNING FROM events")
def count_states(spark, sf):
    state = F.when(F.col("event_type") == "click", "Queued").when(F.col("event_type") == "error", "Rendering").otherwise("Done")
    return aggregates.count_states(table(spark, sf, "events").select(state.alias("JobStatus")))


@query("sum_by_frame", with_views("farm_stats") + "SELECT Frames, sum(RENDERTIME) AS RENDERTIME FROM farm_stats GROUP BY Frames")
def sum_by_frame(spark, sf):
    return aggregates.sum_by_frame(farm_stats(spark, sf))


@query(
    "sum_by_layer_frame",
    with_views("farm_stats") + "SELECT CASE WHEN grouping(LAYER) = 1 THEN 'Aggregated' ELSE LAYER END AS LAYER, Frames, sum(RENDERTIME) AS RENDERTIME FROM farm_stats GROUP BY GROUPING SETS ((LAYER, Frames), (Frames))",
)
def sum_by_layer_frame(spark, sf):
    return aggregates.sum_by_layer_frame(farm_stats(spark, sf))


@query(
    "signed_counts",
    with_views("instances") + "SELECT Region, InstanceType, cast(sum(CASE State_Name WHEN 'running' THEN 1 WHEN 'stopped' THEN -1 ELSE 0 END) AS bigint) AS COUNT FROM instances GROUP BY ALL",
)
def signed_counts(spark, sf):
    rows = instances(spark, sf).select(
        nested.region_of_zone(F.col("Placement.AvailabilityZone")).alias("Region"), "InstanceType", F.initcap("State.Name").alias("State_Name")
    )
    return aggregates.signed_counts(rows)


@query(
    "grouped_view",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS ROWS, cast(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) AS bigint) AS LEVEL FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)",
)
def grouped_view(spark, sf):
    return aggregates.grouped_view(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "series_by_name",
    """WITH r AS (SELECT concat('s', cast(l_suppkey % 40 AS string), '.exr') AS SERIES, l_orderkey AS f, l_partkey AS v FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY SERIES ORDER BY f, substr(md5(concat('{"v":', cast(v AS string), '}')), 1, 3), v) AS no FROM r)
SELECT SERIES, cast((no - 1) // 500 AS int) AS CHUNK, string_agg(concat(cast(f AS string), ':', cast(v AS string)), ',' ORDER BY no) AS POINTS FROM n GROUP BY ALL""",
)
def series_by_name(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string")).alias("FILENAME"), F.lit("exr").alias("DOTEXTENSION"),
        F.col("l_orderkey").alias("FRAMENUMBER"), F.col("l_partkey").alias("v"),
    )
    lists = aggregates.series_by_name(rows, values=["v"], chunk_rows=500)
    text = F.transform("POINTS", lambda p: F.concat(p["FRAMENUMBER"].cast("string"), F.lit(":"), p["v"].cast("string")))
    return lists.withColumn("POINTS", F.array_join(text, ","))


@query("frame_labels", "SELECT DISTINCT l_linenumber FROM lineitem ORDER BY 1")
def frame_labels(spark, sf):
    return aggregates.frame_labels(table(spark, sf, "lineitem"), "l_linenumber")


@query("highest_version", with_views("version_log") + "SELECT item, coalesce(max(CASE WHEN VERSION % 5 = 0 THEN NULL ELSE VERSION END), 0) AS HIGHEST FROM version_log GROUP BY item")
def highest_version(spark, sf):
    text = F.when(F.col("VERSION") % 5 == 0, "bad").otherwise(F.col("VERSION").cast("string"))
    return aggregates.highest_version(version_log(spark, sf).withColumn("VERSION", text))


@query(
    "next_suffix",
    "SELECT concat('pkg7-', lpad(cast(max(o_orderkey % 1000) + 1 AS string), greatest(3, length(cast(max(o_orderkey % 1000) + 1 AS string)))::int, '0')) AS NAME FROM orders WHERE o_custkey % 10 = 7 AND o_orderkey % 3 > 0",
)
def next_suffix(spark, sf):
    tail = F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise((F.col("o_orderkey") % 1000).cast("string"))
    names = table(spark, sf, "orders").select(F.concat(F.lit("pkg"), (F.col("o_custkey") % 10).cast("string"), F.lit("-"), tail).alias("NAME"))
    return aggregates.next_suffix(names, "pkg7")


@query(
    "next_suffixes",
    """WITH h AS (SELECT o_custkey AS k, max(o_orderkey % 200) AS h FROM orders GROUP BY 1)
SELECT concat('pkg', cast(c_custkey AS string)) AS PREFIX, concat('pkg', cast(c_custkey AS string), '-', lpad(cast(coalesce(h, 0) + 1 AS string), 3, '0')) AS NAME FROM customer LEFT JOIN h ON c_custkey = k""",
)
def next_suffixes(spark, sf):
    names = table(spark, sf, "orders").select(F.concat(F.lit("pkg"), F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_orderkey") % 200).cast("string")).alias("NAME"))
    prefixes = table(spark, sf, "customer").select(F.concat(F.lit("pkg"), F.col("c_custkey").cast("string")).alias("PREFIX"))
    return aggregates.next_suffixes(names, prefixes)


@query(
    "total_size",
    with_views("dirs") + f""", p AS ({_INGEST}), d AS (SELECT page_id, PATH, EXISTS (SELECT 1 FROM p q WHERE starts_with(p.PATH, concat(rtrim(q.PATH, '/'), '/')) AND (q.page_id, q.PATH) <> (p.page_id, p.PATH)) AS dup FROM p)
SELECT cast(sum(page_id * 10) AS bigint) AS TOTALSIZE, cast(sum(CASE WHEN page_id % 2 = 0 THEN page_id * 10 ELSE 0 END) AS bigint) AS CROSSSIZE FROM d WHERE NOT dup""",
)
def total_size(spark, sf):
    marked = joins.prefix_duplicates(ingest_paths(spark, sf))
    return aggregates.total_size(marked.withColumns({"SIZE": F.col("page_id") * 10, "ISDESTFSMATCH": F.col("page_id") % 2 == 1}))


@query("latest_scan_time", with_views("inv") + r"SELECT regexp_replace(FILE, '/[^/]*$', '') AS DIRECTORY, max(ENTRYTIME) AS SCANTIME FROM inv GROUP BY 1")
def latest_scan_time(spark, sf):
    rows = inv(spark, sf).select(F.regexp_replace("FILE", "/[^/]*$", "").alias("DIRECTORY"), F.col("ENTRYTIME").alias("SCANTIME"))
    return aggregates.latest_scan_time(rows)


@query(
    "group_ids_by_region",
    """WITH n AS (SELECT c_mktsegment AS Region, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(c_name), 1, 3), c_name) AS r FROM customer)
SELECT Region, cast((r - 1) // 100 AS int) AS CHUNK, string_agg(c_name, ',' ORDER BY r) AS IDS FROM n GROUP BY ALL""",
)
def group_ids_by_region(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Region"), "c_name")
    lists = aggregates.group_ids_by_region(rows, "ec2_instances", "c_name", chunk_rows=100)
    return lists.withColumn("IDS", F.array_join(F.transform("IDS", lambda x: x["InstanceId"]), ","))


@query("distinct_combos", with_views("inv") + "SELECT DISTINCT CLIENT, PROJECT FROM inv")
def distinct_combos(spark, sf):
    return aggregates.distinct_combos(inv(spark, sf), ["CLIENT", "PROJECT"])


@query(
    "deepest_common_parent",
    with_views("inv") + """
, p AS (SELECT DISTINCT FILE, string_split(FILE, '/') AS s FROM inv WHERE CLIENT = 'BUILDING'), a AS (SELECT FILE, array_to_string(s[1:n], '/') AS d FROM (SELECT FILE, s, unnest(range(1, len(s))) AS n FROM p))
SELECT d AS PARENT FROM a GROUP BY d HAVING count(*) = (SELECT count(*) FROM p) ORDER BY length(d) DESC LIMIT 1""",
)
def deepest_common_parent(spark, sf):
    return aggregates.deepest_common_parent(inv(spark, sf).where("CLIENT = 'BUILDING'"))


@query(
    "collapse_choices",
    """WITH d AS (SELECT lang, concat(source, cast(doc_id % 30 AS string)) AS choice, CASE WHEN doc_id % 11 = 0 THEN 'valid' END AS STATUS FROM documents),
e AS (SELECT lang, choice, CASE WHEN STATUS = 'valid' THEN 0 ELSE 1 END AS o FROM d)
SELECT lang, string_agg(choice, ', ' ORDER BY o, CASE WHEN o = 1 THEN levenshtein(lower(lang), lower(choice)) ELSE 0 END, substr(md5(choice), 1, 3), choice) AS choice, 0 AS CHUNK FROM e GROUP BY lang""",
)
def collapse_choices(spark, sf):
    rows = table(spark, sf, "documents").select(
        "lang", F.concat("source", (F.col("doc_id") % 30).cast("string")).alias("choice"), F.when(F.col("doc_id") % 11 == 0, "valid").alias("STATUS")
    )
    return aggregates.collapse_choices(rows, "lang", "choice")


@query(
    "tree_hash",
    with_views("dirs") + """
, h AS (SELECT DISTINCT FILE, sha256(FILE) AS x FROM dirs),
v AS (SELECT ('0x' || substr(x, 1, 15))::bigint % 1000000000000000000 AS a, ('0x' || substr(x, 16, 15))::bigint % 1000000000000000000 AS b,
  ('0x' || substr(x, 31, 15))::bigint % 1000000000000000000 AS c, ('0x' || substr(x, 46, 15))::bigint % 1000000000000000000 AS d FROM h)
SELECT count(*) AS DIRECTORIES, sha256(concat_ws(':', cast(count(*) AS string), cast(sum(a) AS string), cast(sum(b) AS string), cast(sum(c) AS string), cast(sum(d) AS string))) AS TREE_HASH FROM v""",
)
def tree_hash(spark, sf):
    return aggregates.tree_hash(dirs(spark, sf))


@query(
    "sub_items",
    "SELECT c_name AS item, CASE WHEN o_orderkey IS NOT NULL THEN concat('sub', cast(o_orderkey AS string)) END AS sub_item, CASE WHEN o_orderkey IS NULL THEN 'no sub-items' END AS PROBLEM FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0) ON c_custkey = o_custkey",
)
def sub_items(spark, sf):
    customer = table(spark, sf, "customer")
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderkey % 4 = 0").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    subs = rows.select(F.col("c_name").alias("item"), F.concat(F.lit("sub"), F.col("o_orderkey").cast("string")).alias("sub_item"))
    return aggregates.sub_items(subs, customer.select(F.col("c_name").alias("item")))


@query("path_groups", with_views("dirs") + "SELECT FILE AS path, count(*) AS ENTRIES, min(page_id) AS first_page FROM dirs GROUP BY FILE")
def path_groups(spark, sf):
    groups = aggregates.path_groups(dirs(spark, sf).select(F.col("FILE").alias("path"), "page_id"))
    return groups.select("path", "ENTRIES", F.col("FIRST_ENTRY.page_id").alias("first_page"))


@query(
    "directory_columns",
    """WITH n AS (SELECT c_mktsegment AS d, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(c_name), 1, 3), c_name) AS r FROM customer)
SELECT r AS ROW_NO, coalesce(max(CASE WHEN d = 'BUILDING' THEN c_name END), '') AS BUILDING, coalesce(max(CASE WHEN d = 'MACHINERY' THEN c_name END), '') AS MACHINERY FROM n WHERE d IN ('BUILDING', 'MACHINERY') GROUP BY r""",
)
def directory_columns(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("DIRECTORY"), F.col("c_name").alias("NAME"))
    return aggregates.directory_columns(rows, ["BUILDING", "MACHINERY"])

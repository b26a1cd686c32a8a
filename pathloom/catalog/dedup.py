"""Queries: latest rows, first rows, duplicates and reviews."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import enriched, inv, table, with_views
from pathloom.operators import dedup, tables

_KEEP = ["FILE", "HASHEDFILE", "ENTRYTIME", "FILESIZE", "PK", "SK"]


def hashed(spark, sf):
    return enriched(spark, sf).select(*_KEEP)


@query(
    "keep_latest_ties",
    with_views("inv", "enriched") + """
SELECT FILE, HASHEDFILE, ENTRYTIME, FILESIZE, PK, SK FROM
  (SELECT *, max(ENTRYTIME) OVER (PARTITION BY HASHEDFILE) AS m FROM enriched) WHERE ENTRYTIME = m""",
)
def keep_latest_ties(spark, sf):
    return dedup.keep_latest_ties(hashed(spark, sf))


@query(
    "keep_latest_then_distinct",
    with_views("inv", "enriched") + """
SELECT FILE, HASHEDFILE, ENTRYTIME, FILESIZE, PK, SK FROM
  (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY ENTRYTIME DESC, HASHEDFILE, PK, SK, FILESIZE) AS r FROM enriched) WHERE r = 1""",
)
def keep_latest_then_distinct(spark, sf):
    return dedup.keep_latest_then_distinct(hashed(spark, sf), ties=["PK", "SK", "FILESIZE"])


_TWO_STAGE = """
, k AS (SELECT FILE, ENTRYTIME, PK, SK, FILESIZE, sha256(concat(CLIENT, '/', PROJECT, '/', cast(OID % 500 AS string))) AS HASHEDFILE FROM inv),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY HASHEDFILE ORDER BY ENTRYTIME DESC, PK, SK, FILESIZE) AS r FROM k) WHERE r = 1),
f AS (SELECT concat('file', cast(PK % 400 AS string)) AS FILE, HASHEDFILE, ENTRYTIME, PK, SK, FILESIZE FROM a)
"""


def _two_stage_rows(spark, sf):
    key = F.concat("CLIENT", F.lit("/"), "PROJECT", F.lit("/"), (F.col("OID") % 500).cast("string"))
    return inv(spark, sf).select(
        F.concat(F.lit("file"), (F.col("PK") % 400).cast("string")).alias("FILE"), F.sha2(key, 256).alias("HASHEDFILE"),
        "ENTRYTIME", "PK", "SK", "FILESIZE",
    )


@query(
    "keep_latest_two_stage",
    with_views("inv") + _TWO_STAGE + "SELECT * EXCLUDE (q) FROM (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY HASHEDFILE, PK, SK, FILESIZE) AS q FROM f) WHERE q = 1",
)
def keep_latest_two_stage(spark, sf):
    return dedup.keep_latest_two_stage(_two_stage_rows(spark, sf), ties=["PK", "SK", "FILESIZE"])


@query(
    "keep_latest_two_stage_time",
    with_views("inv") + _TWO_STAGE + "SELECT * EXCLUDE (q) FROM (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY ENTRYTIME, HASHEDFILE, PK, SK, FILESIZE) AS q FROM f) WHERE q = 1",
)
def keep_latest_two_stage_time(spark, sf):
    return dedup.keep_latest_two_stage(_two_stage_rows(spark, sf), second_order="time", ties=["PK", "SK", "FILESIZE"])


@query(
    "latest_by_file",
    with_views("inv") + "SELECT FILE, ENTRYTIME, FILESIZE, PK, SK FROM (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY ENTRYTIME DESC, PK, SK, FILESIZE) AS r FROM inv) WHERE r = 1",
)
def latest_by_file(spark, sf):
    rows = inv(spark, sf).select("FILE", "ENTRYTIME", "FILESIZE", "PK", "SK")
    return dedup.first_by_key(rows, ["FILE"], [F.col("ENTRYTIME").desc(), "PK", "SK", "FILESIZE"])


@query(
    "dedup_first_by_key",
    "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1",
)
def dedup_first_by_key(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return dedup.first_by_key(rows, ["o_custkey"], ["o_orderkey"])


@query(
    "dedup_rows",
    "SELECT DISTINCT concat('a/', o_orderstatus) AS PATH, o_orderpriority FROM orders",
)
def dedup_rows(spark, sf):
    slash = F.when(F.col("o_orderkey") % 2 == 0, "a\\").otherwise("a/")
    return dedup.distinct_rows(table(spark, sf, "orders").select(F.concat(slash, "o_orderstatus").alias("PATH"), "o_orderpriority"))


@query(
    "drop_double_dupes",
    "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
)
def drop_double_dupes(spark, sf):
    return dedup.drop_double_dupes(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", ["doc_id"])


@query(
    "only_duplicates",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
)
def only_duplicates(spark, sf):
    return dedup.only_duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


REVIEW = """
SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, l_shipdate, CASE l_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN NULL WHEN 2 THEN 'odd' ELSE 'pending' END AS STATUS FROM lineitem"""


def review(spark, sf):
    s = F.col("l_suppkey") % 4
    status = F.when(s == 0, "valid").when(s == 2, "odd").when(s == 3, "pending")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey", "l_shipdate", status.alias("STATUS"))


_REVIEWED = """
reviewed AS (SELECT k, l_partkey, l_shipdate, CASE WHEN STATUS = 'valid' THEN 'valid' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'invalid' ELSE 'valid' END AS STATUS FROM r)"""


@query("review_status", f"WITH r AS ({REVIEW}), {_REVIEWED} SELECT * FROM reviewed")
def review_status(spark, sf):
    return dedup.review_status(review(spark, sf), "k")


@query(
    "choose_valid",
    f"WITH r AS ({REVIEW}), d AS (SELECT k, min(l_partkey) AS c FROM r WHERE k % 3 = 0 GROUP BY k) SELECT r.k, l_partkey, l_shipdate, CASE WHEN c IS NULL THEN STATUS WHEN l_partkey = c THEN 'valid' ELSE 'invalid' END AS STATUS FROM r LEFT JOIN d ON r.k = d.k",
)
def choose_valid(spark, sf):
    rows = review(spark, sf)
    decisions = rows.where("k % 3 = 0").groupBy("k").agg(F.min("l_partkey").alias("l_partkey"))
    return dedup.choose_valid(rows, decisions, "k", "l_partkey")


@query(
    "version_duplicates",
    """WITH s AS (SELECT concat('/in/f', cast(l_partkey AS string), '_v', lpad(cast(l_suppkey % 20 AS string), 3, '0'), '.', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_shipdate AS string)) AS SRC,
  l_suppkey % 20 AS v, concat('/out/', cast(l_partkey % 100 AS string), '/f_VERSION.exr') AS DEST FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY DEST ORDER BY v, substr(md5(SRC), 1, 3), SRC) AS r FROM s)
SELECT SRC, DEST, v AS SRC_VERSION, r AS DUPLICATE_NO,
  CASE WHEN r > 1 THEN replace(DEST, 'VERSION', concat('v', lpad(cast(r AS string), greatest(length(cast(r AS string)), 3)::int, '0'))) ELSE DEST END AS VERSIONED_DEST FROM n""",
)
def version_duplicates(spark, sf):
    part = F.col("l_partkey").cast("string")
    src = F.concat(
        F.lit("/in/f"), part, F.lit("_v"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0"), F.lit("."),
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_shipdate").cast("string"),
    )
    dest = F.concat(F.lit("/out/"), (F.col("l_partkey") % 100).cast("string"), F.lit("/f_VERSION.exr"))
    return dedup.version_duplicates(table(spark, sf, "lineitem").select(src.alias("SRC"), dest.alias("DEST")))


@query(
    "newest_row_attributes",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
)
def newest_row_attributes(spark, sf):
    from pathloom.operators.frames import newest_row

    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return newest_row(rows, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query(
    "carry_header_down",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' OR event_id % 37 = 5 THEN concat('h', cast(event_id AS string)) END IGNORE NULLS)
  OVER (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HEADER FROM events""",
)
def carry_header_down(spark, sf):
    lines = table(spark, sf, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("FILE_NAME"), F.col("event_id").alias("LINE_NO"))
    header = F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 37 == 5), F.concat(F.lit("h"), F.col("event_id").cast("string")))
    return dedup.carry_header_down(lines, header, "HEADER", block=1000).select("event_id", "HEADER")


@query("sort_rows", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC")
def sort_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return tables.sort_rows(rows, ["o_custkey", "o_orderdate"], [True, False])


@query("reset_order", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def reset_order(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tables.reset_order(rows, "o_orderkey")


@query("top_one", with_views("dirs") + "SELECT FILE FROM dirs ORDER BY length(FILE) DESC, FILE LIMIT 1")
def top_one(spark, sf):
    from pathloom.catalog.views import dirs

    return tables.top_one(dirs(spark, sf).select("FILE"), [F.length("FILE").desc(), F.col("FILE")])


@query(
    "union_dedup",
    with_views("inv") + """
, u AS (SELECT 0 AS t, FILE, PK, SK FROM inv WHERE OID % 2 = 0 UNION ALL SELECT 1, FILE, PK, SK FROM inv WHERE OID % 3 = 0)
SELECT FILE, cast(PK AS string) AS PK, cast(SK AS string) AS SK FROM (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY t, PK, SK) AS r FROM u) WHERE r = 1""",
)
def union_dedup(spark, sf):
    rows = inv(spark, sf).select("FILE", "PK", "SK", "OID")
    parts = [rows.where(f"OID % {n} = 0").drop("OID") for n in (2, 3)]
    return tables.union_dedup(parts, order_by=["PK", "SK"])


@query(
    "union_tables",
    "SELECT s_suppkey, s_name, NULL::varchar AS c_name FROM supplier UNION ALL SELECT NULL, NULL, c_name FROM customer",
)
def union_tables(spark, sf):
    return tables.union_tables([table(spark, sf, "supplier").select("s_suppkey", "s_name"), table(spark, sf, "customer").select("c_name")])


@query(
    "align_headers",
    "SELECT s_name AS name, cast(s_suppkey AS string) AS id, '' AS segment FROM supplier UNION ALL SELECT c_name, '', c_mktsegment FROM customer",
)
def align_headers(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("id"))
    b = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    left, right = tables.align_headers(a, b)
    return left.unionByName(right)


@query(
    "append_then_dedup",
    "SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
)
def append_then_dedup(spark, sf):
    rows = table(spark, sf, "orders")
    a, b = (rows.where(f"o_orderkey % {n} = 0").select("o_custkey", "o_orderpriority") for n in (2, 3))
    return tables.append_then_dedup(a, b, ["o_orderpriority"])


@query("set_minus", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2")
def set_minus(spark, sf):
    rows = table(spark, sf, "lineitem")
    a, b = (rows.where(f"l_linenumber = {n}").select("l_partkey") for n in (1, 2))
    return tables.set_minus(a, b)


@query(
    "row_edits",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 100 <> 7 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 100 = 3
       UNION ALL SELECT NULL, NULL UNION ALL SELECT NULL, NULL""",
)
def row_edits(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    left = tables.delete_rows(rows, rows.where("o_orderkey % 100 = 7"), "o_orderkey")
    more = tables.duplicate_rows(left, rows.where("o_orderkey % 100 = 3"), "o_orderkey")
    return tables.add_blank_rows(more, 2)

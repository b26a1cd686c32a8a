"""Queries: row filters, deletes and lookups."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import enriched, instances, inv, table, with_views
from pathloom.operators import columns, filters
from pathloom.plans.inventory import delete_rows
from pathloom.session import stored_folder
from pathloom.sources.snapshots import SnapshotTable
from pathloom.functions import nested

HALF = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS note, o_custkey FROM orders"


def half(spark, sf):
    note = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_custkey")


@query("drop_equal", f"WITH h AS ({HALF}) SELECT * FROM h WHERE note IS DISTINCT FROM '5-LOW'")
def drop_equal(spark, sf):
    return filters.drop_equal(half(spark, sf), "note", "5-LOW")


@query(
    "drop_containing_any",
    f"WITH h AS ({HALF}) SELECT * FROM h WHERE note IS NULL OR NOT (contains(note, 'URG') OR contains(note, 'LOW'))",
)
def drop_containing_any(spark, sf):
    return filters.drop_containing_any(half(spark, sf), "note", ["URG", "LOW"])


@query("keep_in", f"WITH h AS ({HALF}) SELECT * FROM h WHERE note IN ('5-LOW', '1-URGENT')")
def keep_in(spark, sf):
    return filters.keep_in(half(spark, sf), "note", ["5-LOW", "1-URGENT"])


@query("keep_in_table", f"WITH h AS ({HALF}) SELECT * FROM h WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def keep_in_table(spark, sf):
    wanted = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return filters.keep_in(half(spark, sf), "o_custkey", wanted)


@query("search_text", f"WITH h AS ({HALF}) SELECT * FROM h WHERE contains(lower(note), 'urgent')")
def search_text(spark, sf):
    return filters.search_text(half(spark, sf), "note", "Urgent")


@query("search_regex", f"WITH h AS ({HALF}) SELECT * FROM h WHERE regexp_matches(lower(note), '^[12]-')")
def search_regex(spark, sf):
    return filters.search_text(half(spark, sf), "note", "^[12]-", regex=True)


@query("keep_truthy", f"WITH h AS ({HALF}) SELECT * FROM h WHERE coalesce(note, '') <> ''")
def keep_truthy(spark, sf):
    return filters.keep_truthy(half(spark, sf), "note")


@query("keep_falsy", f"WITH h AS ({HALF}) SELECT * FROM h WHERE coalesce(note, '') = ''")
def keep_falsy(spark, sf):
    return filters.keep_falsy(half(spark, sf), "note")


ITEMS = """
SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_'),
  CASE p_partkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.txt' WHEN 2 THEN '.tar.gz' ELSE '' END) AS Item,
  CASE WHEN p_partkey % 2 = 0 THEN 'Directory' ELSE 'File' END AS OBJECTTYPE FROM part"""


def items(spark, sf):
    key = F.col("p_partkey")
    ext = F.when(key % 4 == 0, ".csv").when(key % 4 == 1, ".txt").when(key % 4 == 2, ".tar.gz").otherwise("")
    name = F.concat(F.when(key % 3 == 0, "_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), ext)
    kind = F.when(key % 2 == 0, "Directory").otherwise("File")
    return table(spark, sf, "part").select("p_partkey", name.alias("Item"), kind.alias("OBJECTTYPE"))


@query(
    "filter_underscore",
    f"WITH i AS ({ITEMS}) SELECT * FROM i WHERE OBJECTTYPE <> 'Directory' OR NOT starts_with(Item, '_')",
)
def filter_underscore(spark, sf):
    return filters.filter_underscore(items(spark, sf))


@query(
    "filter_extension",
    f"WITH i AS ({ITEMS}) " + r"SELECT *, regexp_replace(Item, '\.[^.]*$', '') AS DISPLAYNAME FROM i WHERE regexp_extract(Item, '\.[^.]*$') IN ('.csv', '.gz')",
)
def filter_extension(spark, sf):
    return filters.filter_extension(items(spark, sf), extensions=[".csv", ".gz"])


@query("drop_state", with_views("instances") + "SELECT InstanceId, State_Name AS State FROM instances WHERE State_Name <> 'terminated'")
def drop_state(spark, sf):
    return filters.drop_state(instances(spark, sf).select("InstanceId", F.col("State.Name").alias("State")))


@query(
    "exclude_patterns",
    with_views("inv") + "SELECT FILE, OID FROM inv WHERE NOT (contains(FILE, '/SH01') AND contains(FILE, '/BUILDING/')) AND NOT ends_with(FILE, '.mov')",
)
def exclude_patterns(spark, sf):
    return filters.exclude_patterns(inv(spark, sf).select("FILE", "OID"), "FILE", ["*/BUILDING/*/SH01*", "*.m[o]v"])


DELETIONS = """
del_files AS (SELECT DISTINCT FILE FROM enriched WHERE OID % 10 = 3),
del_seqs AS (SELECT DISTINCT SEQUENCENAME FROM enriched WHERE OID % 10 = 6 AND SEQUENCENAME <> '')"""


def deletions(rows):
    by_file = rows.where("OID % 10 = 3").select("FILE", F.lit("").alias("SEQUENCENAME"))
    by_seq = rows.where("OID % 10 = 6").select(F.lit(None).cast("string").alias("FILE"), "SEQUENCENAME")
    return by_file.unionByName(by_seq)


@query(
    "delete_by_keys",
    with_views("inv", "enriched") + f", {DELETIONS}" + """
SELECT FILE, SEQUENCENAME, OID, PK, SK FROM enriched
WHERE FILE NOT IN (SELECT FILE FROM del_files) AND SEQUENCENAME NOT IN (SELECT SEQUENCENAME FROM del_seqs)""",
)
def delete_by_keys(spark, sf):
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "OID", "PK", "SK")
    return filters.delete_by_keys(rows, deletions(rows))


@query(
    "delete_by_keys_fallback",
    with_views("inv", "enriched") + f", {DELETIONS}" + """
SELECT FILE, SEQUENCENAME, OID, PK, SK FROM enriched WHERE FILE NOT IN (SELECT FILE FROM del_files)""",
)
def delete_by_keys_fallback(spark, sf):
    """Files match, so sequences delete nothing."""
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "OID", "PK", "SK")
    return filters.delete_by_keys_fallback(rows, deletions(rows))


@query(
    "delete_by_sequence_fallback",
    with_views("inv", "enriched") + f", {DELETIONS}" + """
SELECT FILE, SEQUENCENAME, OID, PK, SK FROM enriched WHERE SEQUENCENAME NOT IN (SELECT SEQUENCENAME FROM del_seqs)""",
)
def delete_by_sequence_fallback(spark, sf):
    """No file matches, so sequences delete."""
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "OID", "PK", "SK")
    moved = deletions(rows).withColumn("FILE", F.concat("FILE", F.lit(".gone")))
    return filters.delete_by_keys_fallback(rows, moved)


@query(
    "delete_and_rewrite",
    with_views("inv", "enriched") + f", {DELETIONS}" + """
SELECT FILE, SEQUENCENAME, OID, PK, SK FROM enriched
WHERE FILE NOT IN (SELECT FILE FROM del_files) AND SEQUENCENAME NOT IN (SELECT SEQUENCENAME FROM del_seqs)""",
)
def delete_and_rewrite(spark, sf):
    """Two arrivals in a table of snapshots, rows deleted by position, files with hits written again."""
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "OID", "PK", "SK")
    held = SnapshotTable(spark, stored_folder(spark, "deletes"))
    held.append(rows.where("OID % 2 = 0"), "2024-01-01")
    held.append(rows.where("OID % 2 = 1"), "2024-01-02")
    delete_rows(held, deletions(held.read()), "2024-01-03", compact=True)
    return held.read()


@query(
    "lookup_first",
    with_views("inv") + "SELECT CLIENT FROM inv WHERE contains(FILE, '/SH007/') ORDER BY FILE, PK LIMIT 1",
)
def lookup_first(spark, sf):
    return filters.lookup_first(inv(spark, sf), "/SH007/", "FILE", "CLIENT", ["FILE", "PK"])


@query(
    "get_sequence",
    with_views("inv", "enriched") + "SELECT FILE, SEQUENCEPOSITION, PK FROM enriched WHERE SEQUENCENAME = (SELECT min(SEQUENCENAME) FROM enriched WHERE SEQUENCENAME <> '')",
)
def get_sequence(spark, sf):
    rows = enriched(spark, sf)
    first = rows.where("SEQUENCENAME <> ''").agg(F.min("SEQUENCENAME").alias("n"))
    return rows.where(F.col("SEQUENCENAME") == first.scalar()).select("FILE", "SEQUENCEPOSITION", "PK")


@query(
    "get_member",
    with_views("inv", "enriched") + "SELECT FILE, PK FROM enriched WHERE SEQUENCEPOSITION = '0003' AND SEQUENCENAME <> ''",
)
def get_member(spark, sf):
    return enriched(spark, sf).where("SEQUENCENAME <> '' AND SEQUENCEPOSITION = '0003'").select("FILE", "PK")


@query(
    "shot_sequences",
    with_views("inv", "enriched") + """
, s AS (SELECT SEQUENCENAME, cast(min(FRAME) AS bigint) AS FIRSTFRAME, cast(max(FRAME) AS bigint) AS LASTFRAME
  FROM enriched WHERE contains(FILE, '/SH007/') AND SEQUENCENAME <> '' GROUP BY 1)
SELECT DISTINCT * FROM s""",
)
def shot_sequences(spark, sf):
    rows = enriched(spark, sf).withColumn("SHOTNAME", F.regexp_extract("FILE", "/(SH[0-9]{3})/", 1))
    frames = rows.where("SEQUENCENAME <> ''").groupBy("SHOTNAME", "SEQUENCENAME").agg(
        F.min("SEQUENCEPOSITION").alias("FIRSTFRAME"), F.max("SEQUENCEPOSITION").alias("LASTFRAME")
    )
    return filters.shot_sequences(frames, "SH007", with_frames=True)


@query(
    "find_file",
    with_views("inv") + r"SELECT FILE, PK FROM inv WHERE starts_with(FILE, '/jobs/BUILDING/') AND regexp_extract(FILE, '[^/]*$') = 'ord100_v002.0001.PNG' OR starts_with(FILE, '/jobs/') AND regexp_extract(FILE, '[^/]*$') = 'ord100_v002.0002.PNG'",
)
def find_file(spark, sf):
    rows = inv(spark, sf).select("FILE", "PK")
    first = filters.find_file(rows, "ord100_v002.0001.PNG", "/jobs/BUILDING")
    return first.unionByName(filters.find_file(rows, "ord100_v002.0002.PNG", "/jobs/"))

"""Queries: frame sequences, their ranges and gaps."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import enriched, inv, spread, table, with_views
from pathloom.functions import ranges
from pathloom.operators import dedup, frames

# islands and gaps of (k, f) rows in plain SQL
_RANGES = """
d AS (SELECT DISTINCT k, f FROM frames),
i AS (SELECT k, f, f - row_number() OVER (PARTITION BY k ORDER BY f) AS g FROM d),
runs AS (SELECT k, min(f) AS a, max(f) AS b FROM i GROUP BY k, g),
linked AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a) AS nx FROM runs),
texts AS (SELECT k, min(a) AS lo, max(b) AS hi, cast(sum(b - a + 1) AS bigint) AS n, cast(coalesce(sum(nx - b - 1), 0) AS bigint) AS missing,
  string_agg(CASE WHEN a = b THEN cast(a AS string) ELSE concat(cast(a AS string), '-', cast(b AS string)) END, ', ' ORDER BY a) AS span,
  coalesce(string_agg(CASE WHEN nx IS NULL THEN NULL WHEN b + 1 = nx - 1 THEN cast(b + 1 AS string) ELSE concat(cast(b + 1 AS string), '-', cast(nx - 1 AS string)) END, ', ' ORDER BY a), '') AS gaps
  FROM linked GROUP BY k)"""

_BY_ORDER = "frames AS (SELECT l_orderkey AS k, l_linenumber::bigint AS f FROM lineitem)"
# many frames in few keys, so that runs cross the borders of blocks
_BY_FLAG = "frames AS (SELECT l_returnflag AS k, l_orderkey * 9 + l_linenumber AS f FROM lineitem)"


def _wide(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 9 + F.col("l_linenumber")).alias("f"))


@query("frame_ranges", f"WITH {_BY_ORDER}, {_RANGES} SELECT k AS l_orderkey, lo AS FIRSTFRAME, hi AS LASTFRAME, n AS FRAMES, missing AS MISSING, span AS FRAMERANGE, gaps AS MISSINGFRAMES FROM texts")
def frame_ranges(spark, sf):
    return frames.frame_ranges(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_linenumber"))


@query("frame_ranges_hot", f"WITH {_BY_FLAG}, {_RANGES} SELECT k AS l_returnflag, lo AS FIRSTFRAME, hi AS LASTFRAME, n AS FRAMES, missing AS MISSING, md5(span) AS FRAMERANGE, md5(gaps) AS MISSINGFRAMES FROM texts")
def frame_ranges_hot(spark, sf):
    """A third of all rows in one sequence."""
    out = frames.frame_ranges(_wide(spark, sf), ["l_returnflag"], F.col("f"))
    return out.withColumns({c: F.md5(c) for c in ("FRAMERANGE", "MISSINGFRAMES")})


@query("sequence_ranges", f"WITH {_BY_FLAG}, {_RANGES} SELECT k AS l_returnflag, a AS FIRSTFRAME, b AS LASTFRAME, nx AS NEXTFRAME FROM linked")
def sequence_ranges(spark, sf):
    return frames.sequence_ranges(_wide(spark, sf), ["l_returnflag"], F.col("f"))


@query("missing_frames", f"WITH {_BY_FLAG}, {_RANGES} SELECT k AS l_returnflag, b + 1 AS FIRSTMISSING, nx - 1 AS LASTMISSING FROM linked WHERE nx IS NOT NULL")
def missing_frames(spark, sf):
    return frames.missing_frames(_wide(spark, sf), ["l_returnflag"], F.col("f"))


@query("missing_count", f"WITH {_BY_ORDER}, {_RANGES} SELECT k AS l_orderkey, missing AS MISSING FROM texts")
def missing_count(spark, sf):
    return frames.missing_count(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_linenumber"))


@query("format_ranges", f"WITH {_BY_ORDER}, {_RANGES} SELECT k AS l_orderkey, span AS FRAMERANGE, gaps AS MISSINGFRAMES FROM texts")
def format_ranges(spark, sf):
    """Array form: the few frames of an order sit in one cell."""
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("bigint"))).alias("f"))
    return cells.select(
        "l_orderkey", ranges.format_ranges(F.col("f")).alias("FRAMERANGE"),
        ranges.format_ranges(ranges.missing_numbers(F.col("f"))).alias("MISSINGFRAMES"),
    )


_PARTS = """
parts AS (SELECT l_orderkey % 300 AS k, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem),
frames AS (SELECT k, unnest(range(a, b + 1)) AS f FROM parts)"""


@query("union_ranges", f"WITH {_PARTS}, {_RANGES} SELECT k, span AS MISSINGFRAMES FROM texts")
def union_ranges(spark, sf):
    first, last = F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber")
    text = F.concat(first.cast("string"), F.lit("-"), (last - 1).cast("string"), F.lit(", "), last.cast("string"))
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 300).alias("k"), text.alias("t"))
    return frames.union_ranges(rows, ["k"], F.col("t"))


@query("parse_ranges", f"WITH {_BY_ORDER}, {_RANGES} SELECT DISTINCT k AS l_orderkey, f AS FRAME FROM frames")
def parse_ranges(spark, sf):
    """Range texts written and read back give the frames again."""
    texts = frames.frame_ranges(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_linenumber"))
    return texts.select("l_orderkey", F.explode(ranges.parse_ranges(F.col("FRAMERANGE"))).alias("FRAME"))


PARTIAL = """
SELECT concat('seq', cast(l_orderkey % 4000 AS string)) AS SEQUENCEFILENAME, CASE WHEN l_orderkey % 2 = 0 THEN '4' ELSE '3' END AS NUMBERPADDING,
  l_shipdate AS CREATION_TIME, concat('t', cast(l_partkey AS string)) AS TARGET, cast(l_linenumber AS int) AS FIRSTFRAME, cast(l_linenumber + 10 AS int) AS LASTFRAME,
  cast(l_suppkey AS bigint) AS TOTALSIZE, concat(cast(l_linenumber AS string), '-', cast(l_linenumber + l_suppkey % 3 AS string)) AS MISSINGFRAMES,
  l_orderkey % 4000 AS k, l_linenumber::bigint AS a, l_linenumber + l_suppkey % 3 AS b FROM lineitem"""


def partial(spark, sf):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("seq"), (key % 4000).cast("string")).alias("SEQUENCEFILENAME"), F.when(key % 2 == 0, "4").otherwise("3").alias("NUMBERPADDING"),
        F.col("l_shipdate").alias("CREATION_TIME"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("TARGET"),
        line.cast("int").alias("FIRSTFRAME"), (line + 10).cast("int").alias("LASTFRAME"), F.col("l_suppkey").cast("bigint").alias("TOTALSIZE"),
        F.concat(line.cast("string"), F.lit("-"), (line + F.col("l_suppkey") % 3).cast("string")).alias("MISSINGFRAMES"),
    )


@query(
    "merge_partial_sequences",
    f"WITH p AS ({PARTIAL}), frames AS (SELECT k, unnest(range(a, b + 1)) AS f FROM p), {_RANGES}" + """,
g AS (SELECT SEQUENCEFILENAME, NUMBERPADDING, k, count(*) AS c, min(MISSINGFRAMES) AS one, min(FIRSTFRAME) AS FIRSTFRAME, max(LASTFRAME) AS LASTFRAME,
  cast(sum(TOTALSIZE) AS bigint) AS TOTALSIZE, min(CREATION_TIME) AS CREATION_TIME FROM p GROUP BY 1, 2, 3),
y AS (SELECT k, TARGET FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CREATION_TIME DESC, TARGET DESC) AS r FROM p) WHERE r = 1)
SELECT SEQUENCEFILENAME, NUMBERPADDING, FIRSTFRAME, LASTFRAME, TOTALSIZE, CREATION_TIME, TARGET, CASE WHEN c = 1 THEN one ELSE span END AS MISSINGFRAMES
FROM g JOIN texts ON g.k = texts.k JOIN y ON g.k = y.k""",
)
def merge_partial_sequences(spark, sf):
    return frames.merge_partial_sequences(partial(spark, sf))


_SUMMARY = """
, frames AS (SELECT SEQUENCENAME AS k, cast(SEQUENCEPOSITION AS bigint) AS f FROM enriched WHERE SEQUENCENAME <> ''),
""" + _RANGES + """,
s AS (SELECT SEQUENCENAME, cast(sum(FILESIZE) AS bigint) AS FILESIZE, max(CREATION_TIME) AS CREATION_TIME, count(*) AS c, min(FILE) AS F1 FROM enriched WHERE SEQUENCENAME <> '' GROUP BY 1),
b AS (SELECT SEQUENCENAME, CLIENT, PADDING, PK FROM (SELECT *, row_number() OVER (PARTITION BY SEQUENCENAME ORDER BY FILE, PK, SK, FILESIZE) AS r FROM enriched WHERE SEQUENCENAME <> '') WHERE r = 1)
"""


@query(
    "summarize_sequences",
    with_views("inv", "enriched") + _SUMMARY + """
SELECT s.SEQUENCENAME AS FILE, s.SEQUENCENAME, FILESIZE, CREATION_TIME, CLIENT, PADDING, PK, span AS SEQUENCEPOSITION, cast(lo AS string) AS FIRSTFRAME, cast(hi AS string) AS LASTFRAME,
  span AS FRAMERANGE, gaps AS MISSINGFRAMES FROM s JOIN texts ON s.SEQUENCENAME = k JOIN b ON b.SEQUENCENAME = s.SEQUENCENAME
UNION ALL SELECT FILE, SEQUENCENAME, FILESIZE, CREATION_TIME, CLIENT, PADDING, PK, SEQUENCEPOSITION, NULL, NULL, NULL, NULL FROM enriched WHERE SEQUENCENAME = ''""",
)
def summarize_sequences(spark, sf):
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "FILESIZE", "CREATION_TIME", "CLIENT", "PADDING", "PK", "SK", "SEQUENCEPOSITION", F.col("FILESIZE").alias("SIZE"))
    return frames.summarize_sequences(rows, ["FILE", "PK", "SK", "SIZE"]).drop("SK", "SIZE")


@query(
    "summarize_sequences_split",
    with_views("inv", "enriched") + _SUMMARY + """
SELECT CASE WHEN c = 1 THEN F1 ELSE s.SEQUENCENAME END AS FILE, s.SEQUENCENAME, FILESIZE, span AS SEQUENCEPOSITION, CASE WHEN c > 1 THEN PADDING END AS PADDING,
  CASE WHEN c > 1 THEN cast(lo AS string) END AS FIRSTFRAME, CASE WHEN c > 1 THEN cast(hi AS string) END AS LASTFRAME,
  CASE WHEN c > 1 THEN span END AS FRAMERANGE, CASE WHEN c > 1 THEN gaps END AS MISSINGFRAMES
FROM s JOIN texts ON s.SEQUENCENAME = k JOIN b ON b.SEQUENCENAME = s.SEQUENCENAME
UNION ALL SELECT FILE, SEQUENCENAME, FILESIZE, SEQUENCEPOSITION, PADDING, NULL, NULL, NULL, NULL FROM enriched WHERE SEQUENCENAME = ''""",
)
def summarize_sequences_split(spark, sf):
    rows = enriched(spark, sf).select("FILE", "SEQUENCENAME", "FILESIZE", "CREATION_TIME", "SEQUENCEPOSITION", "PADDING", "PK", "SK")
    out = frames.summarize_sequences(rows, ["FILE", "PK", "SK"], split_single=True)
    return out.drop("PK", "SK", "CREATION_TIME")


@query(
    "latest_sequence_summary",
    with_views("inv") + r"""
, latest AS (SELECT *, regexp_replace(FILE, '\d+\.[^.]*$', '') AS k, FRAME::bigint AS f FROM
  (SELECT *, row_number() OVER (PARTITION BY FILE ORDER BY ENTRYTIME DESC, PK, SK, FILESIZE) AS r FROM inv) WHERE r = 1),
frames AS (SELECT k, f FROM latest), """ + _RANGES + """
SELECT latest.k AS SEQUENCE, lo AS FIRSTFRAME, hi AS LASTFRAME, n AS FRAMES, missing AS MISSING, span AS FRAMERANGE, gaps AS MISSINGFRAMES, cast(sum(FILESIZE) AS bigint) AS FILESIZE
FROM latest JOIN texts ON latest.k = texts.k GROUP BY ALL""",
)
def latest_sequence_summary(spark, sf):
    """Latest version of each file, then ranges, gaps and size of every sequence."""
    rows = inv(spark, sf).select("FILE", "ENTRYTIME", "FILESIZE", "FRAME", "PK", "SK")
    latest = dedup.first_by_key(rows, ["FILE"], [F.col("ENTRYTIME").desc(), "PK", "SK", "FILESIZE"])
    keyed = latest.withColumn("SEQUENCE", F.regexp_replace("FILE", r"\d+\.[^.]*$", ""))
    texts = frames.frame_ranges(keyed, ["SEQUENCE"], F.col("FRAME"), {"FILESIZE": "FILESIZE"})
    return texts


@query(
    "expand_sequences",
    """WITH r AS (SELECT p_partkey, p_size, unnest(range(p_size)) AS i FROM part)
SELECT concat('/in/a', cast(p_partkey AS string), '.', lpad(cast(100 + i * 2 AS string), 4, '0'), '.exr') AS SRC, concat('/out/', cast(100 + i * 2 AS string), '.exr') AS DEST,
  concat('/t/', lpad(cast(100 + i * 2 AS string), 6, '0'), '/', lpad(cast(100 + i * 2 AS string), 4, '0')) AS TARGET, 'copy' AS ACTIONTYPE, 100 + i * 2 AS FRAME FROM r""",
)
def expand_sequences(spark, sf):
    rows = spread(table(spark, sf, "part"), "p_partkey").select(
        F.concat(F.lit("/in/a"), F.col("p_partkey").cast("string"), F.lit(".%04d.exr")).alias("SRC"), F.lit("/out/%d.exr").alias("DEST"),
        F.lit("/t/%06d/%04d").alias("TARGET"), F.lit("copy").alias("ACTIONTYPE"), F.col("p_size").alias("NUMBEROFFRAMES"),
        F.lit(100).alias("INPUTFIRSTFRAME"), F.lit(2).alias("INCREMENT"),
    )
    return frames.expand_sequences(rows)


@query(
    "expand_ranges",
    """WITH r AS (SELECT p_partkey, p_size, unnest(CASE WHEN p_partkey % 3 = 0 THEN [NULL::bigint] ELSE range(5, 5 + p_size::bigint) END) AS FRAME FROM part)
SELECT CASE WHEN FRAME IS NULL THEN concat('/f', cast(p_partkey AS string), '.mov') ELSE concat('/s', cast(p_partkey AS string), '.', lpad(cast(FRAME AS string), 4, '0'), '.exr') END AS FILE,
  CASE WHEN FRAME IS NULL THEN 'l/x.mov' ELSE concat('l/', lpad(cast(FRAME AS string), 4, '0'), '.exr') END AS PROVISIONEDLINK, FRAME FROM r""",
)
def expand_ranges(spark, sf):
    key = F.col("p_partkey")
    single = key % 3 == 0
    rows = table(spark, sf, "part").select(
        F.when(single, F.concat(F.lit("/f"), key.cast("string"), F.lit(".mov"))).otherwise(F.concat(F.lit("/s"), key.cast("string"), F.lit(".%04d.exr"))).alias("FILE"),
        F.when(single, "l/x.mov").otherwise("l/%04d.exr").alias("PROVISIONEDLINK"), F.when(~single, "4").alias("PADDING"),
        F.when(~single, "5").alias("FIRSTFRAME"), F.when(~single, (F.col("p_size") + 4).cast("string")).alias("LASTFRAME"),
    )
    return frames.expand_ranges(rows).select("FILE", "PROVISIONEDLINK", "FRAME")

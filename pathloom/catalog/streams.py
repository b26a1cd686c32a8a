"""Queries: file streams, run over the events in four arrivals until nothing is left."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import table
from pathloom.session import stored_folder
from pathloom.streaming import streams

ARRIVALS = 4


def arrivals(spark, sf, run, batches=ARRIVALS):
    """Files of the events put in a folder, part by part; ``run(stream, folder)`` after each. Back come schema and folder."""
    folder = stored_folder(spark, "stream")
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    for n in range(batches):
        rows.where(F.col("event_id") % batches == n).write.parquet(f"{folder}/in/part{n}")
        run(streams.read_stream(spark, f"{folder}/in/*", rows.schema), folder).awaitTermination()
    return rows.schema, folder


EVENTS = "SELECT event_id, ts, user_id, event_type, cast(round(value * 100) AS bigint) AS cents FROM events"


@query(
    "stream_latest",
    f"""SELECT event_id, ts, user_id, event_type, cents FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS n FROM ({EVENTS})) WHERE n = 1""",
)
def stream_latest(spark, sf):
    schema, folder = arrivals(spark, sf, lambda df, at: streams.stream_latest(df, f"{at}/checkpoint", "user_id", "ts", ["event_id"]))
    return streams.read_latest_state(spark, f"{folder}/checkpoint", schema.names)


@query(
    "stream_diff",
    f"""WITH e AS (SELECT *, event_id % {ARRIVALS} AS part FROM ({EVENTS})),
best AS (SELECT * FROM (SELECT b, e.*, row_number() OVER (PARTITION BY b, user_id ORDER BY ts DESC NULLS LAST, event_id) AS n
  FROM e JOIN (SELECT unnest(range({ARRIVALS})) AS b) ON part <= b) WHERE n = 1)
SELECT cast(x.b AS bigint) AS batch, x.event_id, x.ts, x.user_id, x.event_type, x.cents, CASE WHEN y.b IS NULL THEN 'added' ELSE 'updated' END AS CHANGE
FROM best x LEFT JOIN best y ON y.b = x.b - 1 AND x.user_id IS NOT DISTINCT FROM y.user_id
WHERE y.b IS NULL OR y.event_id <> x.event_id""",
)
def stream_diff(spark, sf):
    schema, folder = arrivals(spark, sf, lambda df, at: streams.stream_diff(df, f"{at}/changes", f"{at}/checkpoint", "user_id", "ts", ["event_id"]))
    found = spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    return found.select(F.col("batch").cast("bigint").alias("batch"), *schema.names, "CHANGE")


@query("stream_append", EVENTS)
def stream_append(spark, sf):
    schema, folder = arrivals(spark, sf, lambda df, at: streams.stream_append(df, f"{at}/out", f"{at}/checkpoint"), 2)
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query(
    "stream_sums",
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS "WINDOW_START", time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "WINDOW_END",
  event_type, count(*) AS "ROWS", cast(sum(cents) AS bigint) AS "TOTAL" FROM ({EVENTS})
GROUP BY 1, 2, 3 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""",
)
def stream_sums(spark, sf):
    def run(df, at):
        return streams.stream_sums(streams.windowed_sums(df, "ts", "1 day", "0 seconds", ["event_type"], {"TOTAL": F.col("cents")}), f"{at}/out", f"{at}/checkpoint")

    _, folder = arrivals(spark, sf, run, 1)
    return spark.read.parquet(f"{folder}/out").select("WINDOW_START", "WINDOW_END", "event_type", "ROWS", "TOTAL")


STALE_MINUTES = 720


@query(
    "stream_freshness",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {STALE_MINUTES} MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, max(ts) AS "LOADED", max(ts) + INTERVAL {STALE_MINUTES} MINUTE AS "STALE_AT" FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL {STALE_MINUTES} MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)""",
)
def stream_freshness(spark, sf):
    _, folder = arrivals(spark, sf, lambda df, at: streams.stream_freshness(df, f"{at}/out", f"{at}/checkpoint", ["user_id"], "ts", STALE_MINUTES), 1)
    return spark.read.parquet(f"{folder}/out").select("user_id", "LOADED", "STALE_AT")

"""Reading, writing, jobs and streams in temporary folders."""


import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans import inventory
from pathloom.plans.instances import DETAILS
from pathloom.schemas import INIT_SCHEMA
from pathloom.sources import files, logs, sinks, tables
from pathloom.streaming import streams

SCAN = "HASHEDFILE string, FILE string, ENTRYTIME timestamp, PROJECT string, SEQUENCENAME string"


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def scan_rows(spark):
    rows = [("h1", "a", "2024-01-01", "p", "s"), ("h1", "a", "2024-01-02", "p", "s"), ("h2", "b", "2024-01-01", "q", ""), ("h3", "c", "2024-01-03", "q", "t")]
    df = spark.createDataFrame(rows, SCAN.replace("timestamp", "string"))
    return df.withColumn("ENTRYTIME", F.col("ENTRYTIME").cast("timestamp"))


def test_csv_readers(spark, tmp_path):
    put(tmp_path, "in/t.csv", 'id,n\n0007,5\n"a ""q""",x\n')
    df = tables.read_csv_typed(spark, str(tmp_path / "in/t.csv"), {"n": "int"})
    assert sorted(map(str, df.collect())) == sorted(map(str, [T.Row(id="0007", n=5), T.Row(id='a "q"', n=None)]))
    plain = tables.read_template_csv(spark, put(tmp_path, "p.csv", "x,CLIENT/a\n,\n"), header=False, column=1)
    assert [r.PROVISIONEDLINK for r in plain.collect()] == ["CLIENT/a"]
    a, b = put(tmp_path, "a.csv", "Name\nx\n"), put(tmp_path, "b.csv", "Title,OBJECTTYPE\ny,File\n")
    got = {r.Item: (r.OBJECTTYPE, r.Path.split("/")[-1]) for r in tables.read_with_provenance(spark, [a, b]).collect()}
    assert got == {"x": ("Directory", "a.csv"), "y": ("File", "b.csv")}


def test_latest_per_name(spark, tmp_path):
    for name, value in [("req-20240101000000", "old"), ("req-20240102000000", "new"), ("other-20230101000000", "only")]:
        put(tmp_path, f"{name}.csv", f"v\n{value}\n")
    assert {r.v for r in tables.read_latest_per_name(spark, str(tmp_path)).collect()} == {"new", "only"}


def test_text_and_lines(spark, tmp_path):
    path = put(tmp_path, "jobs.txt", "[j1]\nJobStatus=Queued\nA = 1 = 2\n\n[j2]\nJobStatus=Rendering\nJobStatus=Done\n")
    assert tables.read_text(spark, path).count() == 1
    jobs = {r.JobId: r.FIELDS for r in logs.parse_farm_jobs(tables.read_lines(spark, path)).collect()}
    assert jobs == {"j1": {"JobStatus": "Queued", "A": "1 = 2"}, "j2": {"JobStatus": "Done"}}
    tasks = put(tmp_path, "tasks.txt", "TaskId=0\nTaskFrameList=5\nTaskId=1\n\nTaskId=2\nTaskFrameList=6=7\n")
    assert [r.TASK for r in logs.read_task_blocks(spark, tasks).collect()] == [{"TaskId": "1", "TaskFrameList": "5"}, {"TaskId": "2", "TaskFrameList": "6=7"}]
    listing = put(tmp_path, "list.txt", "hello\n\nNAME KIND SNAP\n s1 x 2024T10\ns2 y z\n\ns3 after\n")
    assert [r.NAME for r in logs.parse_listing_table(tables.read_lines(spark, listing)).orderBy("LINE_NO").collect()] == ["s1", "s2"]
    report = put(tmp_path, "r.tsv", "AWS Instance ID\tAWS Availability Zone\ni-0123456789abcdef0\teu-1a\ni-1\teu-1b\n")
    assert [tuple(r) for r in logs.read_tsv_report(spark, report).collect()] == [("i-0123456789abcdef0", "eu-1")]


def test_lines_of_a_split_file_stay_in_order(spark, tmp_path):
    path = put(tmp_path, "big.txt", "".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = tables.read_lines(spark, path).orderBy("LINE_NO").select("LINE").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.LINE for r in lines] == [f"line {i}" for i in range(5000)]


def test_scan_and_status(spark, tmp_path):
    put(tmp_path, "tree/a/x.exr", "12345")
    put(tmp_path, "tree/data/thumbs1/y.png", "1")
    scan = files.scan_files(spark, [str(tmp_path / "tree/a"), str(tmp_path / "tree/data")])
    assert [(r.FILE.split("/")[-1], r.FILESIZE, r.ISLINK) for r in scan.collect()] == [("x.exr", 5, "no")]
    path = str(tmp_path / "tree/a/x.exr")
    known = spark.createDataFrame([(path,), ("/gone",)], "FILE string")
    assert {r.FILE: r.STATUS for r in files.file_status(known, scan).collect()} == {path: "online", "/gone": "offline"}


def test_empty_tables(spark, tmp_path):
    assert tables.read_or_empty(spark, str(tmp_path / "none")).count() == 0
    assert tables.init_table(spark, str(tmp_path / "t"), INIT_SCHEMA).columns == INIT_SCHEMA.names


def test_writers(spark, tmp_path):
    df = scan_rows(spark)
    path = sinks.write_table(df, str(tmp_path / "s"), strict=True, compression="GZIP")
    assert path.endswith(".parquet")
    with pytest.raises(Exception):
        sinks.write_table(df, path, strict=True)
    out = sinks.write_partitioned(df, path, str(tmp_path / "parts"), ["PROJECT"], ["FILE"])
    assert out == [str(tmp_path / "parts/s_PROJECT")] and spark.read.parquet(out[0]).where("PROJECT = 'q'").count() == 2
    target = str(tmp_path / "meta")
    sinks.write_with_metadata(df, target, {"a": "1", "b": "2"})
    sinks.write_with_metadata(df, target, {"b": "3"})
    assert sinks.read_metadata(spark, target) == {"a": "1", "b": "3"} and spark.read.parquet(target).schema[0].metadata["table"]
    sinks.append_table(df, target)
    assert spark.read.parquet(target).count() == 8
    csv = sinks.export_text(df.select("FILE", "PROJECT"), str(tmp_path), "e", naming="timestamped", stamp="20240101")
    assert csv.endswith("e-20240101") and spark.read.csv(csv, header=True).count() == 4
    assert spark.read.text(sinks.export_text(df.select("FILE"), str(tmp_path), "t", "text")).count() == 4
    assert spark.read.parquet(sinks.materialize(df, str(tmp_path), "m")).count() == 4


def test_history(spark, tmp_path):
    base = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, base)
    sinks.write_with_history(scan_rows(spark), base, "20240101")
    sinks.write_with_history(scan_rows(spark).limit(1), base, "20240102")
    assert sinks.read_latest(spark, base).count() == 1
    with pytest.raises(Exception):
        sinks.write_with_history(scan_rows(spark), base, "20240102")
    (tmp_path / "h" / "snapshot=20240103").mkdir()  # an unfinished write is not the latest
    assert sinks.snapshots(spark, base) == ["20240101", "20240102"]


def test_jobs_that_write(spark, tmp_path):
    source = str(tmp_path / "src.parquet")
    scan_rows(spark).write.parquet(source)
    inventory.dedup_and_write(spark, source, str(tmp_path / "main.parquet"), str(tmp_path), ["PROJECT"])
    assert spark.read.parquet(str(tmp_path / "main.parquet")).count() == 3
    gone = spark.createDataFrame([("b", "t")], "FILE string, SEQUENCENAME string")
    out = inventory.delete_and_rewrite(spark, source, gone, str(tmp_path / "kept.parquet"), str(tmp_path), ["PROJECT"])
    assert spark.read.parquet(out[0]).count() == 2
    with pytest.raises(ValueError):
        inventory.delete_and_rewrite(spark, source, gone, source, str(tmp_path), [])
    put(tmp_path, "scan/a.0001.exr", "x")
    path = inventory.scan_to_snapshot(spark, [str(tmp_path / "scan")], str(tmp_path / "snaps"), "20240101")
    assert {"HASHEDFILE", "SCANID"} <= set(spark.read.parquet(path).columns)


def test_details_fall_back(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert df.select(*[c.alias(n) for n, c in DETAILS["region"](df).items()]).first().Region == ""


def day(spark, folder, name, rows):
    scan = spark.createDataFrame(rows, "HASHEDFILE string, ENTRYTIME string, v int").withColumn("ENTRYTIME", F.col("ENTRYTIME").cast("timestamp"))
    scan.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


STREAM = T.StructType([T.StructField("HASHEDFILE", T.StringType()), T.StructField("ENTRYTIME", T.TimestampType()), T.StructField("v", T.IntegerType())])


def test_streams(spark, tmp_path):
    src, chg, ck = (str(tmp_path / n) for n in ("in", "changes", "ck"))
    read = lambda: streams.read_stream(spark, src + "/*", STREAM)
    diff = lambda: streams.stream_diff(read(), chg, ck, "HASHEDFILE", "ENTRYTIME", ["v"]).awaitTermination()
    latest = lambda place: {r.HASHEDFILE: r.v for r in streams.read_latest_state(spark, place, STREAM.names).collect()}
    of_batch = lambda n: {(r.HASHEDFILE, r.v, r.CHANGE) for r in spark.read.option("basePath", chg).parquet(chg).where(f"batch = {n}").collect()}
    day(spark, src, "d1", [("a", "2024-01-01", 1), ("a", "2024-01-01", 1), ("b", "2024-01-01", 2), (None, "2024-01-01", 8)])
    diff()
    day(spark, src, "d2", [("b", "2024-01-02", 3), ("c", "2024-01-02", 4), ("c", "2024-01-02", 7), ("a", "2023-01-01", 9), (None, None, 1)])
    diff()
    day(spark, src, "d3", [("b", "2024-01-02", 3), ("a", "2024-01-01", 0)])
    diff()
    assert latest(ck) == {"a": 0, "b": 3, "c": 4, None: 8}
    assert of_batch(0) == {("a", 1, "added"), ("b", 2, "added"), (None, 8, "added")}
    assert of_batch(1) == {("b", 3, "updated"), ("c", 4, "added")}
    # an equal row is no change, an earlier tie is one
    assert of_batch(2) == {("a", 0, "updated")}

    ck2 = str(tmp_path / "ck2")
    streams.stream_latest(read(), ck2, "HASHEDFILE", "ENTRYTIME", ["v"]).awaitTermination()
    assert latest(ck2) == {"a": 0, "b": 3, "c": 4, None: 8}
    with pytest.raises(TypeError):
        streams.stream_latest(read(), str(tmp_path / "ck5"), "ENTRYTIME", "HASHEDFILE")

    plain, ck3 = str(tmp_path / "plain"), str(tmp_path / "ck3")
    streams.stream_append(read(), plain, ck3).awaitTermination()
    streams.stream_append(read(), plain, ck3).awaitTermination()  # nothing new
    assert spark.read.parquet(plain).count() == 11

    once, ck4 = str(tmp_path / "once"), str(tmp_path / "ck4")
    streams.stream_append(streams.drop_repeats(read(), ["HASHEDFILE", "v"], "ENTRYTIME", "400 days"), once, ck4).awaitTermination()
    assert spark.read.parquet(once).count() == 9


def test_a_small_batch_writes_little_state(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    held = lambda: sum(p.stat().st_size for p in (tmp_path / "ck" / "state").rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("HASHEDFILE"), F.lit("2024-01-01").cast("timestamp").alias("ENTRYTIME"), F.col("id").cast("int").alias("v"))
    sizes = []
    for n, part in enumerate((rows, rows.where("v % 100 = 0").withColumn("v", F.col("v") + 1))):
        part.withColumn("ENTRYTIME", F.col("ENTRYTIME") + F.expr(f"make_interval(0, 0, 0, {n})")).write.parquet(f"{src}/d{n}")
        streams.stream_latest(streams.read_stream(spark, src + "/*", STREAM), ck, "HASHEDFILE", "ENTRYTIME").awaitTermination()
        sizes.append(held())
    assert sizes[1] - sizes[0] < 0.05 * sizes[0]
    assert streams.read_latest_state(spark, ck, STREAM.names).agg(F.sum("v")).first()[0] == sum(range(50_000)) + 500


def test_stream_sums(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "sums", "ck"))
    day(spark, src, "d1", [("a", "2024-01-01 00:01:00", 1), ("a", "2024-01-01 00:02:00", 2), ("a", "2024-01-01 00:11:00", 5)])
    sums = streams.windowed_sums(streams.read_stream(spark, src + "/*", STREAM), "ENTRYTIME", "10 minutes", "0 seconds", ["HASHEDFILE"], {"TOTAL": F.col("v")})
    streams.stream_sums(sums, out, ck).awaitTermination()
    assert [(r.ROWS, r.TOTAL) for r in spark.read.parquet(out).collect()] == [(2, 3)]


def test_freshness(spark):
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    df = spark.createDataFrame([("a", "2024-01-01 09:58:00"), ("a", "2024-01-01 08:00:00"), ("b", "2024-01-01 09:00:00")], "k string, LOADED string")
    stale = streams.stale_keys(df.withColumn("LOADED", F.col("LOADED").cast("timestamp")), ["k"], now)
    assert [r.k for r in stale.collect()] == ["b"]


def test_refresh_links_and_roots(spark, tmp_path):
    shots = spark.createDataFrame([("SH01",)], "SHOTNAME string")
    rows = [("/p/IN/d/who/SH01.mov", "file", "/x/OUT/d/them/a"), ("/p/IN/d/no/b.mov", "no", "")]
    links = spark.createDataFrame(rows, "FILE string, ISLINK string, TARGET string")
    none = spark.createDataFrame([], "FILE string")
    got = inventory.refresh_links(none, links.unionAll(links), "c", "p", shots, ["WHOTO"])
    assert got.columns[0] == "WHOTO" and [(r.WHOTO, r.WHOFROM, r.SHOTNAME) for r in got.collect()] == [("who", "them", "SH01")]
    for n in (1, 2, 4):
        put(tmp_path, f"proj/SH01/a_v02.{n:04d}.exr", "x" * n)
    put(tmp_path, "proj/SH01/Thumbs.db", "x")
    now = F.lit("2024-01-01").cast("timestamp")
    out = inventory.inventory_of_roots(spark, [str(tmp_path / "proj")], "c", "proj", shots, now).collect()
    assert [(r.FRAMERANGE, r.MISSINGFRAMES, r.FILESIZE, r.SHOTNAME, r.ITEMVERSION) for r in out] == [("1-2, 4", "3", "7.0 B", "SH01", "v02")]


def test_choices_in_order(spark):
    from pathloom.operators.aggregates import collapse_choices

    df = spark.createDataFrame([("abc", "xabcx", None), ("abc", "qqq", None), ("abc", "abd", None)], "k string, v string, STATUS string")
    assert collapse_choices(df, "k", "v").first().v.startswith("abd")


def test_checkpoint(spark):
    from pathloom.session import cut_lineage, store

    stored = store(spark.range(3).selectExpr("id", "null as n", "array(id) as a"))
    assert stored.count() == 3 and stored.columns == ["id", "n", "a"]
    df = cut_lineage(spark.range(3))
    assert df.count() == 3 and spark.sparkContext.getCheckpointDir() is not None

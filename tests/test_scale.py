"""Steps that move rows once, or compute a text once, whatever the size; each beside a plain reference."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pathloom import session
from pathloom.catalog import views
from pathloom.functions import names, nested, paths
from pathloom.operators import columns, dedup, filters, frames, matching, templates
from pathloom.plans import inventory
from pathloom.sources import sinks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_inventory_moves_line_items_once(spark, tmp_path):
    tables = {
        "lineitem": "l_orderkey long, l_linenumber int, l_extendedprice double, l_shipdate date, l_returnflag string, l_partkey long, l_suppkey long",
        "orders": "o_orderkey long, o_custkey long", "customer": "c_custkey long, c_nationkey long, c_mktsegment string",
        "nation": "n_nationkey long, n_name string",
    }
    for name, columns_ in tables.items():
        spark.createDataFrame([], columns_).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = views.inv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (l_orderkey") < plan.index("Join Inner, (o_custkey")


def test_frames_are_filled_from_holders_found_before(spark):
    rows = spark.createDataFrame(
        [("/a.%04d", "%d_%03d_%05d", None, "copy", 2, 9, 5)],
        "SRC string, DEST string, TARGET string, ACTIONTYPE string, NUMBEROFFRAMES int, INPUTFIRSTFRAME int, INCREMENT int",
    )
    out = frames.expand_sequences(rows)
    assert sorted(map(tuple, out.collect())) == [("/a.0009", "9_009_00009", None, "copy", 9), ("/a.0014", "14_014_00014", None, "copy", 14)]
    above = _plan(out).split("Generate")[0]
    assert "regexp_extract_all" not in above


def _text(runs):
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in runs)


def test_range_texts_over_blocks_in_two_shuffles(spark):
    pick = random.Random(3)
    held = {"a": {*range(4000, 13000)}, "b": {1, 2, 4095, 4096, 4097, 9000, 50000}, None: {5}, "c": set(pick.sample(range(30000), 9000))}
    rows = spark.createDataFrame([(k, f) for k, v in held.items() for f in v] + [("b", 1)], "k string, f long")
    out = frames.frame_ranges(rows, ["k"], F.col("f"))
    for r in out.collect():
        have = sorted(held[r["k"]])
        runs = []
        for f in have:
            if runs and runs[-1][1] == f - 1:
                runs[-1][1] = f
            else:
                runs.append([f, f])
        gaps = [(x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
        assert (r["FIRSTFRAME"], r["LASTFRAME"], r["FRAMES"], r["MISSING"]) == (have[0], have[-1], len(have), sum(b - a + 1 for a, b in gaps))
        assert (r["FRAMERANGE"], r["MISSINGFRAMES"]) == (_text(runs), _text(gaps))
    assert "Window" not in _plan(out) and "Join" not in _plan(out)


def test_digests_are_shuffled_as_bytes(spark):
    keys = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", None, "é", "x" * 33, "\x01" + "a" * 32]
    rows = spark.createDataFrame([(k, t, n) for n, k in enumerate(keys) for t in (1, 2, 2)], "HASHEDFILE string, ENTRYTIME int, n int")
    out = dedup.keep_latest_ties(rows)
    assert out.columns == rows.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, rows.where("ENTRYTIME = 2").collect()))
    assert "unhex" in _plan(out)


def test_few_mapped_values_move_no_row(spark, monkeypatch):
    rows = spark.createDataFrame([("a/VAR_x.VAR", 1), ("$A", 2), (None, 3), ("NONE/", 4), ("", 5)], "t string, n int")
    known = spark.createDataFrame([("VAR", "remap", "v"), ("VAR", "remap", "w"), ("NONE", "remap", None), (None, "remap", "q")], "Variable string, Action string, Value string")
    before = session.stored_folders(spark)
    out = templates.resolve_variables(rows, "t", known)
    assert session.stored_folders(spark) == before
    monkeypatch.setattr(templates, "FEW_VALUES", -1)
    joined = templates.resolve_variables(rows, "t", known)
    assert sorted(out.collect(), key=lambda r: r["n"]) == sorted(joined.collect(), key=lambda r: r["n"])
    assert session.stored_folders(spark) != before


def _normal(text):
    rooted, done = text.startswith("/"), []
    for p in text.split("/"):
        if p in ("", "."):
            continue
        if p != "..":
            done.append(p)
        elif done and done[-1] != "..":
            done.pop()
        elif not rooted:
            done.append(p)
    return "/" + "/".join(done) if rooted else "/".join(done) or "."


def test_normal_paths(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice(["/", "/", "..", ".", "a", "b.", "..c", "\n"]) for _ in range(pick.randrange(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", paths.normalize_path(F.col("t")).alias("n"))
    messy = re.compile(r"(^|/)\.{1,2}(/|$)|//|(?s:.)/\Z")
    assert [(t, n) for t, n in rows.collect() if n != (_normal(t) if messy.search(t) else t)] == []


def test_sequence_of_a_path_computed_once(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice(["a", "_", ".", "01", "7", "/", "exr", "\n", "é", ".EXR", ".0001.exr"]) for _ in range(pick.randrange(9))) for _ in range(1500)]
    rows = columns.with_sequence(spark.createDataFrame([(t,) for t in texts] + [(None,)], "FILE string"))
    for r in rows.collect():
        m = re.match(r"^([^\n]*[._])([0-9]{2,})(\.[^.]*)$", r["FILE"] or "")
        hit = m is not None and m[3].lower() in {e.lower() for e in names.IMAGE_EXTENSIONS}
        wanted = (f"{m[1]}%0{len(m[2])}d{m[3].lower()}", m[2], str(len(m[2]))) if hit else ("", "", "")
        assert (r["SEQUENCENAME"], r["SEQUENCEPOSITION"], r["PADDING"]) == wanted
    kept = rows.where("SEQUENCENAME <> ''")
    assert "regexp_replace" not in _plan(kept)


@pytest.mark.parametrize("cell, kind", [("{}", "dict"), ("[1]", "list"), ('"{"', "str"), ('"1"', "str"), ("true", "bool"), ("null", "NoneType"), ("7", "int"), ("7.5", "float"), ("x", "float")])
def test_node_types(spark, cell, kind):
    row = spark.createDataFrame([(cell,)], "j string").select(F.inline(nested.json_nodes(F.col("j"), 0))).first()
    assert (row["path"], row["data_type"]) == ("(root)", kind)


def test_texts_are_joined_by_hash_and_text(spark):
    rows = spark.createDataFrame([("/a/S01", 1), ("/a/S01", 2), ("", 3), (None, 4)], "FILE string, n int")
    terms = spark.createDataFrame([("S0",), ("S01",), ("",)], "name string")
    best = matching.best_match(rows, ["FILE"], terms, "name", ["name"], ["name"])
    out = matching.with_best(rows, best, ["FILE"]).select("n", "__best.name")
    assert sorted(map(tuple, out.collect())) == [(1, "S01"), (2, "S01"), (3, None), (4, None)]
    assert "xxhash64" in _plan(best)


@pytest.mark.parametrize("order", [("FILE",), ("HASHEDFILE",)])
def test_inventory_digests_are_made_of_the_rows_left(spark, order):
    files = ["/jobs/p/SH01/a.0001.exr", "/jobs/p/SH01/a.0002.exr", "\\jobs\\p\\SH02\\b.mov", "/jobs/q/SH01/ c.mov ", "/jobs/q/x.tmp", "", None]
    scan = spark.createDataFrame([(f, 5, "no") for f in files], "FILE string, FILESIZE long, ISLINK string").withColumns(
        {c: F.lit("2024-01-01").cast("timestamp") for c in ("CREATION_TIME", "MODIFICATION_TIME")}
    )
    shots = spark.createDataFrame([("SH01",), ("SH02",), ("p\\SH02",)], "SHOTNAME string")
    before = session.stored_folders(spark)
    out = inventory.build_inventory(scan, "c", "p", shots, F.lit("2024-01-02").cast("timestamp"), order)

    def digest(t):
        return hashlib.sha256(t.strip().encode()).hexdigest()

    first = min(files[:2], key=digest) if order == ("HASHEDFILE",) else files[0]
    assert sorted((r.FILE, r.SHOTNAME, r.HASHEDFILE) for r in out.collect()) == sorted([
        ("/jobs/p/SH01/a.%04d.exr", "SH01", digest(first)), ("/jobs/p/SH02/b.mov", "p/SH02", digest(files[2])),
        ("/jobs/q/SH01/ c.mov ", "", digest(files[3])), ("", "", digest("")), ("", "", "noHash"),
    ])
    assert out.columns.index("HASHEDFILE") == out.columns.index("DOTEXTENSION") + 1
    (stored,) = set(session.stored_folders(spark)) - set(before)
    kept = {r.HASHEDFILE for r in spark.read.parquet(stored).collect()}
    assert kept == {""} if order == ("FILE",) else "noHash" in kept


def _latest_ties(rows):
    newest = {}
    for k, t, *_ in rows:
        if t is not None:
            newest[k] = max(t, newest.get(k, t))
    return [r for r in rows if r[1] is not None and r[1] == newest[r[0]]]


KEYS = ["ab" * 32, "0b" * 32, "AB" * 32, "ab" * 32 + "\n", "Z", "", "noHash", None]


@pytest.mark.parametrize("hot", [False, True])
def test_latest_ties_move_rows_once_unless_a_key_is_hot(spark, monkeypatch, hot):
    pick = random.Random(11)
    rows = [(pick.choice(KEYS), pick.choice([None, 1, 2, 3]), n) for n in range(400)]
    df = spark.createDataFrame(rows, "HASHEDFILE string, ENTRYTIME int, n int").repartition(5, "n")
    if hot:
        monkeypatch.setattr(dedup, "HOT_ROWS", 0)
        monkeypatch.setattr(dedup, "HOT_TASKS", 0)
    out = dedup.keep_latest_ties(df)
    plan = _plan(out)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, _latest_ties(rows)))
    assert out.columns == df.columns
    assert ("Join" in plan) == hot
    assert hot or plan.count("Exchange hashpartitioning(HASHEDFILE") == plan.count("Exchange hashpartitioning") - 1 == 1
    assert dedup.keep_latest_ties(df.limit(0)).collect() == []


def test_keys_are_hot_by_their_share_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 100)
    rows = spark.range(4000)
    even = rows.select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert dedup._key_facts(even, "k") == (False, True)
    assert dedup._key_facts(even.withColumn("k", F.when(F.rand(1) < 0.01, F.col("k"))), "k") == (False, True)  # as many tasks as 4
    monkeypatch.setattr(dedup, "HOT_TASKS", 2)
    assert dedup._key_facts(even.withColumn("k", F.when(F.rand(1) < 0.01, F.col("k"))), "k") == (True, True)
    assert dedup._key_facts(rows.select((F.col("id") % 7).alias("k")), "k") == (False, False)


@pytest.mark.parametrize("keys", [KEYS, [*KEYS[:2], "5" * 64, None]])
def test_one_row_per_file_of_packed_keys(spark, keys):
    pick = random.Random(13)
    rows = [(pick.choice(keys), pick.choice([None, 1, 2]), pick.choice(["a", "b", "", None, *"cdefgh"]), n) for n in range(120)]
    df = spark.createDataFrame(rows, "HASHEDFILE string, ENTRYTIME int, FILE string, n int")
    first = {}
    for r in sorted(_latest_ties(rows), key=lambda r: (-r[1], r[0] is not None, r[0] or "", r[3])):
        first.setdefault(r[2], r)
    out = dedup.keep_latest_then_distinct(df, ties=["n"])
    plan = _plan(out)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, first.values()))
    assert plan.count("Exchange hashpartitioning") == 2
    assert ("hex(" in plan.split("WindowGroupLimit")[0]) == (keys is not KEYS)  # unpacked after the second shuffle


def test_compacting_moves_packed_rows_twice(spark):
    rows = [("a", "1" * 64, 1, "p", 5), ("a", "1" * 64, 2, "p", 6), ("a", "2" * 64, 2, "p", 7), ("b", "2" * 64, 1, "q", 8), ("c", None, 1, "q", 9)]
    df = spark.createDataFrame(rows, "FILE string, HASHEDFILE string, ENTRYTIME int, PROJECT string, FILESIZE long")
    files = inventory.compact_inventory(df, True, ["FILESIZE"])
    out = files.groupBy("PROJECT").agg(F.sum("FILESIZE").alias("FILESIZE"))
    plan = _plan(out)
    assert sorted(map(tuple, out.collect())) == [("p", 6), ("q", 9)]
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    assert plan.count("unhex") == 1 and "hex(" not in plan.split("WindowGroupLimit")[0]
    assert "unhex" in plan.split("Exchange")[-1]


def test_digests_are_rebalanced_as_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(k, n % 3, n) for n, k in enumerate(KEYS * 3)], "HASHEDFILE string, PART int, n int")
    plan = sinks._rebalanced(rows, "PART")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions")
    assert "unhex" in below and "unhex" not in above
    (by_part,) = sinks.write_partitioned(rows, "k.parquet", str(tmp_path), ["PART"], ["HASHEDFILE"])
    back = spark.read.parquet(by_part).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    by_key = sinks._rebalanced(rows, "HASHEDFILE")._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" not in by_key


def test_blank_keys_are_dealt_out_by_a_number(spark):
    rows = spark.createDataFrame([("a", "s", 1), ("b", "", 2), ("", "s", 3), (None, None, 4), ("", "t", 5), ("c", "!0", 6)], "FILE string, SEQUENCENAME string, n int")
    gone = spark.createDataFrame([("a", None), ("", ""), (None, "t"), (None, None)], "FILE string, SEQUENCENAME string")
    out = filters.delete_by_keys(rows, gone)
    assert "concat" not in _plan(out)
    assert sorted(r.n for r in out.collect()) == [2, 3, 4, 6] and out.columns == rows.columns
    numbers = filters.delete_by_keys(rows.withColumn("FILE", F.col("n")), gone.select(F.lit("02").alias("FILE"), F.lit("s").alias("SEQUENCENAME")))
    assert sorted(r.n for r in numbers.collect()) == [2, 4, 5, 6]

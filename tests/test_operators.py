"""Operators on small tables: ties, nulls, hot groups and block borders."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import aggregates, columns, dedup, filters, frames, grouping, joins, tables, templates, trees

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def runs(numbers):
    out, numbers = [], sorted(set(numbers))
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def gaps(numbers):
    full = set(range(min(numbers), max(numbers) + 1))
    return runs(full - set(numbers)) if full - set(numbers) else ""


@QUIET
@given(st.dictionaries(st.sampled_from("abc"), st.lists(st.integers(0, 60), min_size=1, max_size=40), min_size=1))
def test_frame_ranges_against_brute_force(spark, groups):
    old, frames.BLOCK = frames.BLOCK, 8  # many block borders
    try:
        rows = [(k, f) for k, fs in groups.items() for f in fs]
        df = spark.createDataFrame(rows, "k string, f int").repartition(3)
        got = {r.k: (r.FRAMERANGE, r.MISSINGFRAMES, r.FRAMES, r.MISSING) for r in frames.frame_ranges(df, ["k"], F.col("f")).collect()}
    finally:
        frames.BLOCK = old
    for k, fs in groups.items():
        assert got[k] == (runs(fs), gaps(fs), len(set(fs)), max(fs) - min(fs) + 1 - len(set(fs)))


@QUIET
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), min_size=1, max_size=12))
def test_union_ranges_against_brute_force(spark, spans):
    old, frames.BLOCK = frames.BLOCK, 8
    try:
        df = spark.createDataFrame([("k", f"{a}-{a + n}") for a, n in spans] + [("k", ""), ("empty", "")], "k string, t string")
        got = dict(map(tuple, frames.union_ranges(df, ["k"], F.col("t")).collect()))
    finally:
        frames.BLOCK = old
    assert got == {"k": runs(x for a, n in spans for x in range(a, a + n + 1)), "empty": ""}


@QUIET
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5), st.integers(0, 99)), min_size=1, max_size=40))
def test_number_rows_against_brute_force(spark, rows):
    df = spark.createDataFrame([(k, c, v, i) for i, (k, c, v) in enumerate(rows)], "k string, c int, v int, i int").repartition(3)
    got = {r.i: r.ROW_NO for r in grouping.number_rows(df, ["k"], [F.col("c")], [F.col("v"), F.col("i")]).collect()}
    for k in "ab":
        mine = sorted((c, v, i) for i, (kk, c, v) in enumerate(rows) if kk == k)
        assert [got[i] for _, _, i in mine] == list(range(1, len(mine) + 1))


def test_number_rows_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = sorted((r.v, r.ROW_NO) for r in grouping.number_rows(df, ["k"], [F.col("v") % 2], [F.col("v")]).collect())
    assert got == [(1, 2), (2, 1), (3, 1)]


def test_chunked_lists_hold_everything(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"), F.col("id").cast("string").alias("v"))
    lists = grouping.chunked_lists(df, ["k"], F.col("v"), "L", [grouping.spread(F.col("v"))], [F.col("v")], 100).collect()
    assert max(len(r.L) for r in lists) == 100
    assert sorted(v for r in lists for v in r.L) == sorted(map(str, range(1000)))
    assert {r.CHUNK for r in lists if r.k == "hot"} == set(range(9))


def test_summary_of_sequences(spark):
    rows = [
        ("/a.0001.exr", "/a.%04d.exr", "0001", 10, "2024-01-01"), ("/a.0003.exr", "/a.%04d.exr", "0003", 5, "2024-01-03"),
        ("/a.0003.exr", "/a.%04d.exr", "0003", 1, "2024-01-02"), ("/b.0009.exr", "/b.%04d.exr", "0009", 7, None), ("/c.mov", "", "", 2, None), ("/d", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "FILE string, SEQUENCENAME string, SEQUENCEPOSITION string, FILESIZE bigint, CREATION_TIME string")
    got = {r.FILE: r for r in frames.summarize_sequences(df).collect()}
    a = got["/a.%04d.exr"]
    assert (a.FILESIZE, a.CREATION_TIME, a.FIRSTFRAME, a.LASTFRAME, a.FRAMERANGE, a.MISSINGFRAMES) == (16, "2024-01-03", "1", "3", "1, 3", "2")
    assert set(got) == {"/a.%04d.exr", "/b.%04d.exr", "/c.mov", "/d"} and got["/c.mov"].FRAMERANGE is None
    split = {r.FILE: r for r in frames.summarize_sequences(df, split_single=True).collect()}
    assert split["/b.0009.exr"].FIRSTFRAME is None and "/a.%04d.exr" in split


def test_summary_counts_listed_positions_once(spark):
    df = spark.createDataFrame([("/a", "s", "1,2,5", 10, None), ("/b", "s", "x", 1, None)], "FILE string, SEQUENCENAME string, SEQUENCEPOSITION string, FILESIZE bigint, CREATION_TIME string")
    row = frames.summarize_sequences(df).first()
    assert (row.FILESIZE, row.FRAMERANGE, row.MISSINGFRAMES) == (11, "1-2, 5", "3-4")


def test_summary_does_not_depend_on_partitions(spark):
    rows = [(f"/a{i % 3}.{i:04d}.exr", f"/a{i % 3}.%04d.exr", f"{i:04d}", i, None) for i in range(0, 300, 7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "FILE string, SEQUENCENAME string, SEQUENCEPOSITION string, FILESIZE bigint, CREATION_TIME string")
    first, second = (sorted(map(tuple, frames.summarize_sequences(df.repartition(n)).collect())) for n in (1, 7))
    assert first == second


def test_expand_then_summarize_gives_the_sequence_back(spark):
    df = spark.createDataFrame([("/s.%04d.exr", "l/s.%04d.exr", "4", "3", "6"), ("/m.mov", "l/m.mov", None, None, None)], "FILE string, PROVISIONEDLINK string, PADDING string, FIRSTFRAME string, LASTFRAME string")
    out = frames.expand_ranges(df)
    assert {r.FILE for r in out.collect()} == {"/s.0003.exr", "/s.0004.exr", "/s.0005.exr", "/s.0006.exr", "/m.mov"}
    again = frames.frame_ranges(out.where("FRAME is not null"), ["PADDING"], F.col("FRAME")).first()
    assert again.FRAMERANGE == "3-6"


def test_latest_rows_and_ties(spark):
    rows = [("h", 2, "a"), ("h", 2, "b"), ("h", 1, "c"), ("g", None, "d"), (None, 5, "e"), (None, 4, "f")]
    df = spark.createDataFrame(rows, "HASHEDFILE string, ENTRYTIME int, FILE string")
    assert {r.FILE for r in dedup.keep_latest_ties(df).collect()} == {"a", "b", "e"}
    assert {r.FILE for r in dedup.keep_latest_two_stage(df, ties=["FILE"]).collect()} == {"a", "d", "e"}


def test_first_by_key_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as v")
    plan = dedup.first_by_key(df, ["k"], ["v"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_review(spark):
    # the sample rows of the review table
    rows = list(zip(["Alice", "Bob", "Alice", "Charlie", "Bob", "Eve", "Alice"], [90, 20, 10, 30, 60, 40, 78], [None] * 7))
    df = spark.createDataFrame(rows, "Name string, Prize int, STATUS string")
    state = {(r.Name, r.Prize): r.STATUS for r in dedup.review_status(df, "Name").collect()}
    assert state[("Charlie", 30)] == "valid" and state[("Bob", 20)] == "invalid"
    chosen = dedup.choose_valid(dedup.review_status(df, "Name"), spark.createDataFrame([("Bob", 60)], "Name string, Prize int"), "Name", "Prize")
    state = {(r.Name, r.Prize): r.STATUS for r in chosen.collect()}
    assert state[("Bob", 60)] == "valid" and state[("Bob", 20)] == "invalid" and state[("Eve", 40)] == "valid"
    texts = {r.Name: r.Prize for r in aggregates.collapse_choices(chosen, "Name", "Prize").collect()}
    assert texts["Bob"] == "60, 20" and sorted(texts["Alice"].split(", ")) == ["10", "78", "90"]


def test_carry_header_over_blocks(spark):
    rows = [("f", i, "[h1]" if i == 3 else "[h2]" if i == 55 else "x") for i in range(100)] + [("g", 4, "x")]
    df = spark.createDataFrame(rows, "FILE_NAME string, LINE_NO bigint, LINE string")
    header = F.when(F.col("LINE").startswith("["), F.col("LINE"))
    got = {(r.FILE_NAME, r.LINE_NO): r.H for r in dedup.carry_header_down(df, header, "H", block=10).collect()}
    assert got[("f", 2)] is None and got[("f", 54)] == "[h1]" and got[("f", 99)] == "[h2]" and got[("g", 4)] is None


def test_deletes_keep_nulls_and_blanks(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), (None, "s"), ("c", "t"), ("d", "t")], "FILE string, SEQUENCENAME string")
    gone = spark.createDataFrame([("a", "t"), (None, ""), ("", None)], "FILE string, SEQUENCENAME string")
    assert {tuple(r) for r in filters.delete_by_keys(df, gone).collect()} == {("b", None), (None, "s")}
    assert {tuple(r) for r in filters.delete_by_keys_fallback(df, gone).collect()} == {("b", None), (None, "s"), ("c", "t"), ("d", "t")}
    other = spark.createDataFrame([("zz", "t")], "FILE string, SEQUENCENAME string")
    assert filters.delete_by_keys_fallback(df, other).count() == 3


def test_filters_raise(spark):
    df = spark.createDataFrame([("a",)], "Item string")
    with pytest.raises(ValueError):
        filters.drop_equal(df, "missing", 1)
    with pytest.raises(ValueError):
        filters.filter_underscore(df)
    with pytest.raises(ValueError):
        filters.get_member(df.selectExpr("Item as SEQUENCENAME", "'1' as SEQUENCEPOSITION"), "a", "2")


def test_shots(spark):
    files = ["/p/SH01/SH02/x", "/p/SH1/y", "/p/none", "/q/SH02"]
    df = spark.createDataFrame([(f, "p" if f.startswith("/p") else "") for f in files], "FILE string, PROJECT string")
    shots = spark.createDataFrame([("SH01", 1), ("SH02", 2), ("SH1", 3), ("", 4)], "SHOTNAME string, n int")
    got = {r.FILE: r.SHOTNAME for r in joins.assign_shot(df, shots, ["n"]).collect()}
    assert got == {"/p/SH01/SH02/x": "SH02", "/p/SH1/y": "SH1", "/p/none": "", "/q/SH02": ""}
    first = {r.FILE: r.SHOTNAME for r in joins.assign_shot(df, shots, ["n"], "first").collect()}
    assert first["/p/SH01/SH02/x"] == "SH01"
    assert joins.assign_shot(df, shots.limit(0), ["n"]).where("SHOTNAME <> ''").count() == 0


def test_projects_match_whole_words(spark):
    df = spark.createDataFrame([("/jobs/ab/x",), ("/jobs/abc/x",), ("/jobs/a.c/x",)], "FILE string")
    jobs = spark.createDataFrame([("c1", "ab"), ("c2", "a.c")], "CLIENT string, PROJECT string")
    got = {r.FILE: r.PROJECT for r in joins.assign_projects(df, jobs).collect()}
    assert got == {"/jobs/ab/x": "ab", "/jobs/abc/x": "", "/jobs/a.c/x": "a.c"}


def test_no_cross_joins_in_matching(spark):
    df = spark.createDataFrame([("/p/SH01", "p")], "FILE string, PROJECT string")
    shots = spark.createDataFrame([("SH01",)], "SHOTNAME string")
    plan = joins.assign_shot(df, shots)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_duplicates(spark):
    paths = ["/a", "/a/b", "/ab", "/c/", "/c/d", "/e/", "/e/"]
    got = [(r.PATH, r.ISDUPLICATE) for r in joins.prefix_duplicates(spark.createDataFrame([(p,) for p in paths], "PATH string")).collect()]
    want = [(p, any(i != j and p.startswith(q.rstrip("/") + "/") for j, q in enumerate(paths))) for i, p in enumerate(paths)]
    assert sorted(got) == sorted(want)


@QUIET
@given(st.dictionaries(st.integers(0, 9), st.integers(0, 3)), st.dictionaries(st.integers(0, 9), st.integers(0, 3)))
def test_diff_leads_from_old_to_new(spark, old, new):
    a, b = (spark.createDataFrame(list(d.items()), "k int, v int") for d in (old, new))
    diff = joins.snapshot_diff(a, b, ["k"])
    assert dict(map(tuple, joins.apply_diff(a, diff, ["k"]).collect())) == new


def test_tree_paths_of_deep_and_wide_trees(spark):
    chain = [(None if i == 0 else i - 1, i, f"n{i}") for i in range(20)]
    wide = [(0, 100 + i, f"w{i}") for i in range(50)]
    df = spark.createDataFrame(chain + wide, "PARENT_ID bigint, ID bigint, NAME string")
    got = dict(map(tuple, trees.tree_paths(df).collect()))
    assert got[19] == "/".join(f"n{i}" for i in range(20)) and got[149] == "n0/w49" and len(got) == 70


def test_deepest_common_parent(spark):
    for paths, want in [(["/a/b/c", "/a/b/d/e"], "/a/b"), (["/a/x", "/b/y"], ""), (["C:/q", "C:/r"], "C:/"), (["/a/b/c"], "/a/b")]:
        df = spark.createDataFrame([(p,) for p in paths], "FILE string")
        assert aggregates.deepest_common_parent(df).first()[0] == want


def test_tree_hash_ignores_order_and_copies(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a/c",)], "FILE string")
    one = aggregates.tree_hash(df).first().TREE_HASH
    assert aggregates.tree_hash(df.unionAll(df).repartition(5)).first().TREE_HASH == one
    assert aggregates.tree_changed(df.where("FILE <> 'b'"), one).first()[0]
    assert not aggregates.tree_changed(df, one).first()[0]


def test_template_modes(spark):
    rows = spark.createDataFrame([("exr", "AC", "x"), ("", "BC", "y"), (None, "CC", "z"), ("tif", "DC", "t")], "DOTEXTENSION string, CLIENT string, FILE string")
    t = spark.createDataFrame([("exr", "CLIENT/YYYYMMDD.DOTEXTENSION"), ("mov", "m/CLIENT")], "DOTEXTENSION string, PROVISIONEDLINK string")
    got = sorted((r.FILE, r.PROVISIONEDLINK) for r in templates.expand_templates(rows, t).collect())
    assert got == [("x", "AC/YYYYMMDD.exr"), ("y", "BC/YYYYMMDD.DOTEXTENSION"), ("y", "m/BC"), ("z", "CC/YYYYMMDD.DOTEXTENSION"), ("z", "m/CC")]
    only = templates.expand_templates(rows, t, ["CLIENT"], "include", add_source="none")
    assert only.columns == ["DOTEXTENSION", "PROVISIONEDLINK"]


def test_session_fill_reads_the_old_values(spark):
    df = spark.createDataFrame([("BB", "x", "AA/BB")], "AA string, BB string, LINK string")
    none = spark.createDataFrame([], "Variable string, Action string, Value string")
    assert tuple(templates.fill_session(df, none).first()) == ("x", "x", "BB/x")


def test_first_mapping_row_decides(spark):
    df = spark.createDataFrame([("a/VA_VB.VC",), ("plain",), (None,)], "LINK string")
    rows = [("VA", "remap", "1", 3), ("VB", "ignore", "2", 1), ("VB", "remap", "3", 2), ("VA", "remap", "9", 4), ("VA", "ignore", "8", 5)]
    m = spark.createDataFrame(rows, "Variable string, Action string, Value string, n int").coalesce(1)
    got = [r.LINK for r in templates.resolve_variables(df, "LINK", m).collect()]
    assert sorted(map(str, got)) == ["None", "a/1_VB.VC", "plain"]
    got = [r.LINK for r in templates.resolve_variables(df, "LINK", m, -F.col("n")).collect()]
    assert sorted(map(str, got)) == ["None", "a/VA_3.VC", "plain"]
    assert {r.Variable for r in templates.unknown_variables(df, ["LINK"], m).collect()} == {"VC"}


def test_deep_trees_and_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"d{i}") for i in range(80)]
    edges = spark.createDataFrame(rows, "ID string, PARENT_ID string, NAME string")
    got = {r.ID: r.PATH for r in trees.tree_paths(edges).collect()}
    assert got == {f"n{i}": "/".join(f"d{k}" for k in range(i + 1)) for i in range(80)}
    loop = spark.createDataFrame([("a", "b", "x"), ("b", "a", "y")], "ID string, PARENT_ID string, NAME string")
    with pytest.raises(ValueError):
        trees.tree_paths(loop)


def test_long_names_after_a_dollar(spark):
    name = "N" * 250
    df = spark.createDataFrame([(f"/a/$${name}-$X $",), ("none",), ("",)], "DEST string")
    values = spark.createDataFrame([(name, "long"), ("X", "short")], "NAME string, VALUE string")
    assert {r.DEST for r in templates.dollar_externals(df, "DEST", values).collect()} == {"/a/$long-short $", "none", ""}


def test_fill_version_leaves_unknown_parts(spark):
    df = spark.createDataFrame([("/a_VERSION/b_VERSION.exr",), ("/c_VERSION.x",), ("/d",)], "DEST string")
    reg = spark.createDataFrame([("a_VERSION", "4-20240101-v-3"), ("b_VERSION", "99-x-V-2")], "IDENTIFIER string, ENTRY string")
    got = {r.DEST for r in templates.fill_version(df, "DEST", reg).collect()}
    assert got == {"/a_v005/b_V100.exr", "/c_VERSION.x", "/d"}


def test_next_version_modes(spark):
    log = spark.createDataFrame([("20240101", "3", "u", "a"), ("20240102", "bad", "u", "a"), ("20240102", "7", "u", "D_x")], "date string, VERSION string, user string, item string")
    items = spark.createDataFrame([("a",), ("new",), ("D_x",)], "item string")
    ids = lambda **k: {r.item: r.VERSION_ID for r in templates.next_version(items, log, **k).collect()}
    assert ids() == {"a": "v0004", "new": "v0001", "D_x": "v0008"}
    assert ids(mode="current")["a"] == "v0003" and ids(mode="12", style="no", padding=3)["a"] == "012"
    assert ids(day="20240101", dated="D_")["D_x"] == "v0001"
    with pytest.raises(ValueError):
        ids(mode="odd")


def test_schema_tables(spark):
    df = spark.createDataFrame([(1, ["a"], {"k": 1}, (1,))], "a int, b array<string>, c map<string,int>, d struct<x:int>")
    assert {r.COLUMN: r.KIND for r in tables.classify_columns(df).collect()} == {"a": "simple", "b": "list", "c": "map", "d": "struct"}
    assert [r.Field for r in tables.schema_to_table(df).collect()] == ["a", "b", "c", "d"]
    assert tables.table_to_schema([("x", "int64"), ("y", "float")]).simpleString() == "struct<x:bigint,y:double>"
    with pytest.raises(ValueError):
        tables.table_to_schema([("x", "nonsense")])
    assert tables.validate_table(df, df.schema, {"compression": "snappy", "version": "1"}).count() == 0
    wrong = tables.validate_table(df, T.StructType([T.StructField("a", T.LongType())]), {})
    assert {r.PART for r in wrong.collect()} == {"data", "metadata"}
    assert [r.Compression for r in tables.default_schema_table(spark).collect()] == ["NONE", "SNAPPY", "GZIP"]


def test_columns_and_details(spark):
    df = spark.createDataFrame([(None, 1.5, None)], "a string, b double, c int")
    assert tuple(columns.fill_and_stringify(df, ["b"]).first()) == ("", 1.5, "")
    assert tuple(columns.fill_blanks(df, ["c"]).first()) == ("", 1.5, 0.0)
    assert columns.ensure_columns(df, {"z": "int"}, index=0).columns == ["z", "a", "b", "c"]
    with pytest.raises(ValueError):
        aggregates.group_ids_by_region(df, "other", "a")


def test_repeated_right_keys_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0)], "k int, v string, x double")
    done = spark.createDataFrame(
        [(1, "p", None), (1, "q", None), (1, "q", 9.0), (None, "n", 5.0), (3, "z", 1.0)], "k int, v string, x double"
    )
    got = sorted(tuple(r) for r in columns.merge_processed(rows, done, "k").fillna({"k": 0}).collect())
    assert got == [(0, "d", 4.0), (1, "q", 9.0), (1, "q", 9.0), (2, "c", 3.0)]
    assert columns.merge_processed(rows, done.select("k"), "k").count() == 4
    states = spark.createDataFrame([(1, "a", "pending"), (1, "b", "pending"), (2, "c", "pending")], "k int, v string, STATUS string")
    picks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "k int, v string")
    decided = sorted((r.k, r.v, r.STATUS) for r in dedup.choose_valid(states, picks, "k", "v").collect())
    assert decided == [(1, "a", "invalid"), (1, "b", "valid"), (2, "c", "pending")]

"""Column functions on small hand-made values, odd cases first."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import items, names, nested, paths, ranges, tokens


def one(spark, values, *cols):
    """First row of columns over a one-row table."""
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def text(spark, value, fn):
    return one(spark, {"v": ("string", value)}, fn(F.col("v")))


@pytest.mark.parametrize(
    "style, path, want",
    [
        ("last_sep", "/a/b.0007.EXR", ("/a/b.%04d.exr", "0007", "4")),
        ("last_sep", "/a/b_12.png", ("/a/b_%02d.png", "12", "2")),
        ("last_sep", "/a/b.7.exr", ("", "", "")),
        ("last_sep", "/a/b.0007.mov", ("", "", "")),
        ("last_sep", "/a b/c d.0010.exr", ("/a b/c d.%04d.exr", "0010", "4")),
        ("last_sep", "plain", ("", "", "")),
        ("dot", "/a/b.7.mov", ("/a/b.%01d.mov", "7", "1")),
        ("dot", "b.7.mov", ("", "", "")),
        ("dot", "C:\\x\\b.001.Tif", ("C:\\x\\b.%03d.Tif", "001", "3")),
        ("dot_ext", "/a/b.7.mov", ("", "", "")),
        ("dot_ext", "/a/b.7.EXR", ("/a/b.%01d.EXR", "7", "1")),
        ("any_sep", "/a/b-07.exr", ("/a/b-%02d.exr", "07", "2")),
        ("any_sep", "/a/x.y.z.07.exr", ("", "", "")),
    ],
)
def test_sequence_columns(spark, style, path, want):
    cols = names.sequence_columns(F.col("v"), style)
    assert one(spark, {"v": ("string", path)}, *cols.values()) == want


def test_parse_sequence_path(spark):
    assert tuple(text(spark, "/a/b.0012.exr", names.parse_sequence_path)) == ("/a/b.%04d.exr", 12)
    assert text(spark, "b.0012.exr", names.parse_sequence_path) is None


@pytest.mark.parametrize("path, want", [("/a.b/c", "b/c"), ("/a/c", ""), ("x.e-r", ""), ("x.part", ""), ("x.tar.gz", "gz"), ("x.", "")])
def test_extension(spark, path, want):
    assert text(spark, path, names.extension) == want


@pytest.mark.parametrize("name, want", [("a.tar.gz", ("a.tar", ".gz")), (".hidden", (".hidden", "")), ("..x.y", ("..x", ".y")), ("plain", ("plain", ""))])
def test_split_extension(spark, name, want):
    assert one(spark, {"v": ("string", name)}, *names.split_extension(F.col("v"))) == want


@pytest.mark.parametrize(
    "path, want",
    [("/a/./b//c/../d/", "/a/b/d"), ("../x/..", ".."), ("a/..", "."), ("/..", "/"), ("a\\b", "a/b"), ("", ""), ("/a/b", "/a/b"), ("a/../../b", "../b")],
)
def test_normalize_path(spark, path, want):
    import posixpath

    assert text(spark, path, paths.normalize_path) == want
    if path and "\\" not in path:
        assert posixpath.normpath(path) == want


@pytest.mark.parametrize(
    "src, dst, want",
    [("/a/b/c", "/a/x/y", "../b/c"), ("/a/b", "/a/c", "b"), ("/a/b", "/a/b/c/d", "../"), ("/a/b/c", "/a/b", "c"), ("/x", "/a/b/c", "../../x")],
)
def test_relative_path(spark, src, dst, want):
    got = one(spark, {"s": ("string", src), "d": ("string", dst)}, paths.relative_path(F.col("s"), F.col("d")))
    assert got == want.rstrip("/")


@pytest.mark.parametrize("size, want", [("0", "0 B"), ("-4", "0 B"), ("x", "0 B"), (None, "0 B"), ("1023", "1023.0 B"), ("1024", "1.0 KB"), ("1152", "1.12 KB"), ("1073741824", "1.0 GB"), ("1500", "1.46 KB")])
def test_size_text(spark, size, want):
    assert text(spark, size, paths.size_text) == want


def test_size_text_fixed(spark):
    assert one(spark, {"v": ("double", 1152.0)}, paths.size_text_fixed(F.col("v"))) == "1.12 KB"
    assert one(spark, {"v": ("double", 3.0 * 1024**5)}, paths.size_text_fixed(F.col("v"))) == "3.00 PB"


def test_map_roots_inside_cells(spark):
    dtype = T.StructType.fromDDL("a array<string>, m map<string,string>, s string")
    df = spark.createDataFrame([((["/mnt/localF/x", "F:\\\\y"], {"k": "/Volumes/localF//z"}, "http://a//b"),)], T.StructType([T.StructField("v", dtype)]))
    got = df.select(paths.map_roots(F.col("v"), dtype, "F:/")).first()[0]
    assert (got.a, got.m, got.s) == (["F:/x", "F:/y"], {"k": "F:/z"}, "http://a//b")


def test_hash_key_kinds(spark):
    import hashlib

    want = hashlib.sha256(b"a").hexdigest()
    assert text(spark, " a\t", lambda c: paths.hash_key(c, T.StringType())) == want
    assert text(spark, None, lambda c: paths.hash_key(c, T.StringType())) == "noHash"
    assert one(spark, {"v": ("bigint", 1)}, paths.hash_key(F.col("v"), T.LongType())) == "noHash"


def test_ages(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    for past, want in [("2024-01-07 23:00:00", "2 days ago"), ("2024-01-09 20:00:00", "4 hours ago"), ("2024-01-09 23:55:00", "5 mins ago"), ("2024-01-09 23:59:30", "Just now"), (None, "Unknown")]:
        assert text(spark, past, lambda c: paths.relative_age(c.cast("timestamp"), now)) == want


@pytest.mark.parametrize("pattern", ["*/jobs/PROD/*", "*.m[o]v", "a?c", "[!x]*", "a[b", "x+y(z)*"])
def test_glob_to_regex(spark, pattern):
    import fnmatch

    for value in ["/q/jobs/PROD/x", "a.mov", "abc", "xyz", "a[b", "x+y(z)1", "ac"]:
        got = text(spark, value, lambda c: c.rlike(paths.glob_to_regex(pattern)))
        assert got == fnmatch.fnmatchcase(value, pattern), (pattern, value)


def test_items(spark):
    cols = items.item_columns(F.col("v"))
    got = one(spark, {"v": ("string", "F:\\x\\y\\SH1_a.%04d.exr")}, *[cols[c] for c in ("RAWITEMNAME", "ITEMNAME", "ITEMLOCATION", "ITEMLOCATIONROOT")])
    assert got == ("SH1_a.%04d.exr", "SH1_a.exr", "x/y", "F:")
    assert text(spark, "cover_V012.x", items.item_version) == ""
    assert text(spark, "a_V012", items.item_version) == "v012"
    assert text(spark, "a_v000", items.item_version) == ""
    assert text(spark, "ab3cd ef-GH", items.title_case) == "ab3cd ef-GH".title()
    with pytest.raises(ValueError):
        items.display_name(F.lit("x"), ["unknown"])


@pytest.mark.parametrize("package, current, want", [("a-b-who_x_1_2", None, "who_x"), ("a-b-c_d", None, None), ("a-b", "", ""), ("a-b-w_1_2", "kept", "kept")])
def test_recipient(spark, package, current, want):
    assert one(spark, {"p": ("string", package), "c": ("string", current)}, items.recipient(F.col("p"), F.col("c"))) == want


def test_tokens(spark):
    assert text(spark, "a/CLIENT-x_CLIENT.A1/B:12", tokens.uppercase_tokens) == ["CLIENT", "A1"]
    assert text(spark, "see C:/a/b, x;/c<d /e|f \\g", tokens.path_tokens) == ["C:/a/b", "/e", "\\g"]
    assert [tuple(x) for x in text(spark, "/a/b.exr /c/d", tokens.file_tokens)] == [("/a/b.exr", "b.exr")]
    assert text(spark, "D:/x/a.exr then e:\\b.MOV x.exr", lambda c: tokens.drive_paths(c, ["exr", "mov"])) == ["D:/x/a.exr", "e:\\b.MOV"]
    filled = text(spark, "AB/ABC_AB.CD", lambda c: tokens.fill_tokens(c, {"AB": F.lit("x"), "CD": F.lit(None).cast("string")}))
    assert filled == "x/ABC_x.CD"
    assert text(spark, "a__b.c", tokens.split_components) == ["a", "_", "", "_", "b", ".", "c"]
    assert text(spark, None, tokens.split_components) == []
    assert text(spark, "a.b A.B axb", lambda c: tokens.search_replace(c, "a.b", "$1\\")) == "$1\\ $1\\ axb"


def test_padding(spark):
    assert text(spark, "4", names.padding_form) == "%04d"
    assert text(spark, "12", names.padding_form) == "%12d"
    assert text(spark, "x", names.padding_form) == "x"


def test_nested(spark):
    cell = '{"a": [1, {"b": null}], "c": true}'
    got = {(r.path, r.data_type) for r in text(spark, cell, lambda c: nested.json_nodes(c, 3))}
    assert got == {
        ("(root)", "dict"), ("(root)['a']", "list"), ("(root)['a'][0]", "int"), ("(root)['a'][1]", "dict"),
        ("(root)['a'][1]['b']", "NoneType"), ("(root)['c']", "bool"),
    }
    assert text(spark, cell, lambda c: nested.get_by_path(c, ["a", 0], "int")) == 1
    with pytest.raises(TypeError):
        nested.set_by_path(F.col("v"), T.StringType(), ["a"], F.lit("x"))


def test_ranges(spark):
    for numbers, want in [([3, 1, 2, 7, 7], "1-3, 7"), ([], ""), ([5], "5"), ([1, 3, 5], "1, 3, 5")]:
        assert one(spark, {"v": ("array<bigint>", numbers)}, ranges.format_ranges(F.col("v"))) == want
    assert text(spark, "", ranges.parse_ranges) == []
    assert text(spark, "2-4, 9", ranges.parse_ranges) == [2, 3, 4, 9]

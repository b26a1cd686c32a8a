"""Queries: columns made from path, name and placeholder text."""

from pyspark.sql import functions as F

from pathloom.catalog.base import query
from pathloom.catalog.views import dirs, inv, table, with_views
from pathloom.functions import items, names, paths, tokens
from pathloom.operators import templates, trees
from pathloom.schemas import STORAGE_ROOTS


def _sequence_sql(case: str, prefix: str, number: str, suffix: str) -> str:
    return with_views("inv") + f"""
SELECT DISTINCT FILE, CASE WHEN {case} THEN concat({prefix}, '%0', cast(length({number}) AS string), 'd', {suffix}) ELSE '' END AS SEQUENCENAME,
  CASE WHEN {case} THEN {number} ELSE '' END AS SEQUENCEPOSITION,
  CASE WHEN {case} THEN cast(length({number}) AS string) ELSE '' END AS PADDING FROM inv"""


_NUM = r"regexp_extract(FILE, '(\d+)\.[^.]*$', 1)"
_PRE = r"regexp_replace(FILE, '\d+\.[^.]*$', '')"
_EXT = r"regexp_extract(FILE, '\.[^.]*$')"
_IMAGE = f"lower({_EXT}) IN ('.exr', '.png')"


def _sequence(spark, sf, style):
    cols = names.sequence_columns(F.col("FILE"), style)
    return inv(spark, sf).select("FILE").distinct().withColumns(cols)


@query("sequence_info_dot", _sequence_sql("true", _PRE, _NUM, _EXT))
def sequence_info_dot(spark, sf):
    return _sequence(spark, sf, "dot")


@query("sequence_info_ext", _sequence_sql(_IMAGE, _PRE, _NUM, _EXT))
def sequence_info_ext(spark, sf):
    return _sequence(spark, sf, "dot_ext")


@query("sequence_info_any_sep", _sequence_sql(_IMAGE, _PRE, _NUM, _EXT))
def sequence_info_any_sep(spark, sf):
    return _sequence(spark, sf, "any_sep")


@query("sequence_info", _sequence_sql(_IMAGE, _PRE, _NUM, f"lower({_EXT})"))
def sequence_info(spark, sf):
    return _sequence(spark, sf, "last_sep")


@query(
    "parse_sequence_path",
    with_views("inv") + f"SELECT DISTINCT FILE, concat({_PRE}, '%0', cast(length({_NUM}) AS string), 'd', {_EXT}) AS name, cast({_NUM} AS bigint) AS position FROM inv",
)
def parse_sequence_path(spark, sf):
    parsed = names.parse_sequence_path(F.col("FILE"))
    return inv(spark, sf).select("FILE").distinct().select("FILE", parsed["name"].alias("name"), parsed["position"].alias("position"))


ODD = """
SELECT o_orderkey, concat('/a.b/f', CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '.tmp' WHEN 2 THEN '.e_x' WHEN 3 THEN '.tar.gz'
  WHEN 4 THEN '.part' ELSE '.Exr' END) AS FILE FROM orders"""


def odd_files(spark, sf):
    key = F.col("o_orderkey") % 6
    ext = F.when(key == 0, "").when(key == 1, ".tmp").when(key == 2, ".e_x").when(key == 3, ".tar.gz").when(key == 4, ".part").otherwise(".Exr")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("/a.b/f"), ext).alias("FILE"))


@query(
    "extension",
    f"WITH o AS ({ODD}) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'b/f' WHEN 3 THEN 'gz' WHEN 5 THEN 'Exr' ELSE '' END AS DOTEXTENSION FROM o",
)
def extension(spark, sf):
    return odd_files(spark, sf).select("o_orderkey", names.extension(F.col("FILE")).alias("DOTEXTENSION"))


@query(
    "extension_group",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpg' WHEN 2 THEN '.tif' WHEN 3 THEN '.tif' WHEN 4 THEN '.jpeg' ELSE '.png' END AS EXT FROM part""",
)
def extension_group(spark, sf):
    key = F.col("p_partkey") % 6
    file = (
        F.when(key == 0, "x.JPEG").when(key == 1, "x.jpg").when(key == 2, "x.tiff").when(key == 3, "x.TIF")
        .when(key == 4, "x.%04d.jpeg").otherwise("x.png")
    )
    return table(spark, sf, "part").select("p_partkey", names.extension_group(file).alias("EXT"))


@query(
    "item_columns",
    with_views("inv") + r"""
SELECT DISTINCT FILE, regexp_extract(SEQ, '[^/]*$') AS RAWITEMNAME, replace(regexp_extract(SEQ, '[^/]*$'), '.%04d', '') AS ITEMNAME,
  array_to_string(string_split(SEQ, '/')[2:-2], '/') AS ITEMLOCATION, '' AS ITEMLOCATIONROOT, 'string' AS REMAPTYPE, '' AS PARENTITEM
FROM (SELECT FILE, regexp_replace(FILE, '\d{4}(\.[^.]*)$', '%04d\1') AS SEQ FROM inv)""",
)
def item_columns(spark, sf):
    rows = inv(spark, sf).select("FILE").distinct()
    seq = F.regexp_replace("FILE", r"\d{4}(\.[^.]*)$", "%04d$1")
    return rows.withColumns(items.item_columns(seq))


VERSIONED = """
SELECT p_partkey, concat('SH00', cast(p_partkey % 7 AS string), CASE p_partkey % 3 WHEN 0 THEN '-_' WHEN 1 THEN '' ELSE '_' END,
  replace(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '_v012' WHEN 1 THEN '_V000' WHEN 2 THEN 'V7' ELSE '' END, '.exr') AS ITEMNAME,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('SH00', cast(p_partkey % 5 AS string)) END AS SHOTNAME FROM part"""


def versioned_items(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.lit("SH00"), (key % 7).cast("string"), F.when(key % 3 == 0, "-_").when(key % 3 == 1, "").otherwise("_"),
            F.replace("p_name", F.lit(" "), F.lit("_")),
            F.when(key % 4 == 0, "_v012").when(key % 4 == 1, "_V000").when(key % 4 == 2, "V7").otherwise(""), F.lit(".exr"),
        ).alias("ITEMNAME"),
        F.when(key % 5 != 0, F.concat(F.lit("SH00"), (key % 5).cast("string"))).alias("SHOTNAME"),
    )


_STRIPPED = """
stripped AS (SELECT p_partkey, CASE WHEN SHOTNAME IS NOT NULL AND starts_with(base, SHOTNAME)
  THEN ltrim(substr(base, length(SHOTNAME) + 1), '-_') ELSE base END AS STRIPPEDITEMNAME
  FROM (SELECT *, regexp_replace(ITEMNAME, '\\.[^.]*$', '') AS base FROM v))""".replace("\\\\", "\\")


@query("strip_item_name", f"WITH v AS ({VERSIONED}), {_STRIPPED} SELECT * FROM stripped")
def strip_item_name(spark, sf):
    rows = versioned_items(spark, sf)
    return rows.select("p_partkey", items.strip_item_name(F.col("ITEMNAME"), F.col("SHOTNAME")).alias("STRIPPEDITEMNAME"))


@query(
    "item_version",
    f"WITH v AS ({VERSIONED}), {_STRIPPED}" + r""", cut AS (SELECT *, split_part(split_part(STRIPPEDITEMNAME,
  CASE WHEN contains(STRIPPEDITEMNAME, 'v') THEN 'v' ELSE 'V' END, 2), '.', 1) AS s FROM stripped)
SELECT p_partkey, STRIPPEDITEMNAME, CASE WHEN regexp_full_match(s, '[0-9]+') AND regexp_matches(s, '[1-9]') THEN concat('v', s) ELSE '' END AS ITEMVERSION FROM cut""",
)
def item_version(spark, sf):
    rows = versioned_items(spark, sf).withColumn("STRIPPEDITEMNAME", items.strip_item_name(F.col("ITEMNAME"), F.col("SHOTNAME")))
    return rows.select("p_partkey", "STRIPPEDITEMNAME", items.item_version(F.col("STRIPPEDITEMNAME")).alias("ITEMVERSION"))


PLACES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'no' ELSE 'file' END AS ISLINK,
  concat('/jobs', CASE o_orderkey % 3 WHEN 0 THEN '/IN/day/who' WHEN 1 THEN '/OUT/day/to' ELSE '/CHECK/x/y' END, cast(o_custkey AS string), '/f.exr') AS FILE,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a/IN/b' WHEN 2 THEN concat('\\s\\IN\\d\\seq', cast(o_custkey AS string)) ELSE '/x/OUT/d/out' END AS TARGET FROM orders""".replace("\\\\", "\\")


def places(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    head = F.when(key % 3 == 0, "/IN/day/who").when(key % 3 == 1, "/OUT/day/to").otherwise("/CHECK/x/y")
    target = (
        F.when(key % 4 == 0, "").when(key % 4 == 1, "a/IN/b")
        .when(key % 4 == 2, F.concat(F.lit("\\s\\IN\\d\\seq"), cust)).otherwise("/x/OUT/d/out")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 2 == 0, "no").otherwise("file").alias("ISLINK"),
        F.concat(F.lit("/jobs"), head, cust, F.lit("/f.exr")).alias("FILE"), target.alias("TARGET"),
    )


_AFTER = """, after AS (SELECT *, string_split(replace(FILE, '\\', '/'), '/') AS fp, string_split(replace(TARGET, '\\', '/'), '/') AS tp FROM p),
marked AS (SELECT *, coalesce(nullif(coalesce(list_position(fp, 'IN'), 0), 0), nullif(coalesce(list_position(fp, 'OUT'), 0), 0)) AS fi, nullif(coalesce(list_position(fp, 'IN'), 0), 0) AS fin,
  coalesce(nullif(coalesce(list_position(tp, 'IN'), 0), 0), nullif(coalesce(list_position(tp, 'OUT'), 0), 0)) AS ti, nullif(coalesce(list_position(tp, 'IN'), 0), 0) AS tin FROM after),
found AS (SELECT *, coalesce(fp[fi + 2], '') AS f_any, coalesce(tp[ti + 2], '') AS t_any, coalesce(fp[fin + 2], '') AS f_in, coalesce(tp[tin + 2], '') AS t_in FROM marked)
"""


@query("who_from_files", f"WITH p AS ({PLACES}){_AFTER} SELECT o_orderkey, CASE WHEN t_in <> '' THEN t_in ELSE f_in END AS WHOFROM FROM found")
def who_from_files(spark, sf):
    return places(spark, sf).select("o_orderkey", items.who_from_files(F.col("TARGET"), F.col("FILE")).alias("WHOFROM"))


@query("who_from", f"WITH p AS ({PLACES}){_AFTER} SELECT o_orderkey, CASE WHEN ISLINK = 'no' THEN f_any ELSE '' END AS WHOFROM FROM found")
def who_from(spark, sf):
    return places(spark, sf).select("o_orderkey", items.who_from(F.col("ISLINK"), F.col("FILE")).alias("WHOFROM"))


@query(
    "who_to",
    f"WITH p AS ({PLACES}){_AFTER} SELECT o_orderkey, CASE WHEN ISLINK <> 'no' THEN t_any ELSE '' END AS WHOFROM, CASE WHEN ISLINK <> 'no' THEN f_any ELSE '' END AS WHOTO FROM found",
)
def who_to(spark, sf):
    rows = places(spark, sf)
    return rows.withColumns(items.who_to(F.col("ISLINK"), F.col("FILE"), F.col("TARGET"))).select("o_orderkey", "WHOFROM", "WHOTO")


@query("who_links", f"WITH p AS ({PLACES}){_AFTER} SELECT o_orderkey, t_any AS WHOTO, f_any AS WHOFROM FROM found")
def who_links(spark, sf):
    cols = items.who_links(F.col("TARGET"), F.lit("").cast("string"), F.col("FILE"))
    return places(spark, sf).withColumns(cols).select("o_orderkey", "WHOTO", "WHOFROM")


@query(
    "recipient",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'set' WHEN 1 THEN concat('vendor_', cast(o_custkey AS string)) ELSE NULL END AS PACKAGERECIPIENT FROM orders""",
)
def recipient(spark, sf):
    key = F.col("o_orderkey") % 4
    package = F.when(key == 3, "a-b").when(key == 2, "a-b-c_d").otherwise(
        F.concat(F.lit("2024-pkg-vendor_"), F.col("o_custkey").cast("string"), F.lit("_01_final"))
    )
    return table(spark, sf, "orders").select("o_orderkey", items.recipient(package, F.when(key == 0, "set")).alias("PACKAGERECIPIENT"))


_UNITS = "CASE WHEN n < 1024 THEN {0} WHEN n < 1048576 THEN {1} ELSE {2} END"


@query(
    "size_text",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN -5 ELSE cast(floor(l_extendedprice * l_quantity) AS bigint) END AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, n, CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN concat(cast(round_even(n / 1.0::double, 2) AS string), ' B')
  WHEN n < 1048576 THEN concat(cast(round_even(n / 1024.0::double, 2) AS string), ' KB')
  ELSE concat(cast(round_even(n / 1048576.0::double, 2) AS string), ' MB') END AS FILESIZE FROM s""",
)
def size_text(spark, sf):
    n = F.when(F.col("l_orderkey") % 9 == 0, -5).otherwise(F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))
    return rows.withColumn("FILESIZE", paths.size_text(F.col("n")))


@query(
    "size_text_fixed",
    """WITH s AS (SELECT l_orderkey, l_linenumber, cast(floor(l_extendedprice * l_quantity) AS bigint) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN printf('%.2f B', n::double)
  WHEN n < 1048576 THEN printf('%.2f KB', round_even(n / 1024.0::double, 2)) ELSE printf('%.2f MB', round_even(n / 1048576.0::double, 2)) END AS SIZE FROM s""",
)
def size_text_fixed(spark, sf):
    n = F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", paths.size_text_fixed(n).alias("SIZE"))


@query(
    "hash_key",
    with_views("inv") + """
SELECT DISTINCT FILE, sha256(FILE) AS HASHEDFILE, sha256(FILE) AS NOROOT, sha256(replace(FILE, '/', '')) AS NOSLASHES, 'noHash' AS NUMERIC FROM inv""",
)
def hash_key(spark, sf):
    rows = inv(spark, sf)
    text, number = rows.schema["FILE"].dataType, rows.schema["OID"].dataType
    padded = F.concat(F.lit(" \t"), "FILE", F.lit(" \n"))
    rooted = F.concat(F.lit("/mnt/localF/"), "FILE")
    return rows.select(
        "FILE", paths.hash_key(padded, text).alias("HASHEDFILE"), paths.hash_key(rooted, text, STORAGE_ROOTS).alias("NOROOT"),
        paths.hash_key(F.col("FILE"), text, STORAGE_ROOTS, drop_slashes=True).alias("NOSLASHES"),
        paths.hash_key(F.col("OID"), number).alias("NUMERIC"),
    ).distinct()


@query(
    "entry_time",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE date_trunc('second', o_orderdate::timestamp) END AS ENTRYTIME,
  TIMESTAMP '2024-05-06 07:08:09' AS LOADED FROM orders""",
)
def entry_time(spark, sf):
    """Entry time of each order row, read from a text, and a load time from a given clock."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    clock = F.lit("2024-05-06 07:08:09.5").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", paths.entry_time(text).alias("ENTRYTIME"), paths.entry_time(now=clock).alias("LOADED"))


@query(
    "node_id",
    with_views("dirs") + "SELECT DISTINCT FILE, sha256(concat(regexp_extract(FILE, '([^/]*)/[^/]*$', 1), '-', regexp_extract(FILE, '[^/]*$'))) AS ID FROM dirs",
)
def node_id(spark, sf):
    parts = F.split("FILE", "/")
    return dirs(spark, sf).select("FILE", paths.node_id(F.element_at(parts, -2), F.element_at(parts, -1)).alias("ID")).distinct()


@query(
    "scan_id",
    with_views("inv") + """SELECT CLIENT, sha256(concat('{"paths":["/jobs/', CLIENT, '"],"time":"', strftime(max(ENTRYTIME), '%Y-%m-%d'), '"}')) AS SCANID FROM inv GROUP BY CLIENT""",
)
def scan_id(spark, sf):
    scans = inv(spark, sf).groupBy("CLIENT").agg(F.date_format(F.max("ENTRYTIME"), "yyyy-MM-dd").alias("t"))
    return scans.select("CLIENT", paths.scan_id(F.array(F.concat(F.lit("/jobs/"), "CLIENT")), F.col("t")).alias("SCANID"))


@query(
    "normalize_path",
    with_views("inv") + "SELECT DISTINCT FILE, FILE AS ABSOLUTE, substr(FILE, 2) AS RELATIVE, concat('../', substr(FILE, 2)) AS UPWARDS FROM inv",
)
def normalize_path(spark, sf):
    rows = inv(spark, sf).select("FILE").distinct()
    messy = F.concat(F.lit("/../x/./..//"), F.replace("FILE", F.lit("/IN/"), F.lit("/./IN/no/..//")))
    bare = F.substr("FILE", F.lit(2))
    return rows.select(
        "FILE", paths.normalize_path(messy).alias("ABSOLUTE"),
        paths.normalize_path(F.concat(F.lit("./a/../"), bare)).alias("RELATIVE"),
        paths.normalize_path(F.concat(F.lit("a/../../b/../"), bare)).alias("UPWARDS"),
    )


@query(
    "relative_path",
    with_views("inv") + r"""
SELECT DISTINCT FILE, concat('../../../', regexp_extract(FILE, '^/jobs/(.*)$', 1)) AS FAR,
  concat('../', regexp_extract(FILE, '([^/]*/[^/]*)$', 1)) AS NEAR, regexp_extract(FILE, '[^/]*$') AS SAME FROM inv""",
)
def relative_path(spark, sf):
    rows = inv(spark, sf).select("FILE").distinct()
    folder = F.regexp_replace("FILE", "/[^/]*$", "")
    above = F.regexp_replace(folder, "/[^/]*$", "")
    return rows.select(
        "FILE", paths.relative_path(F.col("FILE"), F.lit("/jobs/out/day/one/link")).alias("FAR"),
        paths.relative_path(F.col("FILE"), F.concat(above, F.lit("/pkg/link.exr"))).alias("NEAR"),
        paths.relative_path(F.col("FILE"), F.concat(folder, F.lit("/other"))).alias("SAME"),
    )


@query(
    "explode_ancestors",
    with_views("dirs") + """
, p AS (SELECT DISTINCT FILE, string_split(FILE, '/') AS s FROM dirs),
r AS (SELECT FILE, s, unnest(range(1, len(s))) AS n FROM p)
SELECT FILE, cast(n AS int) AS LEVEL, array_to_string(s[1:n], '/') AS ANCESTOR, array_to_string(s[n + 1:], '/') AS REMAINDER FROM r""",
)
def explode_ancestors(spark, sf):
    return trees.explode_ancestors(dirs(spark, sf).select("FILE").distinct())


@query(
    "link_levels",
    with_views("dirs") + """
, p AS (SELECT DISTINCT FILE, string_split(FILE, '/') AS s FROM dirs), r AS (SELECT FILE, s, unnest(range(1, len(s) + 1)) AS n FROM p)
SELECT FILE, cast(n AS int) AS LEVEL, array_to_string(s[1:n], '/') AS PATH FROM r""",
)
def link_levels(spark, sf):
    return trees.link_levels(dirs(spark, sf).select("FILE").distinct(), "FILE")


@query(
    "paste_back",
    with_views("dirs") + """
, p AS (SELECT page_id, FILE, string_split(FILE, '/') AS s FROM dirs), r AS (SELECT page_id, FILE, s, unnest(range(1, len(s))) AS n FROM p)
SELECT page_id, FILE, cast(n AS int) AS LEVEL, array_to_string(s[1:n], '/') AS ANCESTOR, array_to_string(s[n + 1:], '/') AS REMAINDER FROM r""",
)
def paste_back(spark, sf):
    return trees.decompose_and_join(dirs(spark, sf))


@query(
    "template_display_name",
    r"""WITH i AS (SELECT p_partkey, concat('__', replace(p_name, ' ', '-'), '_', p_type, '3d') AS Item FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(replace(ltrim(Item, '_'), '_', ' '), '-', ' '), '[A-Za-z]+|[^A-Za-z]+'),
  lambda x: concat(upper(x[1]), lower(x[2:]))), '') AS DISPLAYNAME FROM i""",
)
def template_display_name(spark, sf):
    item = F.concat(F.lit("__"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), "p_type", F.lit("3d"))
    return table(spark, sf, "part").select("p_partkey", items.display_name(item, ["underscores", "spaces", "capitalise"]).alias("DISPLAYNAME"))


@query(
    "relative_age",
    """WITH d AS (SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-15 00:00:00') AS s FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'),
e AS (SELECT event_id, s // 86400 AS d, s % 86400 AS r FROM d)
SELECT event_id, CASE WHEN d > 0 THEN concat(cast(d AS string), ' days ago') WHEN r > 3600 THEN concat(cast(r // 3600 AS string), ' hours ago')
  WHEN r > 60 THEN concat(cast(r // 60 AS string), ' mins ago') ELSE 'Just now' END AS AGE FROM e""",
)
def relative_age(spark, sf):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf, "events").where(F.col("ts").cast("timestamp") <= now).select("event_id", paths.relative_age(ts, now).alias("AGE"))


@query(
    "share_forms",
    r"""SELECT s_suppkey, concat('srv', cast(s_suppkey AS string), '/share/a') AS UNIX, concat('\\', 'srv', cast(s_suppkey AS string), '\share\a') AS WINDOWS,
  concat('srv', cast(s_suppkey AS string), ':/share') AS NFS FROM supplier""",
)
def share_forms(spark, sf):
    host = F.concat(F.lit("srv"), F.col("s_suppkey").cast("string"))
    forms = paths.smb_forms(F.concat(F.lit(" smb:\\\\"), host, F.lit("\\share/a ")))
    return table(spark, sf, "supplier").select(
        "s_suppkey", forms["unix"].alias("UNIX"), forms["windows"].alias("WINDOWS"),
        paths.nfs_form(F.concat(host, F.lit("/share"))).alias("NFS"),
    )


LINKS = """
SELECT o_orderkey, concat(CASE o_orderkey % 3 WHEN 0 THEN 'CLIENT/PROJECT' WHEN 1 THEN 'x/CLIENT-A_SHOT' ELSE 'lower/mixEd' END, '/v_', o_orderpriority, '.DOTEXTENSION') AS LINK,
  CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS CLIENT, cast(o_custkey AS string) AS PROJECT FROM orders"""


def links(spark, sf):
    key = F.col("o_orderkey")
    head = F.when(key % 3 == 0, "CLIENT/PROJECT").when(key % 3 == 1, "x/CLIENT-A_SHOT").otherwise("lower/mixEd")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat(head, F.lit("/v_"), "o_orderpriority", F.lit(".DOTEXTENSION")).alias("LINK"),
        F.when(key % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("CLIENT"), F.col("o_custkey").cast("string").alias("PROJECT"),
    )


_PARTS = r"regexp_split_to_array(LINK, '[-_./:\\]')"


@query(
    "uppercase_tokens",
    f"WITH l AS ({LINKS}) SELECT o_orderkey, array_to_string(list_filter({_PARTS}, lambda p: length(p) > 1 AND p = upper(p) AND p <> lower(p)), '|') AS TOKENS FROM l",
)
def uppercase_tokens(spark, sf):
    return links(spark, sf).select("o_orderkey", F.array_join(tokens.uppercase_tokens(F.col("LINK")), "|").alias("TOKENS"))


_DOC_TEXT = "concat(text, ' F:/jobs/', source, '/', cast(doc_id AS string), '.exr end \\srv\\x;/b<c /d,e')"


def doc_text():
    return F.concat(
        "text", F.lit(" F:/jobs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".exr end \\srv\\x;/b<c /d,e")
    )


_PATHS_SQL = f"""
WITH d AS (SELECT doc_id, {_DOC_TEXT} AS t FROM documents),
p AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(t, '(?:[A-Za-z]:)?[/\\\\][^ \\n\\t;,|]*'), lambda x: NOT regexp_matches(x, '[><|;]'))) AS FOUND FROM d)
"""


@query("path_tokens", _PATHS_SQL + "SELECT doc_id, FOUND FROM p")
def path_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(tokens.path_tokens(doc_text())).alias("FOUND"))


@query(
    "file_tokens",
    _PATHS_SQL + r"SELECT doc_id, FOUND, list_extract(string_split(FOUND, '/'), -1) AS NAME FROM p WHERE regexp_matches(FOUND, '\.\w+$')",
)
def file_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.inline(tokens.file_tokens(doc_text())).alias("FOUND", "NAME"))


@query(
    "drive_paths",
    "SELECT doc_id, concat('F:/jobs/', source, '/', cast(doc_id AS string), '.EXR') AS FOUND FROM documents",
)
def drive_paths(spark, sf):
    line = F.concat(F.lit("see F:/jobs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".EXR and more.exr"))
    return table(spark, sf, "documents").select("doc_id", F.explode(tokens.drive_paths(line, ["exr", "mov"])).alias("FOUND"))


@query(
    "parse_columns",
    f"WITH l AS ({LINKS}), c AS (SELECT o_orderkey, concat_ws(' ', LINK, CLIENT) AS LINK FROM l) SELECT o_orderkey, unnest(list_distinct(list_filter({_PARTS}, lambda p: length(p) > 1 AND p = upper(p) AND p <> lower(p)))) AS FOUND FROM c",
)
def parse_columns(spark, sf):
    return templates.parse_columns(links(spark, sf), "uppercase", ["LINK", "CLIENT"], ["o_orderkey"])


@query(
    "fill_tokens",
    f"""WITH l AS ({LINKS}) SELECT o_orderkey, replace(replace(CASE WHEN CLIENT = ' ' THEN LINK ELSE replace(LINK, 'CLIENT', CLIENT) END, '/PROJECT', '/' || PROJECT), 'DOTEXTENSION', 'exr') AS LINK FROM l""",
)
def fill_tokens(spark, sf):
    rows = links(spark, sf)
    values = tokens.row_values(["CLIENT", "PROJECT"], extra={"DOTEXTENSION": F.lit("exr")})
    return rows.select("o_orderkey", tokens.fill_tokens(F.col("LINK"), values).alias("LINK"))


@query(
    "map_values",
    f"""WITH l AS ({LINKS}) SELECT o_orderkey, unnest(list_concat(CASE WHEN CLIENT = ' ' THEN [] ELSE ['CLIENT=' || CLIENT] END, ['PROJECT=' || PROJECT])) AS ENTRY FROM l""",
)
def map_values(spark, sf):
    values = F.map_entries(tokens.value_map(tokens.row_values(["CLIENT", "PROJECT"])))
    entry = F.transform(values, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return links(spark, sf).select("o_orderkey", F.explode(entry).alias("ENTRY"))


@query(
    "padding_form",
    """SELECT l_orderkey, l_linenumber, concat('%0', cast(l_linenumber AS string), 'd') AS STANDARD, repeat('#', l_linenumber) AS HASHED,
       concat('$F', cast(l_linenumber AS string)) AS DOLLAR, 'none' AS BAD, '%12d' AS WIDE FROM lineitem""",
)
def padding_form(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", names.padding_form(n).alias("STANDARD"), names.padding_form(n, "hashed").alias("HASHED"),
        names.padding_form(n, "dollar").alias("DOLLAR"), names.padding_form(F.lit("none")).alias("BAD"), names.padding_form(F.lit("12")).alias("WIDE"),
    )


@query("extension_case", "SELECT p_partkey, upper(p_type) AS UP, lower(p_type) AS LOW, p_type AS SAME FROM part")
def extension_case(spark, sf):
    ext = F.col("p_type")
    return table(spark, sf, "part").select(
        "p_partkey", names.extension_case(ext, "upper").alias("UP"), names.extension_case(ext, "lower").alias("LOW"), names.extension_case(ext).alias("SAME")
    )


@query(
    "dollar_columns",
    "SELECT o_orderkey, concat('/', o_orderstatus, '/', o_orderpriority, '/', o_orderstatus) AS DESTPREVIEW FROM orders",
)
def dollar_columns(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("ST"), F.col("o_orderpriority").alias("STATE"))
    rows = rows.withColumn("DEST", F.lit("/$ST/$STATE/$ST"))
    return templates.dollar_columns(rows).select("o_orderkey", "DESTPREVIEW")


@query("dollar_columns_batch", "SELECT o_orderkey, concat('/$ST/', o_orderpriority, '.x') AS DESTPREVIEW FROM orders")
def dollar_columns_batch(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("ST"), F.col("o_orderpriority").alias("LEVEL"))
    rows = rows.withColumn("DEST", F.lit("/$ST/$LEVEL.x"))
    return templates.dollar_columns(rows, batch=True).select("o_orderkey", "DESTPREVIEW")


@query(
    "search_replace",
    r"""SELECT doc_id, regexp_replace(text, 'the', 'THAT', 'gi') AS ANY_CASE, regexp_replace(text, '\bthe\b', 'X', 'g') AS WHOLE FROM documents WHERE lang = 'en'""",
)
def search_replace(spark, sf):
    rows = table(spark, sf, "documents").where("lang = 'en'")
    return rows.select(
        "doc_id", tokens.search_replace(F.col("text"), "the", "THAT").alias("ANY_CASE"),
        tokens.search_replace(F.col("text"), "the", "X", match_case=True, whole_word=True).alias("WHOLE"),
    )


@query(
    "search_replace_delimited",
    "SELECT p_partkey, array_to_string(list_transform(string_split(concat(p_brand, '_', p_type, '_', replace(p_name, ' ', '_')), '_'), lambda x: CASE WHEN lower(x) = 'red' THEN 'blue$1' ELSE x END), '_') AS LINK FROM part",
)
def search_replace_delimited(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_"))).alias("LINK"))
    return templates.search_replace(rows, "RED", "blue$1", ["LINK"], whole_word=True, delimiters=["_"])


SEGMENTS = "SELECT page_id, string_split(replace(url, 'https://', ''), '/') AS s, replace(url, 'https://', '') AS LINK FROM pages"


@query(
    "split_segments",
    f"WITH x AS ({SEGMENTS}), n AS (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM x) SELECT page_id, CAST(i AS INTEGER) AS POSITION, s[i] AS SEGMENT FROM n",
)
def split_segments(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("https://"), F.lit("")).alias("PROVISIONEDLINK"))
    return templates.segment_rows(rows)


@query("compose_link", f"WITH x AS ({SEGMENTS}) SELECT page_id, LINK AS PROVISIONEDLINK FROM x")
def compose_link(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("https://"), F.lit("")).alias("PROVISIONEDLINK"))
    cut = templates.split_segments(rows)
    return templates.compose_link(cut).select("page_id", "PROVISIONEDLINK")


@query(
    "split_components",
    r"""SELECT p_partkey, array_to_string(string_split(regexp_replace(concat(p_brand, '__', p_name, '-', p_type, '.exr'), '([_.-])', '|\1|', 'g'), '|'), '+') AS COMPONENTS FROM part""",
)
def split_components(spark, sf):
    text = F.concat("p_brand", F.lit("__"), "p_name", F.lit("-"), "p_type", F.lit(".exr"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tokens.split_components(text), "+").alias("COMPONENTS"))


@query("replica_paths", with_views("dirs") + "SELECT page_id, concat('/copy/', substr(FILE, 6)) AS FILE FROM dirs")
def replica_paths(spark, sf):
    return trees.replica_paths(dirs(spark, sf), "/web", "/copy", "FILE")


@query(
    "link_in_package",
    with_views("dirs") + "SELECT page_id, substr(FILE, 6) AS LINK FROM dirs WHERE NOT ends_with(FILE, '/')",
)
def link_in_package(spark, sf):
    rows = dirs(spark, sf).where(~F.endswith("FILE", F.lit("/")))
    return rows.select("page_id", paths.link_in_package(F.concat(F.lit("./x/.."), F.substr("FILE", F.lit(5))), "/pkg").alias("LINK"))

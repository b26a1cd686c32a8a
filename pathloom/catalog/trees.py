"""Queries: trees, nested cells, schema tables and tiles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.catalog.base import query
from pathloom.catalog.views import dirs, instances, spread, statuses, table, with_views
from pathloom.functions import nested
from pathloom.operators import columns, tables, trees
from pathloom.plans.instances import group_configs as flatten_groups

_STEPS = """
, p AS (SELECT DISTINCT string_split(FILE, '/') AS s FROM dirs), r AS (SELECT s, unnest(range(2, len(s) + 1)) AS n FROM p)
"""


@query(
    "tree_edges",
    with_views("dirs") + _STEPS + "SELECT DISTINCT array_to_string(s[1:n - 1], '/') AS parent, array_to_string(s[1:n], '/') AS child, s[n] AS short_name, s[n] AS display_name, false AS is_expanded FROM r",
)
def tree_edges(spark, sf):
    return trees.tree_edges(dirs(spark, sf), "FILE")


_FOLDERS = """
, p AS (SELECT DISTINCT string_split(regexp_replace(FILE, '/[^/]*$', ''), '/')[2:] AS s FROM dirs),
d AS (SELECT DISTINCT s[1:n] AS s FROM (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p))
"""


def folders(spark, sf):
    return trees.list_directories(dirs(spark, sf).withColumn("FILE", F.substr("FILE", F.lit(2))))


@query(
    "tree_ids",
    with_views("dirs") + _FOLDERS + """
, i AS (SELECT array_to_string(s, '/') AS PATH, s[len(s)] AS NAME, sha256(concat(CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], '/') ELSE 'tree_root' END, '-', array_to_string(s, '/'))) AS ID,
  CASE WHEN len(s) = 1 THEN sha256('tree_root-tree_root') WHEN len(s) = 2 THEN sha256(concat('tree_root-', s[1])) ELSE sha256(concat(array_to_string(s[1:len(s) - 2], '/'), '-', array_to_string(s[1:len(s) - 1], '/'))) END AS PARENT_ID FROM d)
SELECT *, concat(PARENT_ID, '-', ID, '-dir') AS FIELD FROM i""",
)
def tree_ids(spark, sf):
    return trees.tree_ids(folders(spark, sf))


@query(
    "tree_ids_by_name",
    with_views("dirs") + _FOLDERS + """
SELECT array_to_string(s, '/') AS PATH, sha256(concat(CASE WHEN len(s) > 1 THEN s[len(s) - 1] ELSE 'tree_root' END, '-', s[len(s)])) AS ID,
  sha256(concat(CASE WHEN len(s) > 2 THEN s[len(s) - 2] ELSE 'tree_root' END, '-', CASE WHEN len(s) > 1 THEN s[len(s) - 1] ELSE 'tree_root' END)) AS PARENT_ID FROM d""",
)
def tree_ids_by_name(spark, sf):
    return trees.tree_ids(folders(spark, sf), by_name=True).select("PATH", "ID", "PARENT_ID")


@query(
    "package_tree",
    with_views("dirs") + """
, p AS (SELECT DISTINCT string_split(substr(FILE, 2), '/') AS s FROM dirs), r AS (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM p)
SELECT DISTINCT array_to_string(s[1:n], '/') AS PATH, s[n] AS NAME, CASE WHEN n = len(s) THEN 'file' ELSE 'dir' END AS KIND,
  CASE WHEN n = len(s) THEN sha256(concat(s[n - 1], '-', s[n])) ELSE sha256(concat(s[n], '-', array_to_string(s[1:n], '/'))) END AS ID,
  CASE WHEN n > 1 THEN sha256(concat(s[n - 1], '-', array_to_string(s[1:n - 1], '/'))) END AS PARENT_ID,
  concat(s[n], '-', CASE WHEN n = len(s) THEN 'file' ELSE 'dir' END) AS FIELD FROM r""",
)
def package_tree(spark, sf):
    return trees.package_tree(dirs(spark, sf).select(F.substr("FILE", F.lit(2)).alias("DEST")))


@query("dest_fields", with_views("dirs") + "SELECT concat(FILE, '-file') AS FIELD, sha256(concat(FILE, '-', cast(page_id AS string))) AS HASHEDFILE FROM dirs")
def dest_fields(spark, sf):
    return trees.dest_fields(dirs(spark, sf).select(F.col("FILE").alias("DEST"), F.col("page_id").cast("string").alias("SRC")))


@query("tree_paths", with_views("dirs") + _FOLDERS + "SELECT concat('/mnt/', array_to_string(s, '/')) AS PATH FROM d")
def tree_paths(spark, sf):
    """Paths of all folders rebuilt from ids and names alone."""
    return trees.tree_paths(trees.tree_ids(folders(spark, sf)).select("PARENT_ID", "ID", "NAME"), "/mnt").select("PATH")


@query(
    "collect_tree",
    with_views("dirs") + _FOLDERS + """
, c AS (SELECT coalesce(array_to_string(s[1:len(s) - 1], '/'), '') AS PARENT_ID, array_to_string(s, '/') AS id, s[len(s)] AS name FROM d)
SELECT PARENT_ID, 0 AS CHUNK, concat('[', string_agg(concat('{"id":"', id, '","name":"', name, '"}'), ',' ORDER BY name, id), ']') AS CHILDREN FROM c GROUP BY PARENT_ID""",
)
def collect_tree(spark, sf):
    rows = folders(spark, sf).select(
        F.regexp_replace("DIRECTORY", "/?[^/]*$", "").alias("PARENT_ID"), F.col("DIRECTORY").alias("ID"), F.element_at(F.split("DIRECTORY", "/"), -1).alias("NAME")
    )
    return trees.collect_tree(rows)


@query(
    "parent_child_names",
    with_views("dirs") + _FOLDERS + "SELECT CASE WHEN len(s) > 1 THEN s[len(s) - 1] ELSE 'Data_root' END AS PARENT, s[len(s)] AS CHILD FROM d",
)
def parent_child_names(spark, sf):
    return trees.parent_child_names(trees.tree_ids(folders(spark, sf)))


@query(
    "add_nodes",
    "SELECT c_nationkey AS PARENT_ID, c_custkey AS ID, c_name AS NAME FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def add_nodes(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("PARENT_ID"), F.col("c_custkey").alias("ID"), F.col("c_name").alias("NAME"))
    return trees.add_nodes(rows.where("ID % 2 = 0"), rows.where("ID % 3 = 0"))


@query("tag_value", with_views("instances") + "SELECT InstanceId, Name, RenderGroup, NULL::varchar AS Missing FROM instances")
def tag_value(spark, sf):
    tags = F.col("Tags")
    return instances(spark, sf).select(
        "InstanceId", nested.tag_value(tags, "Name").alias("Name"), nested.tag_value(tags, "renderGroup").alias("RenderGroup"), nested.tag_value(tags, "none").alias("Missing")
    )


@query(
    "passed_checks",
    "SELECT concat('i-', lpad(cast(s_suppkey AS string), 17, '0')) AS InstanceId, cast((s_suppkey % 2 = 0)::int + (s_suppkey % 3 = 0)::int + (s_suppkey % 7 = 0)::int AS int) AS PASSED FROM supplier WHERE s_suppkey % 5 <> 0",
)
def passed_checks(spark, sf):
    passed = nested.passed_checks(F.col("InstanceStatus.Details"), F.col("SystemStatus.Details"))
    return statuses(spark, sf).select("InstanceId", passed.alias("PASSED"))


@query(
    "region_family_state",
    with_views("instances") + "SELECT InstanceId, Region, split_part(InstanceType, '.', 1) AS InstanceFamily, split_part(InstanceType, '.', 2) AS InstanceXlarge, State_Name AS State FROM instances",
)
def region_family_state(spark, sf):
    rows = instances(spark, sf).withColumns({**nested.family_and_size(F.col("InstanceType")), "Region": nested.region_of_zone(F.col("Placement.AvailabilityZone"))})
    return rows.select("InstanceId", "Region", "InstanceFamily", "InstanceXlarge", F.col("State.Name").alias("State"))


@query(
    "group_configs",
    "SELECT p_name || cast(p_partkey AS string) AS ASGName, 0 AS MinSize, p_size AS MaxSize, p_size // 2 AS DesiredCapacity, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS LaunchTemplateId, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(p_type, ',', p_brand) END AS InstanceTypes FROM part",
)
def group_configs(spark, sf):
    key = F.col("p_partkey")
    template = F.when(key % 2 == 1, F.struct(F.col("p_brand").alias("LaunchTemplateId")))
    overrides = F.array(F.struct(F.col("p_type").alias("InstanceType")), F.struct(F.col("p_brand").alias("InstanceType")))
    policy = F.when(key % 3 != 0, F.struct(F.struct(overrides.alias("Overrides")).alias("LaunchTemplate")))
    rows = table(spark, sf, "part").select(
        F.concat("p_name", key.cast("string")).alias("AutoScalingGroupName"), F.lit(0).alias("MinSize"), F.col("p_size").alias("MaxSize"),
        F.expr("p_size div 2").cast("int").alias("DesiredCapacity"), template.alias("LaunchTemplate"), policy.alias("MixedInstancesPolicy"),
    )
    return flatten_groups(rows).withColumn("InstanceTypes", F.array_join("InstanceTypes", ","))


@query(
    "nested_paths",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, '(root)' AS path, 'dict' AS data_type, concat('{"a":[', k, ',{"b":"x"}],"k":', k, '}') AS value FROM e UNION ALL
SELECT event_id, '(root)[''k'']', 'int', k FROM e UNION ALL
SELECT event_id, '(root)[''a'']', 'list', concat('[', k, ',{"b":"x"}]') FROM e UNION ALL
SELECT event_id, '(root)[''a''][0]', 'int', k FROM e UNION ALL
SELECT event_id, '(root)[''a''][1]', 'dict', '{"b":"x"}' FROM e UNION ALL
SELECT event_id, '(root)[''a''][1][''b'']', 'str', '"x"' FROM e""",
)
def nested_paths(spark, sf):
    k = F.get_json_object("props", "$.k")
    cell = F.concat(F.lit('{"k": '), k, F.lit(', "a": ['), k, F.lit(', {"b": "x"}]}'))
    rows = spread(table(spark, sf, "events"), "event_id")
    return rows.select("event_id", F.inline(nested.json_nodes(cell, 3)).alias("path", "data_type", "value"))


@query(
    "nested_paths_deep",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
t AS (SELECT event_id, k, concat('{"c":[', k, ',{"d":{"e":{"f":"x","g":[]}}}]}') AS b FROM e)
SELECT event_id, '(root)' AS path, 'dict' AS data_type, concat('{"a":[', k, ',{"b":', b, '}],"k":', k, '}') AS value FROM t UNION ALL
SELECT event_id, '(root)[''k'']', 'int', k FROM t UNION ALL
SELECT event_id, '(root)[''a'']', 'list', concat('[', k, ',{"b":', b, '}]') FROM t UNION ALL
SELECT event_id, '(root)[''a''][0]', 'int', k FROM t UNION ALL
SELECT event_id, '(root)[''a''][1]', 'dict', concat('{"b":', b, '}') FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b'']', 'dict', b FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c'']', 'list', concat('[', k, ',{"d":{"e":{"f":"x","g":[]}}}]') FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][0]', 'int', k FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][1]', 'dict', '{"d":{"e":{"f":"x","g":[]}}}' FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][1][''d'']', 'dict', '{"e":{"f":"x","g":[]}}' FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][1][''d''][''e'']', 'dict', '{"f":"x","g":[]}' FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][1][''d''][''e''][''f'']', 'str', '"x"' FROM t UNION ALL
SELECT event_id, '(root)[''a''][1][''b''][''c''][1][''d''][''e''][''g'']', 'list', '[]' FROM t""",
)
def nested_paths_deep(spark, sf):
    k = F.get_json_object("props", "$.k")
    cell = F.concat(F.lit('{"k": '), k, F.lit(', "a": ['), k, F.lit(', {"b": {"c": ['), k, F.lit(', {"d": {"e": {"f": "x", "g": []}}}]}}]}'))
    return columns.nested_paths(spread(table(spark, sf, "events"), "event_id"), cell, ["event_id"])


@query("get_by_path", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, NULL::varchar AS none FROM events")
def get_by_path(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", nested.get_by_path(F.col("props"), ["k"], "bigint").alias("k"), nested.get_by_path(F.col("props"), ["a", 0]).alias("none")
    )


@query(
    "set_by_path",
    with_views("instances") + "SELECT InstanceId, 'changed' AS Zone, 'default' AS Tenancy, 'new name' AS Name, RenderGroup FROM instances",
)
def set_by_path(spark, sf):
    rows = instances(spark, sf)
    place, tags = rows.schema["Placement"].dataType, rows.schema["Tags"].dataType
    new_place = nested.set_by_path(F.col("Placement"), place, ["AvailabilityZone"], F.lit("changed"))
    new_tags = nested.set_by_path(F.col("Tags"), tags, [1, "Value"], F.lit("new name"))
    changed = rows.withColumns({"Placement": new_place, "Tags": new_tags})
    return changed.select(
        "InstanceId", F.col("Placement.AvailabilityZone").alias("Zone"), F.col("Placement.Tenancy").alias("Tenancy"),
        nested.tag_value(F.col("Tags"), "Name").alias("Name"), nested.tag_value(F.col("Tags"), "renderGroup").alias("RenderGroup"),
    )


@query(
    "wrap_nested",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('["', o_orderstatus, '","more"]') ELSE '["more"]' END AS AS_LIST,
       CASE WHEN o_orderkey % 2 = 0 THEN concat('{"original_data":"', o_orderstatus, '","k":"v"}') ELSE '{"k":"v"}' END AS AS_MAP FROM orders""",
)
def wrap_nested(spark, sf):
    value = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.to_json(nested.append_item(nested.wrap_list(value), F.lit("more"))).alias("AS_LIST"),
        F.to_json(nested.append_key(nested.wrap_map(value), "k", F.lit("v"))).alias("AS_MAP"),
    )


@query(
    "display_value",
    "SELECT o_orderkey, o_orderstatus AS KEYED, concat(o_orderstatus, '/', o_orderpriority) AS LISTED, o_orderpriority AS EDITED FROM orders",
)
def display_value(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.create_map(F.lit("key"), F.col("o_orderstatus")).alias("m"), F.array("o_orderstatus", "o_orderpriority").alias("l")
    )
    kinds = {c: rows.schema[c].dataType for c in ("m", "l")}
    edited = nested.from_display(F.col("o_orderpriority"), F.col("m"), kinds["m"])
    return rows.select(
        "o_orderkey", nested.display_value(F.col("m"), kinds["m"]).alias("KEYED"), nested.display_value(F.col("l"), kinds["l"]).alias("LISTED"),
        nested.display_value(edited, kinds["m"]).alias("EDITED"),
    )


_TILES = """
WITH g AS (SELECT p_partkey, p_size AS ny, 1 + p_partkey % 4 AS nx, x, y FROM part, LATERAL (SELECT unnest(range(1 + p_partkey % 4)) AS x), LATERAL (SELECT unnest(range(p_size)) AS y))
"""


def tile_jobs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 4 + 1).alias("X_TILES"), F.col("p_size").alias("Y_TILES"))


def _tile_query(name, sql_tile, sql_row, traversal, origin):
    @query(name, _TILES + f"SELECT p_partkey, x AS COLUMN_NO, {sql_row} AS ROW_NO, {sql_tile} AS TILE FROM g")
    def tiles(spark, sf):
        grid = tables.tile_grid(tile_jobs(spark, sf), traversal, origin)
        return grid.select("p_partkey", F.col("COLUMN").cast("bigint").alias("COLUMN_NO"), F.col("ROW").alias("ROW_NO"), "TILE")

    return tiles


_tile_query("tile_grid", "y + x * ny", "y", "column_by_column", "top_left")
_tile_query("tile_grid_rows", "x + y * nx", "ny - 1 - y", "row_by_row", "bottom_left")
_tile_query("tile_grid_row_bounce", "CASE WHEN y % 2 = 0 THEN x ELSE nx - 1 - x END + y * nx", "y", "row_by_row_bounce", "top_left")
_tile_query("tile_grid_column_bounce", "CASE WHEN x % 2 = 0 THEN y ELSE ny - 1 - y END + x * ny", "ny - 1 - y", "column_by_column_bounce", "bottom_left")


@query(
    "tile_bounds",
    _TILES + """SELECT p_partkey, y + x * ny AS TILE, x * (1920 // nx) AS "LEFT", (1920 // nx) * (x + 1) - 1 + CASE WHEN x = nx - 1 THEN 1920 % nx ELSE 0 END AS "RIGHT",
  y * (1081 // ny) AS TOP, (1081 // ny) * (y + 1) - 1 + CASE WHEN y = ny - 1 THEN 1081 % ny ELSE 0 END AS BOTTOM FROM g WHERE y + x * ny IN (0, 1, 2, 7, 11)""",
)
def tile_bounds(spark, sf):
    jobs = tile_jobs(spark, sf).withColumns({"WIDTH": F.lit(1920), "HEIGHT": F.lit(1081)})
    return tables.tile_bounds(jobs, [0, 1, 2, 7, 11]).select("p_partkey", "TILE", *[F.col(c).cast("bigint").alias(c) for c in ("LEFT", "RIGHT", "TOP", "BOTTOM")])


@query(
    "metadata_entry",
    "SELECT o_orderkey, 'status' AS Key, o_orderstatus AS Value FROM orders",
)
def metadata_entry(spark, sf):
    pairs = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(pairs).alias("Key", "Value"))
    return tables.metadata_entry(rows, "status")


@query("typed_empty_columns", "SELECT c_name AS script, NULL::bigint AS size, NULL::double AS score FROM customer")
def typed_empty_columns(spark, sf):
    return tables.typed_empty_columns(table(spark, sf, "customer").select("c_name"), T.StructType.fromDDL("script string, size bigint, score double"))


@query(
    "embed_first_cell",
    "SELECT CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier) THEN 'print(1)' ELSE s_name END AS s_name, s_suppkey FROM supplier",
)
def embed_first_cell(spark, sf):
    return tables.embed_first_cell(table(spark, sf, "supplier").select("s_name", "s_suppkey"), "print(1)", "s_suppkey")

"""Paths as trees: ancestors, edges, ids, and paths rebuilt from edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import move_root, node_id
from pathloom.session import cut_lineage


def _prefix(parts: Column, n: Column) -> Column:
    joined = F.array_join(F.slice(parts, F.lit(1), n), "/")
    return F.when(joined.endswith(":"), F.concat(joined, F.lit("/"))).otherwise(joined)


def explode_ancestors(df: DataFrame, column: str = "FILE") -> DataFrame:
    """Every folder above a path with the rest of the path below it."""
    parts = F.split(F.col(column), "/")
    levels = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    rows = df.select(column, F.explode(levels).alias("LEVEL"))
    rest = F.slice(parts, F.col("LEVEL") + 1, F.size(parts))
    return rows.select(
        column, "LEVEL", _prefix(parts, F.col("LEVEL")).alias("ANCESTOR"), F.array_join(rest, "/").alias("REMAINDER")
    )


def link_levels(df: DataFrame, column: str = "PROVISIONEDLINK") -> DataFrame:
    """Each level of a link, from the empty root to the link itself."""
    text = F.regexp_replace(F.col(column), r"^\.", "")
    rooted = F.when(F.startswith(text, F.lit("/")), text).otherwise(F.concat(F.lit("/"), text))
    parts = F.split(rooted, "/")
    rows = df.select(column, parts.alias("__p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("LEVEL"))
    return rows.select(
        column, "LEVEL", F.array_join(F.slice("__p", F.lit(1), F.col("LEVEL")), "/").alias("PATH")
    )


def list_directories(df: DataFrame, column: str = "FILE", root: str = "", depth: int | None = None) -> DataFrame:
    """Distinct folders above the paths, below a root and down to a depth.

    Parent folders are made distinct before their ancestors are listed, so the rows grow with
    folders and not with files.
    """
    folder = F.regexp_replace(F.col(column), "/[^/]*$", "")
    folders = df.select(folder.alias("__d")).distinct()
    if root:
        base = root.rstrip("/")
        folders = folders.where(F.startswith(F.col("__d"), F.lit(base + "/")))
        folders = folders.withColumn("__d", F.substring("__d", F.lit(len(base) + 2), F.length("__d")))
    parts = F.split("__d", "/")
    most = F.size(parts) if depth is None else F.least(F.size(parts), F.lit(depth + (0 if root else 1)))
    up = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return folders.select(F.explode(up).alias("DIRECTORY")).where("DIRECTORY <> ''").distinct()


def tree_edges(df: DataFrame, column: str = "PROVISIONEDLINK") -> DataFrame:
    """Distinct parent and child paths with the short name of the child."""
    text = F.regexp_replace(F.col(column), r"^\.", "")
    rooted = F.when(F.startswith(text, F.lit("/")), text).otherwise(F.concat(F.lit("/"), text))
    paths = df.select(rooted.alias("__t")).where("__t is not null").distinct()
    parts = F.split("__t", "/")
    rows = paths.select(parts.alias("__p"), F.explode(F.sequence(F.lit(2), F.size(parts))).alias("__n"))
    head = F.slice("__p", F.lit(1), F.col("__n") - 1)
    short = F.element_at("__p", F.col("__n"))
    return (
        rows.select(
            F.array_join(head, "/").alias("parent"),
            F.array_join(F.slice("__p", F.lit(1), F.col("__n")), "/").alias("child"),
        )
        .distinct()
        .select(
            "parent", "child", F.element_at(F.split("child", "/"), -1).alias("short_name"),
            F.element_at(F.split("child", "/"), -1).alias("display_name"), F.lit(False).alias("is_expanded"),
        )
    )


def tree_ids(directories: DataFrame, column: str = "DIRECTORY", by_name: bool = False) -> DataFrame:
    """Hashed ids of folders and their parents, with names and schema field names.

    Ids hash the full paths of parent and folder. ``by_name`` gives the older form from the two
    names alone, where equal pairs at two places share an id. Top folders have the parent
    ``tree_root``.
    """
    path = F.col(column)
    parts = F.split(path, "/")
    n = F.size(parts)
    parent_path = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "/")
    name = F.element_at(parts, -1)
    parent_name = F.when(n > 1, F.get(parts, n - 2)).otherwise(F.lit("tree_root"))
    grand_name = F.when(n > 2, F.get(parts, n - 3)).otherwise(F.lit("tree_root"))
    if by_name:
        own = node_id(parent_name, name)
        above = node_id(grand_name, parent_name)
    else:
        own = node_id(F.when(n > 1, parent_path).otherwise(F.lit("tree_root")), path)
        grand_path = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "/")
        above = node_id(F.when(n > 2, grand_path).otherwise(F.lit("tree_root")), parent_path)
        above = F.when(n > 1, above).otherwise(node_id(F.lit("tree_root"), F.lit("tree_root")))
    return directories.select(path.alias("PATH"), own.alias("ID"), above.alias("PARENT_ID"), name.alias("NAME")).distinct().withColumn(
        "FIELD", F.concat_ws("-", "PARENT_ID", "ID", F.lit("dir"))
    )


def package_tree(links: DataFrame, dest: str = "DEST") -> DataFrame:
    """Nodes of a link package: folders above each destination and the files themselves.

    Ids hash name and path; ``KIND`` is ``dir`` or ``file``; ``FIELD`` is the schema field name.
    """
    parts = F.split("__t", "/")
    paths = links.select(F.col(dest).alias("__t")).where("__t is not null").distinct()
    rows = paths.select(parts.alias("__p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("__n"))
    size = F.size("__p")
    name = F.element_at("__p", F.col("__n"))
    path = F.array_join(F.slice("__p", F.lit(1), F.col("__n")), "/")
    folder = F.when(size > 1, F.get("__p", size - 2)).otherwise(F.lit(""))
    parent = F.when(F.col("__n") > 1, F.get("__p", F.col("__n") - 2))
    parent_path = F.array_join(F.slice("__p", F.lit(1), F.greatest(F.col("__n") - 1, F.lit(0))), "/")
    is_file = F.col("__n") == size
    return rows.select(
        F.when(is_file, node_id(folder, name)).otherwise(node_id(name, path)).alias("ID"),
        F.when(F.col("__n") > 1, node_id(parent, parent_path)).alias("PARENT_ID"),
        name.alias("NAME"), path.alias("PATH"),
        F.when(is_file, F.lit("file")).otherwise(F.lit("dir")).alias("KIND"),
    ).distinct().withColumn("FIELD", F.concat_ws("-", "NAME", "KIND"))


def dest_fields(links: DataFrame, dest: str = "DEST", src: str = "SRC") -> DataFrame:
    """File field of each destination with its hashed id, made from the row if it has none."""
    known = F.col("HASHEDFILE") if "HASHEDFILE" in links.columns else F.lit(None).cast("string")
    made = F.coalesce(known, node_id(F.col(dest), F.col(src)))
    return links.select(F.concat(F.col(dest), F.lit("-file")).alias("FIELD"), made.alias("HASHEDFILE"))


def tree_paths(edges: DataFrame, root: str = "") -> DataFrame:
    """Full path of every node from ``(PARENT_ID, ID, NAME)`` rows; ids are unique.

    Each round lets a node jump to the node its ancestor points at, so the covered depth
    doubles: 64 levels take six joins. Rounds go on until no node points upwards any more, and
    each is checkpointed. A round in which no node arrives means that ids form a cycle: an error.
    """
    parents = edges.select(F.col("ID").alias("__id")).distinct()
    known = edges.join(parents, F.col("PARENT_ID") == F.col("__id"), "left")
    state = known.select("ID", F.col("__id").alias("UP"), F.col("NAME").alias("PATH"))
    before = None
    while True:
        state = cut_lineage(state)
        left = state.where("UP is not null").count()
        if not left:
            break
        if left == before:
            raise ValueError(f"{left} nodes are below a cycle of ids")
        before = left
        above = state.select(F.col("ID").alias("__id"), F.col("UP").alias("__up"), F.col("PATH").alias("__path"))
        # nodes that have arrived are not joined, so the top nodes are no hot key
        moving = state.where("UP is not null").join(above, F.col("UP") == F.col("__id"))
        moved = moving.select("ID", F.col("__up").alias("UP"), F.concat_ws("/", "__path", "PATH").alias("PATH"))
        state = moved.unionByName(state.where("UP is null"))
    shown = F.concat(F.lit(root.rstrip("/") + "/"), F.col("PATH")) if root else F.col("PATH")
    return state.select("ID", shown.alias("PATH"))


def collect_tree(edges: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """Children of each parent as a JSON list of ids and names."""
    from pathloom.operators.grouping import chunked_lists, spread

    child = F.struct(F.col("ID").alias("id"), F.col("NAME").alias("name"))
    lists = chunked_lists(
        edges, ["PARENT_ID"], child, "__l", [spread(F.col("NAME"), F.col("ID"))],
        [F.col("NAME"), F.col("ID")], chunk_rows,
    )
    by_name = F.array_sort(F.transform("__l", lambda c: F.struct(c["name"].alias("name"), c["id"].alias("id"))))
    as_json = F.to_json(F.transform(by_name, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"))))
    return lists.select("PARENT_ID", "CHUNK", as_json.alias("CHILDREN"))


def parent_child_names(edges: DataFrame, top: str = "Data_root") -> DataFrame:
    """Name of the parent next to each child."""
    names = edges.select(F.col("ID").alias("__id"), F.col("NAME").alias("__n")).distinct()
    joined = edges.join(names, F.col("PARENT_ID") == F.col("__id"), "left")
    return joined.select(F.coalesce("__n", F.lit(top)).alias("PARENT"), F.col("NAME").alias("CHILD"))


def add_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """New nodes added below existing parents; known ids are not added twice."""
    return edges.unionByName(nodes.join(edges.select("ID"), "ID", "left_anti").select(*edges.columns))


def replica_paths(df: DataFrame, root: str, new_root: str, column: str = "DIRECTORY") -> DataFrame:
    return df.withColumn(column, move_root(F.col(column), root, new_root))


def decompose_and_join(df: DataFrame, column: str = "FILE") -> DataFrame:
    """Rows with each of their ancestors, computed in place instead of joined back."""
    parts = F.split(F.col(column), "/")
    levels = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    rows = df.withColumn("LEVEL", F.explode_outer(levels))
    return rows.withColumns(
        {
            "ANCESTOR": _prefix(parts, F.col("LEVEL")),
            "REMAINDER": F.array_join(F.slice(parts, F.col("LEVEL") + 1, F.size(parts)), "/"),
        }
    )

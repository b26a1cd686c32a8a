"""Grouped counts, sums and lists. Sums combine before the shuffle; lists come in chunks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.similarity import edit_distance
from pathloom.operators.grouping import CHUNK_ROWS, chunked_lists, number_rows, spread


def count_states(jobs: DataFrame, column: str = "JobStatus") -> DataFrame:
    """Queued and running farm jobs."""
    state = F.lower(F.col(column))
    return jobs.agg(
        F.count_if(state == "queued").alias("QUEUED"), F.count_if(state == "rendering").alias("RUNNING")
    )


def sum_by_frame(df: DataFrame, frame: str = "Frames", time: str = "RENDERTIME") -> DataFrame:
    return df.groupBy(frame).agg(F.sum(time).alias(time))


def sum_by_layer_frame(
    df: DataFrame, layer: str = "LAYER", frame: str = "Frames", time: str = "RENDERTIME"
) -> DataFrame:
    """Sums per layer and frame, and over all layers under the name ``Aggregated``.

    Layers are added up first; the total is taken from those few sums, so rows are read once
    and not doubled.
    """
    per_layer = df.groupBy(layer, frame).agg(F.sum(time).alias(time))
    return per_layer.groupingSets(
        [[F.col(layer), F.col(frame)], [F.col(frame)]], layer, frame
    ).agg(
        F.grouping(layer).alias("__all"), F.sum(time).alias("__sum")
    ).select(
        F.when(F.col("__all") == 1, F.lit("Aggregated")).otherwise(F.col(layer)).alias(layer),
        frame, F.col("__sum").alias(time),
    )


def signed_counts(df: DataFrame, region: str = "Region", kind: str = "InstanceType", state: str = "State_Name") -> DataFrame:
    """Running minus stopped instances per region and type."""
    name = F.lower(F.col(state))
    sign = F.when(name == "running", 1).when(name == "stopped", -1).otherwise(0)
    return df.groupBy(region, kind).agg(F.sum(sign).alias("COUNT"))


def grouped_view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts of every grouping level, the most detailed counted first."""
    leaves = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    return leaves.rollup(*columns).agg(
        F.sum("__n").alias("ROWS"), F.grouping_id(*columns).alias("LEVEL")
    )


def series_by_name(
    df: DataFrame, name: str = "FILENAME", ext: str = "DOTEXTENSION", frame: str = "FRAMENUMBER",
    values: Sequence[str] = ("FILESIZE_MB",), chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows of each ``name.ext`` as lists ordered by frame."""
    rows = df.withColumn("SERIES", F.concat_ws(".", name, ext))
    row = F.struct(frame, *values)
    return chunked_lists(
        rows, ["SERIES"], row, "POINTS",
        [F.floor(F.col(frame) / 4096), F.col(frame), spread(F.to_json(F.struct(*values)))],
        [F.col(v) for v in values], chunk_rows,
    )


def frame_labels(df: DataFrame, frame: str = "FRAMENUMBER") -> DataFrame:
    """Distinct frame labels in order."""
    return df.select(frame).where(F.col(frame).isNotNull()).distinct().orderBy(frame)


def highest_version(log: DataFrame, item: str = "item", version: str = "VERSION", date: str | None = None) -> DataFrame:
    """Highest version per item; unreadable versions are skipped, 0 if none is left."""
    rows = log if date is None else log.where(F.col("date") == date)
    return rows.groupBy(item).agg(
        F.coalesce(F.max(F.trim(F.col(version).cast("string")).try_cast("int")), F.lit(0)).alias("HIGHEST")
    )


def next_suffix(names: DataFrame, prefix: str, column: str = "NAME") -> DataFrame:
    """Unique name: prefix and the highest ``-NNN`` suffix plus one."""
    name = F.col(column)
    number = F.element_at(F.split(name, "-"), -1)
    taken = F.startswith(name, F.lit(prefix)) & F.contains(name, F.lit("-"))
    highest = names.agg(
        F.coalesce(F.max(F.when(taken, F.trim(number).try_cast("int"))), F.lit(0)).alias("__h")
    )
    text = (F.col("__h") + 1).cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(3)), "0")
    return highest.select(F.concat(F.lit(prefix + "-"), padded).alias("NAME"))


def next_suffixes(names: DataFrame, prefixes: DataFrame, column: str = "NAME") -> DataFrame:
    """The same for a table of prefixes that end before the last ``-`` of a name."""
    stem = F.regexp_replace(F.col(column), r"-[^-]*$", "")
    number = F.element_at(F.split(F.col(column), "-"), -1)
    highest = (
        names.where(F.contains(F.col(column), F.lit("-")))
        .groupBy(stem.alias("__stem")).agg(F.max(F.trim(number).try_cast("int")).alias("__h"))
    )
    joined = prefixes.join(highest, F.col("PREFIX") == F.col("__stem"), "left")
    text = (F.coalesce("__h", F.lit(0)) + 1).cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(3)), "0")
    return joined.select("PREFIX", F.concat(F.col("PREFIX"), F.lit("-"), padded).alias("NAME"))


def total_size(paths: DataFrame) -> DataFrame:
    """Size of paths that are no duplicates, in all and on another file system."""
    single = ~F.coalesce(F.col("ISDUPLICATE"), F.lit(False))
    cross = single & ~F.coalesce(F.col("ISDESTFSMATCH"), F.lit(True))
    return paths.agg(
        F.coalesce(F.sum(F.when(single, F.col("SIZE"))), F.lit(0)).alias("TOTALSIZE"),
        F.coalesce(F.sum(F.when(cross, F.col("SIZE"))), F.lit(0)).alias("CROSSSIZE"),
    )


def latest_scan_time(lists: DataFrame, directory: str = "DIRECTORY", time: str = "SCANTIME") -> DataFrame:
    return lists.groupBy(directory).agg(F.max(time).alias(time))


# Id field of each kind of object.
ID_FIELDS = {"ec2_instances": "InstanceId", "auto_scaling_groups": "ASGName"}


def group_ids_by_region(
    df: DataFrame, object_type: str, id_column: str, region: str = "Region", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Lists of ids per region for one kind of object."""
    if object_type not in ID_FIELDS:
        raise ValueError(f"unknown object type {object_type!r}")
    entry = F.struct(F.col(id_column).alias(ID_FIELDS[object_type]))
    return chunked_lists(
        df, [region], entry, "IDS", [spread(F.col(id_column))], [F.col(id_column)], chunk_rows
    )


def distinct_combos(df: DataFrame, columns: Sequence[str], drop_nulls: bool = False) -> DataFrame:
    rows = df.select(*columns)
    return (rows.dropna() if drop_nulls else rows).distinct()


def deepest_common_parent(df: DataFrame, column: str = "FILE") -> DataFrame:
    """Longest folder above every path.

    What the smallest and the largest path share, all paths share; so two values are enough.
    """
    folders = df.select(F.slice(F.split(F.col(column), "/"), F.lit(1), F.size(F.split(F.col(column), "/")) - 1).alias("__p"))
    ends = folders.agg(F.min("__p").alias("__a"), F.max("__p").alias("__b"))
    same = F.zip_with("__a", "__b", lambda a, b: F.coalesce(a == b, F.lit(False)))
    fork = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(fork == 0, F.size("__a")).otherwise(fork - 1)
    joined = F.array_join(F.slice("__a", F.lit(1), n), "/")
    drive = F.when(joined.endswith(":"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return ends.select(drive.alias("PARENT"))


def collapse_choices(
    df: DataFrame, key: str, choice: str, status: str = "STATUS", chunk_rows: int = CHUNK_ROWS,
    distance: Callable[[Column, Column], Column] = edit_distance,
) -> DataFrame:
    """Choices of a key in one text, valid ones first, the others by likeness to the key.

    Likeness is the edit distance unless another one is given. ``CHUNK`` is above 0 only for keys with more
    choices than one text holds.
    """
    rows = df.withColumns(
        {
            "__open": F.when(F.coalesce(F.trim(F.col(status)), F.lit("pending")) == "valid", 0).otherwise(1),
            "__text": F.col(choice).cast("string"),
        }
    )
    rows = rows.withColumn("__far", distance(F.col(key).cast("string"), F.col("__text")))
    far = F.when(F.col("__open") == 1, F.col("__far")).otherwise(0)
    lists = chunked_lists(
        rows, [key], F.col("__text"), "__l", [F.col("__open"), far, spread(F.col("__text"))],
        [F.col("__text")], chunk_rows,
    )
    return lists.select(key, F.array_join("__l", ", ").alias(choice), "CHUNK")


def tree_hash(paths: DataFrame, column: str = "FILE") -> DataFrame:
    """One hash over the set of directories, whatever their order.

    The SHA-256 of each distinct directory is split into four numbers that are added up, so
    the hash is built from partial sums and no list of directories is needed.
    """
    digest = F.sha2(F.col("__d"), 256)
    parts = {
        f"__s{i}": F.sum(
            F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)") % F.lit(10**18)
        )
        for i in range(4)
    }
    sums = paths.select(F.col(column).alias("__d")).where("__d is not null").distinct().agg(
        F.count(F.lit(1)).alias("DIRECTORIES"), *[v.alias(k) for k, v in parts.items()]
    )
    text = F.concat_ws(":", F.col("DIRECTORIES").cast("string"), *[F.col(k).cast("string") for k in parts])
    return sums.select("DIRECTORIES", F.sha2(text, 256).alias("TREE_HASH"))


def tree_changed(paths: DataFrame, saved: str, column: str = "FILE") -> DataFrame:
    return tree_hash(paths, column).select((F.col("TREE_HASH") != saved).alias("CHANGED"))


def sub_items(table: DataFrame, items: DataFrame, item: str = "item", sub_item: str = "sub_item") -> DataFrame:
    """Sub-items of the asked items; an item without any gives a row with a problem text."""
    listed = table.where(F.coalesce(F.col(sub_item), F.lit("")) != "").select(
        F.col(item).alias("__i"), sub_item
    )
    joined = items.select(item).join(listed, F.col(item) == F.col("__i"), "left")
    problem = F.when(F.col("__i").isNull(), F.lit("no sub-items"))
    return joined.select(item, sub_item, problem.alias("PROBLEM"))


def path_groups(nodes: DataFrame, path: str = "path", first: Mapping[str, Column] | None = None) -> DataFrame:
    """Entries of each path: how many there are, and the first by its values."""
    rest = [c for c in nodes.columns if c != path]
    return nodes.groupBy(path).agg(
        F.count(F.lit(1)).alias("ENTRIES"), F.min(F.struct(*rest)).alias("FIRST_ENTRY")
    )


def files_by_directory(df: DataFrame, blacklist: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS, column: str = "FILE", root: str = "") -> DataFrame:
    """Names of the files of each directory as sorted lists; the top is called ``Root``."""
    path = F.col(column)
    base = root.rstrip("/") + "/" if root else ""
    inner = F.substring(path, F.lit(len(base) + 1), F.length(path)) if base else path
    name = F.element_at(F.split(path, "/"), -1)
    rows = df.where(F.startswith(path, F.lit(base))) if base else df
    for text in blacklist:
        rows = rows.where(~F.contains(name, F.lit(text)))
    folder = F.regexp_replace(inner, "/?[^/]*$", "")
    rows = rows.select(
        F.when(folder == "", F.lit("Root")).otherwise(folder).alias("DIRECTORY"), name.alias("NAME")
    )
    lists = chunked_lists(rows, ["DIRECTORY"], F.col("NAME"), "FILES", [spread(F.col("NAME"))], [F.col("NAME")], chunk_rows)
    return lists.withColumn("FILES", F.array_sort("FILES"))


def directory_columns(df: DataFrame, directories: Sequence[str]) -> DataFrame:
    """Wide form for chosen directories: one column each, one file name per row."""
    numbered = number_rows(
        df.where(F.col("DIRECTORY").isin(list(directories))), ["DIRECTORY"],
        [spread(F.col("NAME"))], [F.col("NAME")], "ROW_NO",
    )
    wide = numbered.groupBy("ROW_NO").pivot("DIRECTORY", list(directories)).agg(F.first("NAME"))
    return wide.fillna("")

"""Joins: status, keys, shots and projects, destinations, snapshots.

No join size is guessed: small sides are broadcast by Spark from their measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import base_name, extension_group
from pathloom.operators.grouping import chunked_lists, salted_join, spread
from pathloom.operators.matching import best_match, with_best


def join_status(left: DataFrame, right: DataFrame, key: str, suffix: str = "_vSTATUS") -> DataFrame:
    """Left join on a key; columns of the right side that clash get a suffix."""
    renamed = right.select(
        *[
            F.col(f"`{c}`").alias("__k" if c == key else c + suffix if c in left.columns else c)
            for c in right.columns
        ]
    )
    return left.join(renamed, F.col(f"`{key}`") == F.col("__k"), "left").drop("__k")


def anti_by_normalized_key(new: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """New rows whose trimmed, lower-cased key is not known yet."""
    known = existing.select(F.lower(F.trim(F.col(column).cast("string"))).alias("__k")).distinct()
    return new.join(known, F.lower(F.trim(F.col(column).cast("string"))) == F.col("__k"), "left_anti")


def orphans(
    instances: DataFrame, known: DataFrame, id_column: str = "InstanceId",
    state: str = "State_Name", group: str = "RenderGroup",
) -> DataFrame:
    """Running instances with a render group whose id is not in the known set."""
    running = instances.where((F.col(state) == "running") & (F.coalesce(F.col(group), F.lit("")) != ""))
    ids = known.select(F.trim(F.col(known.columns[0])).alias("__id")).distinct()
    return running.withColumn(id_column, F.trim(F.col(id_column))).join(
        ids, F.col(id_column) == F.col("__id"), "left_anti"
    )


def assign_project(df: DataFrame, client: str, project: str) -> DataFrame:
    """Client and project set where the path holds the project as a whole word."""
    quoted = "\\Q" + project + "\\E"
    hit = F.coalesce(F.col("FILE").rlike(rf"\b{quoted}\b"), F.lit(False))
    blank = F.lit("")
    return df.withColumns(
        {
            "CLIENT": F.when(hit, F.lit(client)).otherwise(blank),
            "PROJECT": F.when(hit, F.lit(project)).otherwise(blank),
            "SHOTNAME": blank,
        }
    )


def assign_projects(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """The same for a table of ``CLIENT, PROJECT`` rows; the last one by name wins."""
    best = best_match(
        df, ["FILE"], jobs, "PROJECT", ["PROJECT", "CLIENT"], ["CLIENT", "PROJECT"], whole_word=True
    )
    joined = with_best(df.drop("CLIENT", "PROJECT"), best, ["FILE"])
    blank = F.lit("")
    return joined.withColumns(
        {"CLIENT": F.coalesce("__best.CLIENT", blank), "PROJECT": F.coalesce("__best.PROJECT", blank)}
    ).drop("__best")


def has_project() -> Column:
    return F.coalesce(F.col("PROJECT"), F.lit("")) != ""


def assign_shot(df: DataFrame, shots: DataFrame, order: Sequence[str] = ("SHOTNAME",), winner: str = "last") -> DataFrame:
    """Shot whose name occurs in the path of rows with a project; one shot wins by order."""
    best = best_match(df.where(has_project()), ["FILE"], shots, "SHOTNAME", order, ["SHOTNAME"], winner)
    joined = with_best(df, best, ["FILE"], has_project())
    return joined.withColumn("SHOTNAME", F.coalesce("__best.SHOTNAME", F.lit(""))).drop("__best")


def assign_alt_shot(
    df: DataFrame, shots: DataFrame, order: Sequence[str] = ("SHOTNAME",), only_unassigned: bool = True,
) -> DataFrame:
    """Shot by its alternate name, any case; matched rows are marked ``yes``."""
    open_rows = has_project()
    if only_unassigned:
        open_rows &= F.coalesce(F.col("SHOTNAME"), F.lit("")) == ""
    best = best_match(
        df.where(open_rows), ["FILE"], shots, "ALTSHOTNAME", order, ["SHOTNAME"], ignore_case=True
    )
    joined = with_best(df, best, ["FILE"], open_rows)
    mark = F.col("ALTSHOTNAME") if "ALTSHOTNAME" in df.columns else F.lit("")
    return joined.withColumns(
        {
            "SHOTNAME": F.coalesce("__best.SHOTNAME", F.col("SHOTNAME")),
            "ALTSHOTNAME": F.when(F.col("__best.SHOTNAME").isNotNull(), F.lit("yes")).otherwise(mark),
        }
    ).drop("__best")


def assign_shot_multi(
    df: DataFrame, shots: DataFrame, prefix: str, order: Sequence[str] = ("SHOTNAME",),
    columns: Sequence[str] = ("FILE", "SEQUENCE", "LINK"),
) -> DataFrame:
    """Shot without its prefix found in several columns: first shot per column, last column wins.

    All columns are searched in one pass and joined back once.
    """
    current = F.col("SHOTNAME") if "SHOTNAME" in df.columns else F.lit("")
    searched = [c for c in columns if c in df.columns]
    if not searched:
        return df.withColumn("SHOTNAME", F.coalesce(current, F.lit("")))
    stripped = shots.withColumn("__name", F.replace(F.col("SHOTNAME"), F.lit(prefix), F.lit("")))
    best = best_match(df, searched, stripped, "__name", order, ["SHOTNAME"], "first")
    joined = with_best(df, best, searched)
    return joined.withColumn("SHOTNAME", F.coalesce("__best.SHOTNAME", current, F.lit(""))).drop("__best")


def thumb_lookup(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Thumbnail name by extension: made from the item name, or the default icon."""
    known = defaults.select(
        F.lower("DOTEXTENSION").alias("__ext"),
        F.col("THUMBNAILTYPE").alias("__type"), F.col("DEFAULTTHUMBNAME").alias("__icon"),
    )
    ext = F.lower(F.col("DOTEXTENSION"))
    made = F.replace(F.col("ITEMNAME"), F.concat(F.lit("."), ext), F.lit("_thumbnail.png"))
    name = (
        F.when(F.col("__type") == "thumb", made)
        .when(F.col("__type") == "icon", F.col("__icon")).otherwise(F.lit(""))
    )
    keyed = df.withColumn("__own", ext)
    joined = salted_join(keyed, known, "__own", "__ext", "left")
    return joined.withColumn("THUMBNAME", name).drop("__own", "__ext", "__type", "__icon")


def fixed_thumbs(item: Column, ext: Column) -> Column:
    """Thumbnail name from the built-in rules."""
    # Extensions with a built-in thumbnail rule.
    made = item
    for movie in (".mov", ".mp4"):
        made = F.replace(made, F.lit(movie), F.lit("_thumbnail.png"))
    return (
        F.when(ext.isin("mov", "mp4"), made)
        .when(ext == "nk", F.lit("NukeApp256.png"))
        .when(ext == "ma", F.lit("ma.png"))
        .when(ext == "mb", F.lit("mb.png"))
        .otherwise(F.lit(""))
    )


def destination_options(templates: DataFrame, extensions: DataFrame, leaf: str = "DEST") -> DataFrame:
    """Long form: every template leaf whose base name holds an extension, as ``EXT, OPTION``."""
    leaves = templates.select(F.col(leaf).alias("OPTION")).distinct().withColumn(
        "__name", F.lower(base_name(F.col("OPTION")))
    )
    size = F.length("__name")
    leaves = leaves.withColumn("__longest", extensions.agg(F.max(F.length("EXT"))).scalar())
    at = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    dots = F.filter(at, lambda i: F.substring(F.col("__name"), i, F.lit(1)) == ".")
    parts = F.flatten(
        F.transform(
            dots,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(size - i + 1, F.coalesce("__longest", F.lit(1)))),
                lambda n: F.substring(F.col("__name"), i, n),
            ),
        )
    )
    cut = leaves.select("OPTION", F.explode(F.array_distinct(parts)).alias("EXT"))
    return cut.join(extensions, "EXT", "left_semi")


def match_destinations(sources: DataFrame, templates: DataFrame, leaf: str = "DEST") -> DataFrame:
    """Template leaves that fit the extension of each source.

    ``DESTOPTIONS`` lists them; ``DEST`` is set if there is exactly one. Options are worked out
    once per extension, not per source. ``OPTION_CHUNK`` is above 0 only for extensions with
    more options than one list holds.
    """
    rows = sources.withColumn("__ext", extension_group(F.col("SRC")))
    extensions = rows.select(F.col("__ext").alias("EXT")).distinct()
    options = destination_options(templates, extensions, leaf)
    lists = chunked_lists(
        options, ["EXT"], F.col("OPTION"), "__options", [spread(F.col("OPTION"))], [F.col("OPTION")]
    ).withColumn("__options", F.array_sort("__options"))
    counts = options.groupBy(F.col("EXT").alias("__e")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("OPTION").alias("__only")
    )
    known = lists.join(counts, F.col("EXT") == F.col("__e")).drop("__e")
    joined = salted_join(rows, known, "__ext", "EXT", "left")
    current = F.col("DEST") if "DEST" in sources.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "DEST": F.when(F.col("__n") == 1, F.col("__only")).otherwise(current),
            "DESTOPTIONS": F.array_join("__options", ", "),
            "OPTION_CHUNK": F.coalesce("CHUNK", F.lit(0)),
        }
    ).drop("__ext", "EXT", "CHUNK", "__options", "__n", "__only")


def semi_anti_split(df: DataFrame, key: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the names, and the others."""
    known = names.select(F.col(names.columns[0]).alias("__n")).where("__n is not null").distinct()
    on = F.col(key) == F.col("__n")
    return df.join(known, on, "left_semi"), df.join(known, on, "left_anti")


def map_tasks(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task ids of wanted ``(JobId, Frame)`` pairs, as lists per job; first task per frame."""
    first = tasks.groupBy(F.col("JobId").alias("__j"), F.col("TaskFrameList").alias("__f")).agg(
        F.min("TaskId").alias("TaskId")
    )
    hits = wanted.join(
        first, (F.col("JobId") == F.col("__j")) & (F.col("Frame").cast("string") == F.col("__f"))
    ).select("JobId", "Frame", "TaskId")
    return chunked_lists(
        hits, ["JobId"], F.col("TaskId"), "TASKS",
        [F.floor(F.col("Frame") / 4096), F.col("Frame")], [F.col("TaskId")],
    )


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or updated between two snapshots with unique keys.

    Both sides are stacked and folded per key, which combines before the shuffle. ``CHANGE`` is
    ``added``, ``removed`` or ``updated``; the values are the new ones where there are any.
    """
    values = [c for c in new.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in values]) if values else F.struct(F.lit(1).alias("__one"))
    sides = old.select(*keys, F.lit(0).alias("__side"), row.alias("__row")).unionByName(
        new.select(*keys, F.lit(1).alias("__side"), row.alias("__row"))
    )
    folded = sides.groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == 0, F.struct(F.lit(1).alias("f"), F.col("__row").alias("r")))).alias("__old"),
        F.max(F.when(F.col("__side") == 1, F.struct(F.lit(1).alias("f"), F.col("__row").alias("r")))).alias("__new"),
    )
    change = (
        F.when(F.col("__old").isNull(), F.lit("added"))
        .when(F.col("__new").isNull(), F.lit("removed"))
        .when(~F.col("__old").eqNullSafe(F.col("__new")), F.lit("updated"))
    )
    kept = folded.withColumn("CHANGE", change).where("CHANGE is not null")
    shown = F.coalesce(F.col("__new.r"), F.col("__old.r"))
    return kept.withColumn("__shown", shown).select(*keys, *[F.col(f"__shown.{c}") for c in values], "CHANGE")


def apply_diff(old: DataFrame, diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old snapshot with a diff applied."""
    touched = diff.select(*[F.col(k).alias(f"__d{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"__d{i}")) for i, k in enumerate(keys)]
    kept = old.join(touched, same, "left_anti")
    return kept.unionByName(diff.where("CHANGE <> 'removed'").select(*old.columns))


def prefix_duplicates(paths: DataFrame, column: str = "PATH", name: str = "ISDUPLICATE") -> DataFrame:
    """Marks paths that lie under another listed path.

    Each distinct parent folder is compared with its own ancestors, so no path meets every
    other one.
    """
    parts = F.split(F.col("__dir"), "/")
    listed = paths.groupBy(F.regexp_replace(F.col(column), "/+$", "").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    folders = paths.select(_parent(F.col(column)).alias("__dir")).distinct()
    up = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    own = F.col("__up") == F.col("__dir")
    above = (
        folders.withColumn("__up", F.explode(up))
        .join(listed, F.col("__up") == F.col("__p"))
        .groupBy(F.col("__dir").alias("__d"))
        .agg(F.sum(F.when(own, 0).otherwise(1)).alias("__over"), F.sum(F.when(own, F.col("__n"))).alias("__same"))
    )
    joined = paths.join(above, _parent(F.col(column)) == F.col("__d"), "left")
    # a path with a trailing slash counts as its own folder and must not find itself
    itself = F.when(F.endswith(F.col(column), F.lit("/")), 1).otherwise(0)
    hit = (F.col("__over") > 0) | (F.coalesce("__same", F.lit(0)) > itself)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__d", "__over", "__same")


def _parent(path: Column) -> Column:
    """Folder above a path; a trailing slash makes the path its own folder."""
    return F.regexp_replace(path, "/[^/]*$", "")


def placement_scores(scores: DataFrame, instance_type: str = "InstanceType", region: str = "Region") -> DataFrame:
    """Zone scores of each type, one row per zone, tagged with the region."""
    return scores.select(F.col(instance_type), F.col(region), F.inline("SpotPlacementScores"))


def link_row_lookup(fields: DataFrame, package: DataFrame, id_column: str = "HASHEDFILE") -> DataFrame:
    """First package row for each field that carries a hashed id.

    ``fields`` has ``FIELD`` and the id. Rows that share an id are ordered by their values.
    """
    rest = [c for c in package.columns if c != id_column]
    rows = package.groupBy(F.col(id_column).alias("__id")).agg(F.min(F.struct(*rest)).alias("__row"))
    tagged = fields.where(F.col(id_column).isNotNull())
    return tagged.join(rows, F.col(id_column) == F.col("__id")).select("FIELD", id_column, "__row.*")

"""Row filters. All are plain predicates or key joins, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import base_name, split_extension
from pathloom.functions.paths import glob_to_regex


def drop_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows without the value; nulls stay."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def drop_containing_any(df: DataFrame, column: str, texts: Sequence[str]) -> DataFrame:
    """Rows whose text holds none of the literals; nulls stay."""
    hits = [F.contains(F.col(column), F.lit(t)) for t in texts]
    return df.where(~F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False)))


def keep_in(df: DataFrame, column: str, values: Sequence[object] | DataFrame) -> DataFrame:
    """Rows whose column is in a list; a DataFrame of values is joined."""
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias("__v")).distinct()
        return df.join(wanted, F.col(column) == F.col("__v"), "left_semi")
    return df.where(F.col(column).isin(list(values)))


def search_text(df: DataFrame, column: str, text: str, regex: bool = False) -> DataFrame:
    """Case-insensitive search; a blank text keeps every row."""
    if not text:
        return df
    if regex:
        return df.where(F.col(column).rlike("(?i)" + text))
    return df.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def keep_truthy(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")


def keep_falsy(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) == "")


def filter_underscore(df: DataFrame, keep: bool = False, object_type: str = "dirs", item: str = "Item") -> DataFrame:
    """Names with a leading underscore kept or dropped, for directories, files or all."""
    if "OBJECTTYPE" not in df.columns:
        raise ValueError("an OBJECTTYPE column is needed")
    under = F.startswith(F.col(item), F.lit("_"))
    wanted = under if keep else ~under
    kinds = {"dirs": "Directory", "files": "File"}
    if object_type == "all":
        return df.where(wanted)
    if object_type not in kinds:
        raise ValueError(f"unknown object type {object_type!r}")
    return df.where((F.col("OBJECTTYPE") != kinds[object_type]) | wanted)


def filter_extension(
    df: DataFrame, column: str = "Item", target: str = "DISPLAYNAME",
    extensions: Sequence[str] | None = None, keep: bool = True,
) -> DataFrame:
    """Name without extension in ``target``; rows kept or dropped by extension."""
    name, ext = split_extension(F.col(column))
    out = df
    if extensions:
        listed = ext.isin(list(extensions))
        out = out.where(listed if keep else ~listed)
    return out.withColumn(target, name)


def drop_state(df: DataFrame, column: str = "State", state: str = "terminated") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(state))) if column in df.columns else df


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path or one of its parent folders matches a wildcard pattern."""
    hits = [path.rlike(glob_to_regex(p)) for p in patterns]
    # an excluded folder hides everything below it
    hits += [path.rlike(glob_to_regex(p.rstrip("/") + "/*")) for p in patterns]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def exclude_patterns(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    return df.where(~F.coalesce(matches_any(F.col(column), patterns), F.lit(False)))


def delete_by_keys(
    df: DataFrame, deletions: DataFrame, file: str = "FILE", sequence: str = "SEQUENCENAME"
) -> DataFrame:
    """Rows whose file and whose sequence are both absent from the deletion table.

    Blank and null keys delete nothing.
    """
    for column in (file, sequence):
        df = _drop_keys(df, column, _keys(deletions, column))
    return df


def _keys(deletions: DataFrame, column: str) -> DataFrame:
    return deletions.select(F.col(column).alias("__k")).where("coalesce(__k, '') <> ''").distinct()


def _drop_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Anti join in which the many rows with a blank key do not meet in one task.

    They are dealt out by a number, which is shuffled in place of a second, marked text.
    """
    text = F.col(column).cast("string")
    blank = F.coalesce(text, F.lit("")) == ""
    dealt = df.withColumn("__deal", F.when(blank, F.spark_partition_id()).otherwise(F.lit(-1)))
    known = keys.select(F.col("__k").cast("string").alias("__k"), F.lit(-1).alias("__of"))
    return dealt.join(known, (text == F.col("__k")) & (F.col("__deal") == F.col("__of")), "left_anti").drop("__deal")


def delete_by_keys_fallback(
    df: DataFrame, deletions: DataFrame, file: str = "FILE", sequence: str = "SEQUENCENAME"
) -> DataFrame:
    """Rows deleted by file; by sequence only if no file matched at all."""
    files = _keys(deletions, file)
    matched = df.join(files, F.col(file) == F.col("__k"), "left_semi").limit(1)
    any_match = matched.agg((F.count(F.lit(1)) > 0).alias("__m"))
    open_sequences = _keys(deletions, sequence).where(~any_match.scalar())
    return _drop_keys(_drop_keys(df, file, files), sequence, open_sequences)


def deleted_by_keys(
    df: DataFrame, deletions: DataFrame, file: str = "FILE", sequence: str = "SEQUENCENAME", fallback: bool = False
) -> DataFrame:
    """The rows that ``delete_by_keys`` or ``delete_by_keys_fallback`` leave out, once each.

    Blank keys match nothing, so the many rows that have them take no part in the joins.
    """
    def hit(column: str, keys: DataFrame) -> DataFrame:
        return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").join(keys, F.col(column) == F.col("__k"), "left_semi")

    files, sequences = _keys(deletions, file), _keys(deletions, sequence)
    by_file = hit(file, files)
    if fallback:
        none = by_file.limit(1).agg((F.count(F.lit(1)) == 0).alias("__m"))
        return by_file.unionByName(hit(sequence, sequences.where(none.scalar())))
    other = hit(sequence, sequences)
    named = files.withColumnRenamed("__k", "__f")
    return by_file.unionByName(other.join(named, F.col(file) == F.col("__f"), "left_anti"))


def lookup_first(
    df: DataFrame, term: str, column: str, returned: str, order_by: Sequence[str]
) -> DataFrame:
    """The returned column of the first row whose text holds the term."""
    hits = df.where(F.contains(F.col(column), F.lit(term)))
    return hits.orderBy(*order_by).limit(1).select(returned)


def get_sequence(df: DataFrame, name: str, column: str = "SEQUENCENAME") -> DataFrame:
    return df.where(F.col(column) == name)


def get_member(
    df: DataFrame, name: str, position: object, column: str = "SEQUENCENAME",
    position_column: str = "SEQUENCEPOSITION",
) -> DataFrame:
    """One member of a sequence; an error if there is none."""
    member = get_sequence(df, name, column).where(F.col(position_column) == F.lit(position))
    if member.isEmpty():
        raise ValueError("member does not exist")
    return member


def shot_sequences(df: DataFrame, shot: str, with_frames: bool = False) -> DataFrame:
    """Distinct sequences of a shot, with whole-number frame range if asked; nulls dropped."""
    rows = df.where(F.col("SHOTNAME") == shot)
    if not with_frames:
        return rows.select("SEQUENCENAME").where("coalesce(SEQUENCENAME, '') <> ''").distinct()
    frames = [F.col(c).try_cast("bigint").alias(c) for c in ("FIRSTFRAME", "LASTFRAME")]
    return rows.select("SEQUENCENAME", *frames).dropna().distinct()


def find_file(df: DataFrame, name: str, folder: str, recursive: bool = True, column: str = "FILE") -> DataFrame:
    """Paths below a folder with the given base name, at any depth or at the top only."""
    base = folder.rstrip("/") + "/"
    path = F.col(column)
    rows = df.where(F.startswith(path, F.lit(base)) & (base_name(path) == name))
    return rows if recursive else rows.where(path == base + name)

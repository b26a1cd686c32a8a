"""Path templates: expansion, placeholders, mapped texts and versions in paths."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import names, tokens
from pathloom.operators.aggregates import highest_version
from pathloom.operators.grouping import salted_join, spread_blank
from pathloom.schemas import SESSION_PLACEHOLDERS, TOKEN_DELIMITERS
from pathloom.session import store


# entries of a mapping up to which it is held beside each row instead of joined
FEW_VALUES = 64


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def row_fill(
    columns: Sequence[str], exclude: Sequence[str] = (), padding_style: str | Column = "standard",
    ext_case: str | Column = "default", extra: Mapping[str, Column] | None = None,
) -> dict[str, Column]:
    """Usable values of a row by column name, with padding and extension in the chosen form."""
    padding = names.padding_form(F.col("PADDING"), padding_style) if "PADDING" in columns else None
    ext = names.extension_case(F.col("DOTEXTENSION"), ext_case) if "DOTEXTENSION" in columns else None
    upper = [c for c in columns if c == c.upper() and c != c.lower()]
    return tokens.row_values(upper, padding, ext, exclude, extra)


def expand_templates(
    rows: DataFrame, templates: DataFrame, filter_list: Sequence[str] = tuple(SESSION_PLACEHOLDERS),
    filter_mode: str = "exclude", add_source: str = "prepend", source_columns: Sequence[str] | None = None,
    all_if_no_extension: bool = True, padding_style: str = "standard", ext_case: str = "default",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Each row with the template rows of its extension, placeholders filled from the row.

    Rows without extension take every template: those are listed under a blank key as well,
    so the join stays an equality join. Where names clash, the template column wins for
    ``prepend`` and the source column for ``append``.
    """
    t_cols = templates.columns
    text = set(_texts(templates))
    # template texts are few: they are cut here, once, and not again for every row
    renamed = templates.select(
        *[F.col(f"`{c}`").alias(f"__t_{c}") for c in t_cols],
        *[tokens.pieces(F.col(f"`{c}`")).alias(f"__p_{c}") for c in t_cols if c in text],
    )
    values = row_fill(rows.columns, (), padding_style, ext_case, extra)
    if filter_mode == "exclude":
        values = {k: v for k, v in values.items() if k not in filter_list}
    elif filter_mode == "include":
        values = {k: v for k, v in values.items() if k in filter_list}
    keyed = rows
    if "DOTEXTENSION" in t_cols and "DOTEXTENSION" in rows.columns:
        ext = F.coalesce(F.col("__t_DOTEXTENSION"), F.lit(""))
        keys = F.array_distinct(F.array(ext, F.lit(""))) if all_if_no_extension else F.array(ext)
        renamed = renamed.withColumn("__key", F.explode(keys))
        keyed = keyed.withColumn("__rkey", F.coalesce(F.col("DOTEXTENSION"), F.lit("")))
    else:
        renamed = renamed.withColumn("__key", F.lit(""))
        keyed = keyed.withColumn("__rkey", F.lit(""))
    joined = salted_join(keyed, renamed, "__rkey", "__key")
    filled = {
        c: tokens.fill_pieces(F.col(f"`__p_{c}`"), values) if c in text else F.col(f"`__t_{c}`")
        for c in t_cols
    }
    source = [c for c in (source_columns or rows.columns) if c in rows.columns]
    if add_source == "prepend":
        names_out = source + [c for c in t_cols if c not in source]
        pick = {**{c: F.col(f"`{c}`") for c in source}, **filled}
    elif add_source == "append":
        names_out = t_cols + [c for c in source if c not in t_cols]
        pick = {**filled, **{c: F.col(f"`{c}`") for c in source}}
    else:
        names_out, pick = t_cols, filled
    return _named(joined, [pick[c] for c in names_out], names_out)


def _named(df: DataFrame, values: Sequence[Column], names_out: Sequence[str]) -> DataFrame:
    """Columns named only after all are computed.

    Inside the functions that fill placeholders, Spark would read a name as the new column of
    that name when both are in one select.
    """
    return df.select(*[v.alias(f"__out{i}") for i, v in enumerate(values)]).toDF(*names_out)


def _put_back(df: DataFrame, column: str, filled: DataFrame) -> DataFrame:
    joined = df.join(filled, F.col(column) == F.col("TEXT"), "left")
    return joined.withColumn(column, F.coalesce("__filled", F.col(column))).select(*df.columns)


def _refill(
    df: DataFrame, columns: Sequence[str], cut: Callable[[Column], Column], mapping: DataFrame, key: str, value: str
) -> DataFrame:
    """Pieces of the text columns replaced by mapped values, all columns in one pass.

    Rows are stored with a number. The pieces of all columns are exploded once and joined once; the hits of a row come
    back as one small map by column and place, and the texts are put together where they are. A row's map is
    as large as its texts and no larger. A mapping of a few values is looked up in the row instead, and no row is moved.
    """
    if not columns:
        return df
    known = mapping.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min_by(value, F.struct(value)).alias("__value"))
    known = known.where("__value IS NOT NULL")
    if known.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        return _refill_few(df, columns, cut, known)
    rows = store(df.withColumn("__row", F.monotonically_increasing_id()))
    none = F.array().cast("array<struct<column:int,at:int,piece:string>>")

    def located(number: int, column: str) -> Column:
        parts = F.transform(cut(F.col(f"`{column}`")), lambda p, i: F.struct(F.lit(number).alias("column"), i.alias("at"), p.alias("piece")))
        return F.coalesce(parts, none)

    pieces = rows.select("__row", F.inline(F.concat(*[located(n, c) for n, c in enumerate(columns)])))
    found = pieces.join(known, F.col("piece") == F.col("__key"))
    place = F.struct("column", "at")
    hits = found.groupBy(F.col("__row").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct(place, "__value"))).alias("__hits"))
    joined = rows.join(hits, F.col("__row") == F.col("__of"), "left")

    def filled(number: int, column: str) -> Column:
        text = F.col(f"`{column}`")

        def shown(piece: Column, at: Column) -> Column:
            return F.coalesce(F.try_element_at("__hits", F.struct(F.lit(number).alias("column"), at.alias("at"))), piece)

        return F.when(F.col("__hits").isNull(), text).otherwise(F.array_join(F.transform(cut(text), shown), ""))

    spots = {c: n for n, c in enumerate(columns)}
    return _named(joined, [filled(spots[c], c) if c in spots else F.col(f"`{c}`") for c in df.columns], df.columns)


def _refill_few(df: DataFrame, columns: Sequence[str], cut: Callable[[Column], Column], known: DataFrame) -> DataFrame:
    """Pieces looked up in the whole mapping, ``FEW_VALUES`` entries at most, which comes as a scalar subquery."""
    values = known.agg(F.map_from_entries(F.collect_list(F.struct("__key", "__value"))).alias("__values"))
    rows = df.withColumn("__values", values.scalar())

    def filled(column: str) -> Column:
        def shown(piece: Column) -> Column:
            return F.coalesce(F.try_element_at("__values", piece), piece)

        return F.array_join(F.transform(cut(F.col(f"`{column}`")), shown), "")

    return _named(rows, [filled(c) if c in columns else F.col(f"`{c}`") for c in df.columns], df.columns)


def remap_actions(mapping: DataFrame, order: Column | None = None) -> DataFrame:
    """Variables that are to be replaced, with their value.

    The first row of a variable decides, also if it says ``ignore``. First is by ``order``, or else
    by the order in which the table is read.
    """
    place = F.monotonically_increasing_id() if order is None else order
    rows = mapping.where(F.coalesce("Variable", F.lit("")) != "").withColumn("__at", place)
    first = rows.groupBy("Variable").agg(F.min(F.struct("__at", "Action", "Value")).alias("__x"))
    return first.where(F.col("__x.Action") == "remap").select("Variable", F.col("__x.Value").alias("Value"))


def resolve_variables(df: DataFrame, column: str, mapping: DataFrame, order: Column | None = None) -> DataFrame:
    """Placeholders still in a text filled from the mapping table; ``ignore`` leaves them."""
    return _refill(df, [column], tokens.pieces, remap_actions(mapping, order), "Variable", "Value")


def unknown_variables(
    df: DataFrame, columns: Sequence[str], mapping: DataFrame, never: Sequence[str] = ("PADDING",)
) -> DataFrame:
    """Placeholders that the mapping table does not know yet."""
    lists = [F.coalesce(tokens.uppercase_tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]
    found = df.select(F.explode(F.array_distinct(F.concat(*lists))).alias("Variable")).distinct()
    known = mapping.select(F.col("Variable").alias("__v")).distinct()
    left = found.join(known, F.col("Variable") == F.col("__v"), "left_anti")
    return left.where(~F.col("Variable").isin(list(never))) if never else left


def fill_session(
    df: DataFrame, mapping: DataFrame, padding_style: str = "standard", ext_case: str = "default",
    extra: Mapping[str, Column] | None = None, order: Column | None = None,
) -> DataFrame:
    """Placeholders in every text column filled from the row itself, then from the mapping."""
    values = row_fill(df.columns, (), padding_style, ext_case, extra)
    columns = _texts(df)
    filled = [
        tokens.fill_tokens(F.col(f"`{c}`"), values) if c in columns else F.col(f"`{c}`") for c in df.columns
    ]
    out = _named(df, filled, df.columns)
    return _refill(out, columns, tokens.pieces, remap_actions(mapping, order), "Variable", "Value")


def virtual_values(versions: Column | None, day: str | Column) -> dict[str, Column]:
    """Values that no column holds: item version, date, and package version of the day."""
    date = F.date_format(F.lit(day).cast("timestamp") if isinstance(day, str) else day, "yyyyMMdd")
    out = {"YYYYMMDD": date}
    if versions is not None:
        out["VERSION"] = versions
    return out


def add_virtual_columns(
    rows: DataFrame, log: DataFrame, day: str | Column, item: str = "PARENTITEM",
    package_item: str = "YYYYMMDD_PKGVERSION3PADDED",
) -> DataFrame:
    """``VERSION`` of the row's item, ``YYYYMMDD`` and ``PKGVERSION3PADDED`` as columns."""
    stamp = F.lit(day).cast("timestamp") if isinstance(day, str) else day
    date = F.date_format(stamp, "yyyyMMdd")
    known = highest_version(log).where("coalesce(item, '') <> ''").select(
        F.concat(F.lit("="), F.col("item")).alias("__item"), (F.col("HIGHEST") + 1).alias("__next")
    )
    keyed = rows.withColumn("__asked", spread_blank(F.trim(F.col(item))))
    joined = keyed.join(known, F.col("__asked") == F.col("__item"), "left").drop("__asked")
    usable = F.coalesce(F.trim(F.col(item)), F.lit("")) != ""
    version = F.when(usable, tokens.version_text(F.coalesce("__next", F.lit(1)), "v", 4))
    package = log.where((F.col("item") == package_item) & (F.col("date") == date)).agg(
        (F.coalesce(F.max(F.trim(F.col("VERSION").cast("string")).try_cast("int")), F.lit(0)) + 1).alias("n")
    )
    return joined.withColumns(
        {
            "VERSION": version, "YYYYMMDD": date,
            "PKGVERSION3PADDED": tokens.version_text(package.scalar(), "no", 3),
        }
    ).drop("__item", "__next")


def parse_columns(df: DataFrame, kind: str, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Placeholders, paths or file names found in chosen columns, one row each."""
    text = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns or df.columns])
    if kind == "uppercase":
        found = F.explode(tokens.uppercase_tokens(text, TOKEN_DELIMITERS)).alias("FOUND")
    elif kind == "path":
        found = F.explode(tokens.path_tokens(text)).alias("FOUND")
    elif kind == "raw_item_name":
        return df.select(*keep, F.inline(tokens.file_tokens(text)).alias("FOUND", "NAME"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return df.select(*keep, found)


def replace_mapped_text(
    df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, kind: str = "path"
) -> DataFrame:
    """Paths found in a text replaced by their mapped value.

    With ``raw_item_name``, a path is looked up by its file name. The mapping is read once per
    distinct text; blank values replace nothing.
    """
    texts = df.select(F.col(column).alias("TEXT")).where("TEXT is not null").distinct()
    if kind == "raw_item_name":
        found = texts.select("TEXT", F.posexplode(tokens.file_tokens(F.col("TEXT"))).alias("__at", "__hit"))
        found = found.select("TEXT", "__at", F.col("__hit.path").alias("__old"), F.col("__hit.name").alias("__look"))
    else:
        list_of = tokens.uppercase_tokens if kind == "uppercase" else tokens.path_tokens
        found = texts.select("TEXT", F.posexplode(list_of(F.col("TEXT"))).alias("__at", "__old"))
        found = found.withColumn("__look", F.col("__old"))
    known = (
        mapping.where(F.coalesce(F.trim(F.col(value)), F.lit("")) != "")
        .groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__new"))
    )
    steps = found.join(known, F.col("__look") == F.col("__key")).groupBy("TEXT").agg(
        F.array_sort(F.collect_list(F.struct("__at", "__old", "__new"))).alias("__steps")
    )
    filled = steps.select(
        "TEXT",
        F.aggregate("__steps", F.col("TEXT"), lambda t, s: F.replace(t, s["__old"], s["__new"])).alias("__filled"),
    )
    return _put_back(df, column, filled)


def dollar_columns(df: DataFrame, text: str = "DEST", target: str = "DESTPREVIEW", batch: bool = False) -> DataFrame:
    """``$COLUMN`` in a text replaced by that row's value."""
    fill = tokens.last_dollar_column if batch else tokens.dollar_columns
    return df.withColumn(target, fill(F.col(text), df.columns))


def dollar_externals(df: DataFrame, column: str, values: DataFrame, name: str = "NAME", value: str = "VALUE") -> DataFrame:
    """``$NAME`` in a text replaced by the value of a table; unknown names stay."""
    marked = values.select(F.concat(F.lit("$"), F.col(name)).alias(name), F.col(value).cast("string").alias(value))
    return _refill(df, [column], tokens.dollar_pieces, marked, name, value)


def fill_version(df: DataFrame, column: str, registry: DataFrame, name: str = "IDENTIFIER", entry: str = "ENTRY") -> DataFrame:
    """First ``VERSION`` of each path part replaced by the next registered version.

    A part is registered by its text up to its first dot. Entries read
    ``last-date-prefix-padding``; parts without an entry stay.
    """
    fields = F.split(F.col(entry), "-")
    digits = (F.get(fields, 0).try_cast("bigint") + 1).cast("string")
    width = F.greatest(F.length(digits), F.coalesce(F.get(fields, 3).try_cast("int"), F.lit(0)))
    next_text = registry.select(
        F.col(name).alias("__id"), F.concat(F.get(fields, 2), F.lpad(digits, width, "0")).alias("__v")
    )
    texts = df.select(F.col(column).alias("TEXT")).where(F.contains(F.col("TEXT"), F.lit("VERSION"))).distinct()
    parts = texts.select("TEXT", F.posexplode(F.split("TEXT", "/")).alias("__at", "__piece"))
    ident = F.regexp_extract("__piece", r"^(.*?VERSION[^.]*)", 1)
    joined = parts.withColumn("__ident", ident).join(next_text, F.col("__ident") == F.col("__id"), "left")
    at = F.instr("__piece", F.lit("VERSION"))
    put = F.concat(
        F.substring("__piece", F.lit(1), at - 1), F.col("__v"),
        F.substring("__piece", at + 7, F.length("__piece")),
    )
    shown = F.struct("__at", F.coalesce(put, F.col("__piece")).alias("t"))
    filled = joined.groupBy("TEXT").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), "/").alias("__filled")
    )
    return _put_back(df, column, filled)


def next_registry(registry: DataFrame, used: DataFrame, stamp: str, name: str = "IDENTIFIER", entry: str = "ENTRY") -> DataFrame:
    """Registry with the version of every used identifier raised by one."""
    ids = used.select(F.col(name).alias("__u")).distinct().withColumn("__hit", F.lit(True))
    fields = F.split(F.col(entry), "-")
    raised = F.concat_ws(
        "-", (F.get(fields, 0).try_cast("bigint") + 1).cast("string"), F.lit(stamp), F.get(fields, 2), F.get(fields, 3)
    )
    joined = registry.join(ids, F.col(name) == F.col("__u"), "left")
    return joined.withColumn(entry, F.when(F.col("__hit"), raised).otherwise(F.col(entry))).select(*registry.columns)


def next_version(
    items: DataFrame, log: DataFrame, mode: str | int = "iterate", day: str | None = None,
    style: str = "v", padding: int = 4, dated: str = "YYYYMMDD_PKGVERSION3PADDED", item: str = "item",
) -> DataFrame:
    """Working version of each item: the next one, the current one, or a fixed number.

    Items whose name holds the ``dated`` text only count the log of the given day.
    """
    number = F.trim(F.col("VERSION").cast("string")).try_cast("int")
    counts = number
    if day is not None:
        counts = F.when(~F.contains(F.col(item), F.lit(dated)) | (F.col("date") == day), number)
    known = log.groupBy(F.col(item).alias("__i")).agg(F.max(counts).alias("__h"))
    joined = items.select(item).join(known, F.col(item) == F.col("__i"), "left")
    highest = F.coalesce("__h", F.lit(0))
    if str(mode).isdigit():
        working = F.lit(int(mode))
    elif mode == "iterate":
        working = highest + 1
    elif mode == "current":
        working = highest
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return joined.select(
        item, highest.alias("HIGHEST"), working.alias("WORKING"),
        tokens.version_text(working, style, padding).alias("VERSION_ID"),
    )


def version_log_rows(working: DataFrame, day: str, user: str, item: str = "item") -> DataFrame:
    """New log rows for working versions."""
    return working.select(
        F.lit(day).alias("date"), F.col("WORKING").cast("string").alias("VERSION"), F.lit(user).alias("user"), item
    )


def split_segments(df: DataFrame, column: str = "PROVISIONEDLINK", segments: int | None = None) -> DataFrame:
    """Link cut at slashes into ``Segment i`` columns.

    The number of columns is found with one maximum unless it is given.
    """
    if segments is None:
        segments = df.agg(F.max(F.size(F.split(F.col(column), "/")))).first()[0] or 0
    parts = F.split(F.col(column), "/")
    return df.withColumns({f"Segment {i + 1}": F.get(parts, i) for i in range(segments)})


def segment_rows(df: DataFrame, column: str = "PROVISIONEDLINK") -> DataFrame:
    """Each segment of a link as a row, with its position from 1. Links may have any number."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, "/")).alias("POSITION", "SEGMENT")).withColumn(
        "POSITION", F.col("POSITION") + 1
    )


def compose_link(df: DataFrame, target: str = "PROVISIONEDLINK", skip: int = 2) -> DataFrame:
    """Columns after the first two joined by slashes."""
    return df.withColumn(target, tokens.compose_link([c for c in df.columns[skip:] if c != target]))


def search_replace(df: DataFrame, term: str, replacement: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Find and replace in chosen text columns or in all of them."""
    wanted = [c for c in _texts(df) if columns is None or c in columns]
    return df.withColumns(
        {c: tokens.search_replace(F.col(f"`{c}`"), term, replacement, **options) for c in wanted}
    )

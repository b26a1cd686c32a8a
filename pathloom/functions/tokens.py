"""Placeholders, path-like runs and literal replacement inside text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.schemas import TOKEN_DELIMITERS

_PATH = r"(?:[A-Za-z]:)?[/\\][^ \n\t;,|]*"


def _char_class(delimiters: Sequence[str]) -> str:
    return "[" + "".join("\\" + d for d in delimiters) + "]"


def pieces(text: Column, delimiters: Sequence[str] = TOKEN_DELIMITERS) -> Column:
    """Text cut at the delimiters, with the delimiters kept as pieces of their own."""
    chars = _char_class(delimiters)
    return F.split(text, f"(?<={chars})|(?={chars})")


def dollar_pieces(text: Column) -> Column:
    """Text cut before and after each ``$NAME``."""
    return F.regexp_extract_all(text, F.lit(r"\$[A-Za-z0-9_]+|[^$]+|\$"), F.lit(0))


def is_placeholder(piece: Column) -> Column:
    """Upper-case text of two characters or more with at least one letter."""
    return (F.length(piece) > 1) & (piece == F.upper(piece)) & (piece != F.lower(piece))


def uppercase_tokens(text: Column, delimiters: Sequence[str] = TOKEN_DELIMITERS) -> Column:
    """Distinct placeholders of a text in order of appearance."""
    parts = F.split(text, _char_class(delimiters))
    return F.array_distinct(F.filter(parts, is_placeholder))


def path_tokens(text: Column, drop_chars: Sequence[str] = (">", "<", "|", ";")) -> Column:
    """Runs of text that start at a slash, with the drive letter if there is one."""
    found = F.regexp_extract_all(text, F.lit(_PATH), F.lit(0))
    return F.filter(found, lambda p: ~p.rlike(_char_class(drop_chars)))


def file_tokens(text: Column) -> Column:
    """Path runs that end in an extension, as ``{path, name}``."""
    files = F.filter(path_tokens(text), lambda p: p.rlike(r"\.\w+$"))
    return F.transform(
        files,
        lambda p: F.struct(p.alias("path"), F.element_at(F.split(p, "/"), -1).alias("name")),
    )


def drive_paths(line: Column, extensions: Sequence[str]) -> Column:
    """Paths with a drive letter that end in one of the extensions."""
    pattern = r"(?i)\b\w:.*?\.(?:" + "|".join(extensions) + ")"
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def fill_tokens(text: Column, values: Mapping[str, Column], delimiters: Sequence[str] = TOKEN_DELIMITERS) -> Column:
    """Whole placeholders replaced by their value; null values and unknown names stay."""
    return fill_pieces(pieces(text, delimiters), values)


def fill_pieces(parts: Column, values: Mapping[str, Column]) -> Column:
    """The same for a text that is cut into pieces already.

    Names are compared one by one, so a value is only computed for rows that use it and no map
    is built per row.
    """
    def fill(piece: Column) -> Column:
        out = None
        for name, value in values.items():
            test = piece == name
            out = F.when(test, F.coalesce(value, piece)) if out is None else out.when(test, F.coalesce(value, piece))
        return piece if out is None else out.otherwise(piece)

    return F.array_join(F.transform(parts, fill), "")


def row_values(
    columns: Sequence[str], padding: Column | None = None, ext: Column | None = None,
    exclude: Sequence[str] = (), extra: Mapping[str, Column] | None = None,
) -> dict[str, Column]:
    """Values of a row by placeholder name; blanks and NaN are null."""
    entries: dict[str, Column] = {c: F.col(f"`{c}`").cast("string") for c in columns}
    if padding is not None and "PADDING" in entries:
        entries["PADDING"] = padding
    if ext is not None and "DOTEXTENSION" in entries:
        entries["DOTEXTENSION"] = ext
    entries.update(extra or {})
    return {k: F.when((F.trim(v) != "") & (v != "NaN"), v) for k, v in entries.items() if k not in exclude}


def value_map(values: Mapping[str, Column]) -> Column:
    """The same as a map column without the null values."""
    if not values:
        return F.create_map().cast("map<string,string>")
    flat = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


def java_quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def search_replace(
    text: Column, term: str, replacement: str, match_case: bool = False,
    whole_word: bool = False, delimiters: Sequence[str] = (),
) -> Column:
    """Literal find and replace, whole text or between delimiters."""
    pattern = java_quote(term)
    if whole_word:
        pattern = rf"\b{pattern}\b"
    if not match_case:
        pattern = "(?iu)" + pattern
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    if not delimiters:
        return F.regexp_replace(text, pattern, safe)
    for d in delimiters:
        text = F.array_join(
            F.transform(F.split(text, java_quote(d)), lambda p: F.regexp_replace(p, pattern, safe)), d
        )
    return text


def dollar_columns(text: Column, columns: Sequence[str]) -> Column:
    """``$COLUMN`` replaced by the row's value, longest column name first."""
    for name in sorted(columns, key=len, reverse=True):
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        text = F.replace(text, F.lit(f"${name}"), value)
    return text


def last_dollar_column(text: Column, columns: Sequence[str]) -> Column:
    """Batch form: only the last column that occurs is filled."""
    out = F.lit(None).cast("string")
    for name in columns:
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        hit = F.contains(text, F.lit(f"${name}"))
        out = F.when(hit, F.replace(text, F.lit(f"${name}"), value)).otherwise(out)
    return out


def compose_link(columns: Sequence[str]) -> Column:
    """Columns joined by slashes, nulls left out."""
    return F.concat_ws("/", *[F.col(f"`{c}`").cast("string") for c in columns])


def split_components(text: Column) -> Column:
    """A segment cut at ``_ - .`` with the delimiters kept; null gives an empty list."""
    marked = F.regexp_replace(text, r"([_.\-])", "\x01$1\x01")
    return F.coalesce(F.split(marked, "\x01"), F.array().cast("array<string>"))


def version_text(number: Column, style: str = "v", padding: int = 4) -> Column:
    """A version number as ``v0001``, ``V0001`` or bare digits."""
    prefix = style if style in ("v", "V") else ""
    digits = number.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(padding)), "0")
    return F.concat(F.lit(prefix), padded)



"""Frame sequences and extensions read from file names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.paths import let
from pathloom.schemas import IMAGE_EXTENSIONS

# How each naming style splits a path into prefix, frame number and extension.
SEQUENCE_PATTERNS = {
    "dot": r"^(.*[/\\].*?\.)(\d+)(\.[^.]+)$",
    "dot_ext": r"^(.*[/\\].*?\.)(\d+)(\.[^.]+)$",
    "any_sep": r"^(.*[/\\].*?[._-])(\d{1,20})(\.[^.]+)$",
    "last_sep": r"^(.*[._])(\d{2,})(\.[^.]*)$",
}


def sequence_columns(
    file: Column, style: str = "last_sep", extensions: Sequence[str] | None = None
) -> dict[str, Column]:
    """``SEQUENCENAME``, ``SEQUENCEPOSITION`` and ``PADDING`` of a path; blank if no member.

    Styles: ``dot`` takes any extension, ``dot_ext`` only listed ones, ``any_sep`` also
    allows ``_`` and ``-`` before the number but at most two dots in the name, and
    ``last_sep`` (the default) wants two digits or more and lower-cases the extension.
    """
    found = sequence_struct(file, style, extensions)
    return {c: found[c] for c in ("SEQUENCENAME", "SEQUENCEPOSITION", "PADDING")}


def sequence_struct(file: Column, style: str = "last_sep", extensions: Sequence[str] | None = None) -> Column:
    """The same as one struct. ``operators.columns.with_sequence`` works it out once per row.

    Each step is computed once, also where Spark puts the whole expression into a filter.
    """
    def named(path: Column, prefix: Column, number: Column, suffix: Column, fits: Column) -> Column:
        member = fits
        if style != "dot":
            member &= F.lower(suffix).isin([e.lower() for e in (extensions or IMAGE_EXTENSIONS)])
        if style == "any_sep":
            name = F.substring_index(path, "/", -1)
            member &= F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) <= 2
        end = F.lower(suffix) if style == "last_sep" else suffix
        padding = F.length(number).cast("string")
        name = F.concat(prefix, F.lit("%0"), padding, F.lit("d"), end)
        blank = F.lit("")
        return let(F.coalesce(member, F.lit(False)), lambda hit: F.struct(
            F.when(hit, name).otherwise(blank).alias("SEQUENCENAME"),
            F.when(hit, number).otherwise(blank).alias("SEQUENCEPOSITION"),
            F.when(hit, padding).otherwise(blank).alias("PADDING"),
        ))

    if style == "last_sep":
        return let(file, lambda path: _last_number(path, lambda *groups: named(path, *groups)))

    def matched(path: Column) -> Column:
        # one match per path: its three groups come back on lines of their own, two characters longer
        def cut(marked: Column) -> Column:
            fits = F.length(marked) == F.length(path) + 2
            return let(F.split(marked, "\n", 3), lambda parts: named(path, *(F.get(parts, i) for i in range(3)), fits))

        return let(F.regexp_replace(path, SEQUENCE_PATTERNS[style], "$1\n$2\n$3"), cut)

    return let(file, matched)


def _last_number(file: Column, body: Callable[..., Column]) -> Column:
    """``body`` of the groups of the ``last_sep`` pattern and of whether it fits, without a regular expression.

    What ends in digits before the last dot is cut there; the pattern's dots do not match line ends.
    """
    def found(tail: Column, base: Column, prefix: Column) -> Column:
        number = F.right(base, F.length(base) - F.length(prefix))
        fits = (
            F.contains(file, F.lit(".")) & (F.length(number) >= 2)
            & (F.endswith(prefix, F.lit(".")) | F.endswith(prefix, F.lit("_")))
            & ~prefix.rlike(r"[\n\r\x85\u2028\u2029]")
        )
        return let(number, lambda digits: body(prefix, digits, F.concat(F.lit("."), tail), fits))

    def based(tail: Column) -> Column:
        base = F.left(file, F.length(file) - F.length(tail) - 1)
        return let(base, lambda b: let(F.rtrim(b, F.lit("0123456789")), lambda p: found(tail, b, p)))

    return let(F.substring_index(file, ".", -1), based)


def parse_sequence_path(path: Column) -> Column:
    """``{name, position}`` of one path, null if it is no sequence member."""
    pattern = r"^(.+[/\\].+)\.(\d+)(\.\w+)$"
    base, number, ext = (F.regexp_extract(path, pattern, i) for i in (1, 2, 3))
    name = F.concat(base, F.lit(".%0"), F.length(number).cast("string"), F.lit("d"), ext)
    return F.when(
        F.length(number) > 0,
        F.struct(name.alias("name"), number.cast("bigint").alias("position")),
    )


def extension(file: Column) -> Column:
    """Text after the last dot; blank for temporary or odd extensions."""
    ext = F.when(F.contains(file, F.lit(".")), F.substring_index(file, ".", -1)).otherwise("")
    odd = F.length(F.translate(ext, "~#_-", "")) < F.length(ext)
    return F.when(odd | ext.isin("part", "autosave", "tmp"), F.lit("")).otherwise(ext)


def split_extension(name: Column) -> tuple[Column, Column]:
    """Name and ``.ext``; leading dots belong to the name."""
    pattern = r"^(.*[^./][^/]*)(\.[^./]*)$"
    base, ext = (F.regexp_extract(name, pattern, i) for i in (1, 2))
    found = F.length(base) > 0
    return F.when(found, base).otherwise(name), F.when(found, ext).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Path without its last part; blank for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension_group(file: Column) -> Column:
    """``.ext`` in lower case, with jpeg read as jpg and tiff as tif."""
    ext = F.concat(F.lit("."), F.lower(F.substring_index(file, ".", -1)))
    return (
        F.when(F.contains(file, F.lit("%")), ext)
        .when(ext == ".jpeg", F.lit(".jpg"))
        .when(ext == ".tiff", F.lit(".tif"))
        .otherwise(ext)
    )


def padding_form(padding: Column, style: Column | str = "standard") -> Column:
    """Frame padding as ``%04d``, ``####`` or ``$F4``; text that is no number stays."""
    style = F.lit(style) if isinstance(style, str) else style
    number = padding.cast("string").try_cast("int")
    digits = number.cast("string")
    standard = F.concat(F.when(F.length(digits) == 1, F.lit("%0")).otherwise("%"), digits, F.lit("d"))
    form = (
        F.when(style == "standard", standard)
        .when(style == "hashed", F.repeat(F.lit("#"), number))
        .when(style == "dollar", F.concat(F.lit("$F"), digits))
    )
    return F.when(number.isNull(), padding.cast("string")).otherwise(form)


def extension_case(ext: Column, option: Column | str = "default") -> Column:
    option = F.lit(option) if isinstance(option, str) else option
    return F.when(option == "upper", F.upper(ext)).when(option == "lower", F.lower(ext)).otherwise(ext)

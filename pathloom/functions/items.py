"""Names of items, versions, people and packages read from paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.paths import conform_slashes


def item_columns(path: Column) -> dict[str, Column]:
    """Raw name, name without frame placeholder, folder and first part of a path."""
    raw = conform_slashes(path)
    clean = F.regexp_replace(raw, r"\.%0\d{1,2}d", "")
    parts = F.split(clean, "/")
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return {
        "PARENTITEM": F.lit(""),
        "RAWITEMNAME": F.element_at(F.split(raw, "/"), -1),
        "ITEMNAME": F.element_at(parts, -1),
        "ITEMLOCATION": F.array_join(middle, "/"),
        "ITEMLOCATIONROOT": F.element_at(parts, 1),
        "REMAPTYPE": F.lit("string"),
    }


def strip_item_name(item: Column, shot: Column) -> Column:
    """Item name without extension and without the shot name in front."""
    base = F.regexp_replace(item, r"\.[^.]*$", "")
    has_shot = (F.coalesce(shot, F.lit("")) != "") & F.startswith(base, shot)
    rest = F.ltrim(F.substring(base, F.length(shot) + 1, F.length(base)), F.lit("-_"))
    return F.when(has_shot, rest).otherwise(base)


def item_version(stripped: Column) -> Column:
    """``v012`` when the text after the first ``v`` (else ``V``) is a number other than zero."""
    marker = F.when(F.contains(stripped, F.lit("v")), F.lit("v")).otherwise(F.lit("V"))
    second = F.split_part(F.split_part(stripped, marker, F.lit(2)), F.lit("."), F.lit(1))
    numbered = second.rlike(r"^\d+$") & second.rlike("[1-9]")
    return F.when(numbered, F.concat(F.lit("v"), second)).otherwise(F.lit(""))


def second_after(path: Column, markers: Sequence[str] = ("IN", "OUT")) -> Column:
    """The part two places after the first marker that occurs; null without a marker."""
    parts = F.split(conform_slashes(path), "/")
    found = F.lit(None).cast("string")
    for marker in reversed(markers):
        at = F.array_position(parts, F.lit(marker)).cast("int")
        found = F.when(at > 0, F.coalesce(F.get(parts, at + 1), F.lit(""))).otherwise(found)
    return found


def who_from_files(sequence: Column, file: Column) -> Column:
    """Sender of a file: from the sequence name if that has one, else from the path."""
    first = F.coalesce(second_after(sequence, ["IN"]), F.lit(""))
    return F.when(first != "", first).otherwise(F.coalesce(second_after(file, ["IN"]), F.lit("")))


def who_from(islink: Column, file: Column, current: Column | None = None) -> Column:
    """Sender of plain files; links keep their current value."""
    current = F.lit("") if current is None else current
    return F.when(islink == "no", F.coalesce(second_after(file), current)).otherwise(current)


def who_to(islink: Column, file: Column, target: Column, current: Column | None = None) -> dict[str, Column]:
    """Links only: sender from the target, receiver from the link itself."""
    current = F.lit("") if current is None else current
    link = islink != "no"
    return {
        "WHOFROM": F.when(link, F.coalesce(second_after(target), current)).otherwise(current),
        "WHOTO": F.when(link, F.coalesce(second_after(file), F.lit(""))).otherwise(F.lit("")),
    }


def who_links(target: Column, sequence: Column, link: Column) -> dict[str, Column]:
    """Receiver from the target, sender from sequence and link text together."""
    blank = F.lit("")
    place = F.concat(F.coalesce(sequence, blank), F.coalesce(link, blank))
    return {
        "WHOTO": F.coalesce(second_after(target), blank),
        "WHOFROM": F.coalesce(second_after(place), blank),
    }


def recipient(package: Column, current: Column) -> Column:
    """Third ``-`` part of a package name without its last two ``_`` parts, if none is set."""
    words = F.split(F.get(F.split(package, "-"), 2), "_")
    found = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), "_")
    return F.when(F.coalesce(current, F.lit("")) != "", current).when(
        (F.size(words) >= 3) & (found != ""), found
    ).otherwise(current)


def display_name(item: Column, parsers: Sequence[str] = ("copy",), current: Column | None = None) -> Column:
    """Item name made readable by parsers applied in order."""
    text = item if current is None else current
    for parser in parsers:
        if parser == "underscores":
            text = F.ltrim(text, F.lit("_"))
        elif parser == "capitalise":
            text = title_case(text)
        elif parser == "spaces":
            text = F.regexp_replace(text, "[_-]", " ")
        elif parser == "copy":
            text = item
        else:
            raise ValueError(f"unknown parser: {parser}")
    return text


def title_case(text: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case."""
    runs = F.split(text, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2147483647))),
        ),
        "",
    )

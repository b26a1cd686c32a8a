"""Frame ranges inside one row: short arrays of numbers and their text form ``1-3, 7``.

These work on lists that already sit in a cell. Frames spread over many rows are folded by
``operators.frames`` instead, which never gathers a whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(frames: Column) -> Column:
    return F.filter(frames, lambda x, i: (i == 0) | (F.element_at(frames, i) < x - 1))


def _ends(frames: Column) -> Column:
    return F.filter(
        frames, lambda x, i: (i == F.size(frames) - 1) | (F.get(frames, i + 1) > x + 1)
    )


def islands(frames: Column) -> Column:
    """Runs of consecutive numbers of a sorted distinct array, as ``{first, last}`` structs."""
    return F.zip_with(
        _starts(frames), _ends(frames), lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    )


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(
        F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
    )


def format_ranges(numbers: Column) -> Column:
    """Sorted distinct numbers as ``1-3, 7, 9-10``."""
    clean = F.array_sort(F.array_distinct(numbers))
    return F.array_join(
        F.transform(islands(clean), lambda r: range_text(r["first"], r["last"])), ", "
    )


def parse_intervals(text: Column) -> Column:
    """``1-3, 7`` as an array of ``{first, last}``; blank text gives an empty array."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p) != "")

    def interval(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        first = F.trim(F.element_at(ends, 1)).cast("bigint")
        last = F.trim(F.element_at(ends, -1)).cast("bigint")
        return F.struct(first.alias("first"), last.alias("last"))

    return F.transform(parts, interval)


def parse_ranges(text: Column) -> Column:
    """``1-3, 7`` as the numbers themselves."""
    return F.array_sort(
        F.array_distinct(
            F.flatten(F.transform(parse_intervals(text), lambda r: F.sequence(r["first"], r["last"])))
        )
    )


def missing_numbers(numbers: Column) -> Column:
    """Numbers absent between the smallest and the largest of an array."""
    full = F.sequence(F.array_min(numbers), F.array_max(numbers))
    return F.when(F.size(numbers) > 0, F.array_except(full, numbers)).otherwise(
        F.array().cast("array<bigint>")
    )

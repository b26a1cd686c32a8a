"""Likeness of two texts for the order of choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(key: Column, value: Column) -> Column:
    """Default order: fewer edits first, in lower case. Stays in the JVM."""
    return F.levenshtein(F.lower(key), F.lower(value))

"""Terms found inside texts, by an index of grams instead of a theta join.

A gram is a stretch of 1, 2, 4 or 8 characters. Each term is filed under one gram of the largest
size that fits into it: the gram that the fewest terms have. A text that holds the term holds that
gram, so texts are cut into the grams of the sizes in use, joined to the index by equality, and the
term is then looked for in the text itself. A text gives at most four rows per position, however
many lengths the terms have, and only for grams that start like one in the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gram_size(text: Column) -> Column:
    size = F.length(text)
    return F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)


def _grams(text: Column, size: Column, starts: Column) -> Column:
    fits = F.filter(starts, lambda i: i + size - 1 <= F.length(text))
    return F.array_distinct(F.transform(fits, lambda i: F.substring(text, i, size)))


def _starts(text: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))


def gram_index(terms: DataFrame, term: str) -> DataFrame:
    """Distinct terms as ``TERM`` with the gram ``GRAM`` they are filed under.

    A gram's terms are counted with a combine before the shuffle, so a gram that all terms share
    moves one row per task. Of equally rare grams the largest by code point is taken.
    """
    known = terms.select(F.col(term).alias("TERM")).where(F.coalesce("TERM", F.lit("")) != "").distinct()
    text = F.col("TERM")
    cut = known.select("TERM", F.explode(_grams(text, _gram_size(text), _starts(text))).alias("GRAM"))
    counts = cut.groupBy("GRAM").agg(F.count(F.lit(1)).alias("__n"))
    rarest = F.max_by("GRAM", F.struct(-F.col("__n"), F.col("GRAM")))
    return cut.join(counts, "GRAM").groupBy("TERM").agg(rarest.alias("GRAM"))


def _bounded(text: Column, term: Column) -> Column:
    """Whether the term stands in the text as a whole word."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(text, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))


def _text_names(columns: Sequence[str]) -> list[str]:
    """Names that a row of texts goes by: a hash, so that sorts compare numbers before long texts, then the texts."""
    return ["__th", *(f"__t{i}" for i in range(len(columns)))]


def _texts_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def matches(
    df: DataFrame, columns: Sequence[str], terms: DataFrame, term: str,
    ignore_case: bool = False, whole_word: bool = False,
) -> DataFrame:
    """Distinct rows of the text columns with every row of ``terms`` whose term occurs in one of them.

    The texts come back as ``__t0``, ``__t1`` and so on (flat, so that rows spread by one text stay
    where they are for a join on it), the number of the column that holds the term as ``COLUMN_NO``; a term found in two columns gives two rows. Blank terms and null texts match
    nothing. All columns are searched in one pass. The term table may be of any size. Two small
    facts about its index, the gram sizes (at most four) and the first characters of grams (limited
    by the alphabet), are looked up as a scalar subquery.
    """
    fold = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    known = terms.withColumn("__term", fold(F.col(term)))
    index = gram_index(known, "__term")
    facts = index.agg(
        F.struct(
            F.collect_set(F.length("GRAM")).alias("sizes"),
            F.array_join(F.collect_set(F.substring("GRAM", 1, 1)), "").alias("firsts"),
        ).alias("__facts")
    )
    names = _text_names(columns)
    rows = df.select(_texts_hash(columns).alias(names[0]), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names[1:])]).distinct()
    texts = rows.select(*names, F.posexplode(F.array(*names[1:]))) if len(columns) > 1 else rows.select(
        *names, F.lit(0).alias("pos"), F.col(names[1]).alias("col")
    )
    texts = texts.where(F.col("col").isNotNull()).select(
        *names, F.col("pos").alias("COLUMN_NO"), fold(F.col("col")).alias("__text")
    ).withColumn("__facts", facts.scalar())
    text = F.col("__text")
    # an empty pattern gives the characters in one pass; only those that a gram begins with are looked at further
    begins = F.transform(F.split(text, ""), lambda c, i: F.when(F.contains(F.col("__facts.firsts"), c), i + 1))
    starts = F.array_compact(begins)
    grams = F.flatten(F.transform(F.col("__facts.sizes"), lambda n: _grams(text, n, starts)))
    cut = texts.select(*names, "COLUMN_NO", "__text", F.explode(grams).alias("GRAM"))
    held = F.contains(text, F.col("TERM"))
    if whole_word:
        held &= _bounded(text, F.col("TERM"))
    found = cut.join(index, "GRAM").where(held).select(*names, "COLUMN_NO", "TERM")
    return found.join(known, F.col("TERM") == F.col("__term")).drop("TERM", "__term")


def best_match(
    df: DataFrame, columns: Sequence[str], terms: DataFrame, term: str, order: Sequence[str],
    returned: Sequence[str], winner: str = "last", ignore_case: bool = False, whole_word: bool = False,
) -> DataFrame:
    """Per distinct row of the text columns, what the first or last matching term by ``order`` returns.

    A match in a later column goes before all matches in earlier ones. The result comes back as the
    struct ``__best`` beside the texts.
    """
    pick, at = (F.max_by, F.col("COLUMN_NO")) if winner == "last" else (F.min_by, -F.col("COLUMN_NO"))
    found = matches(df, columns, terms, term, ignore_case, whole_word)
    return found.groupBy(*_text_names(columns)).agg(pick(F.struct(*returned), F.struct(at, *order)).alias("__best"))


def with_best(df: DataFrame, best: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """``df`` with the struct ``__best`` of its text columns: null where nothing matched or ``where`` is not met."""
    same = _texts_hash(columns) == F.col("__th")
    for c, n in zip(columns, _text_names(columns)[1:]):
        same &= F.col(f"`{c}`") == F.col(n) if len(columns) == 1 else F.col(f"`{c}`").eqNullSafe(F.col(n))
    on = same if where is None else where & same
    return df.join(best, on, "left").drop(*_text_names(columns))

"""Benchmark windows that occur in documents, by a prefix-filtered set join in DataFrame operations.

Method. A window is ``size`` consecutive words of an item, or all words of a shorter item. Its set is that of
its two-word shingles (one word alone, if the window has one). Shingles are ordered by their count in the
documents, rarest first. A document that holds a window holds all its shingles, so the prefix that has to
be joined is the rarest one alone: document shingles are joined with these. Position bounds leave the
places where the whole window lies inside the document, length bounds those where it is long enough, and
the words there are compared with the window's.

Up to ``BROADCAST`` window shingles the join is a broadcast of that size and documents are not shuffled; beyond
it both sides are shuffled by shingle and the words of candidates are joined by document.

Cases. A null or empty text, or one without words, has no words and no hits; such items have no window. Items
with equal ids are one item; windows of an item without id mark words and are not counted as an item.
Repeated rows and ids of documents are documents of their own. Empty tables on either side give no hits.
Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch, with_row

# window shingles, of about 200 bytes with their window, up to which they are broadcast
BROADCAST = 250_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# fixed value: what separates words, once A-Z are in lower case
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z in lower case: runs of 0-9, a-z and all characters beyond ASCII."""
    found = F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingles(df: DataFrame, keep: list[str], words: int) -> DataFrame:
    """``keep``, ``pos`` and the hash ``shingle`` of every one- or two-word shingle of ``words``."""
    if words == 1:
        return df.select(*keep, F.posexplode("words").alias("pos", "w")).select(*keep, "pos", F.xxhash64("w").alias("shingle"))
    pairs = F.arrays_zip(F.col("words").alias("x"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("y"))
    out = df.select(*keep, F.posexplode(pairs).alias("pos", "z")).where(F.col("z.y").isNotNull())
    return out.select(*keep, "pos", F.xxhash64("z.x", "z.y").alias("shingle"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", size: int = 10,
) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as text)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = _contamination(numbered, items, scratch, item_key, item_text, size)
    return found.withColumnRenamed("key", key).drop("row")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    size: int = 10,
) -> DataFrame:
    """The documents that hold no window of an item, with all their columns."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = with_row(docs, [F.struct(*docs.columns).alias("doc"), F.col(text).cast("string").alias("text")], scratch)
    numbered = rows.select("row", F.lit(None).cast("long").alias("key"), "text")
    found = _contamination(numbered, items, scratch, item_key, item_text, size)
    gone = scratch.put(found.where("n_hit > 0").select("row"), "gone")
    scratch.drop_others("input", "gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def _contamination(numbered: DataFrame, items: DataFrame, scratch: Scratch, item_key: str, item_text: str, size: int) -> DataFrame:
    rows = numbered.select("row", "key", words_of(F.col("text")).alias("words"))
    rows = scratch.put(rows.select("row", "key", F.size("words").alias("n"), "words"), "words")

    parts = items.select(F.col(item_key).cast("string").alias("item"), words_of(F.col(item_text).cast("string")).alias("words")).where(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(size))
    parts = parts.withColumn("span", span).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)))
    parts = scratch.put(parts.select("item", F.slice("words", F.col("at"), F.col("span")).alias("words")).distinct(), "windows-of-items")
    windows = parts.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), F.size("words").alias("span"), "words")
    windows = scratch.put(windows, "windows")
    owners = scratch.put(parts.join(windows.select("window", "words"), "words").select("window", "item"), "owners")

    base = rows.select("row", "key", "n")
    none = F.lit(0).cast("long")
    hits = []
    for width, some in ((1, windows.where("span = 1")), (2, windows.where("span > 1"))):
        inside = scratch.put(_shingles(some.select("window", "span", "words"), ["window", "span"], width).withColumnRenamed("pos", "q"), f"shingles{width}")
        size_of = inside.count()
        if not size_of:
            continue
        spread = _shingles(rows.select("row", "n", "words"), ["row", "n", "words"], width)
        wanted = inside.select("shingle").distinct()
        counts = spread.select("shingle").join(_small(wanted, size_of), "shingle").groupBy("shingle").agg(F.count("*").alias("c"))
        # a window with a shingle that no document has cannot occur
        ranked = inside.join(scratch.put(counts, f"counts{width}"), "shingle", "left")
        prefix = ranked.groupBy("window", "span").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "shingle", "q")).alias("x"))
        prefix = scratch.put(prefix.where("x.c > 0").select("window", "span", "x.shingle", "x.q"), f"prefix{width}")
        start = F.col("pos") - F.col("q")
        within = (start >= 0) & (start + F.col("span") <= F.col("n"))
        same = F.slice("words", F.col("start") + 1, F.col("span")) == F.col("wanted")
        contents = windows.select("window", F.col("words").alias("wanted"))
        if size_of <= BROADCAST:
            # the words stay where they are: a document's array is only looked at where a prefix matched
            both = prefix.join(contents, "window")
            found = spread.join(F.broadcast(both), "shingle").where(within).withColumn("start", start).where(same)
        else:
            found = scratch.put(spread.drop("words").join(prefix, "shingle").where(within).select("row", start.alias("start"), "span", "window"), f"candidates{width}")
            texts = rows.select("row", "words").join(found.select("row").distinct(), "row", "left_semi")
            found = found.join(texts, "row").join(contents, "window").where(same)
        hits.append(found.select("row", "start", "span", "window"))

    if not hits:
        return base.select("row", "key", F.col("n").cast("long").alias("n_words"), none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("items"))
    hits = scratch.put(reduce(DataFrame.union, hits), "hits")
    covered = hits.select("row", "start", "span").distinct().select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)).alias("pos")).distinct()
    covered = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", "window").distinct().join(owners, "window").where(F.col("item").isNotNull()).select("row", "item").distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    out = base.join(covered.join(named, "row", "left"), "row", "left")
    return out.select(
        "row", "key", F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )

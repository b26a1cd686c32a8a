"""Frame sequences over many rows: ranges, gaps and summaries.

Frames of a sequence are folded in two steps. First per block of 4096 frame numbers, where a
list is bounded by the block and Spark combines before the shuffle. Then an edge row of each
block is put in order by sequence; the blocks stay where they are. So one sequence that
holds a third of all rows spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import ranges
from pathloom.functions.names import base_name
from pathloom.operators.grouping import split_rows

BLOCK = 4096


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value that is never null, so that rows with null keys meet."""
    return F.struct(*[F.col(k) for k in keys])


def _block_edges(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of every block as ``__runs`` of ``{first, last, next}``, joined over block borders.

    ``blocks`` has one row per ``__key`` and block with the sorted frames in ``__frames``. ``next`` is the first frame
    after the gap that follows a run, null for the last run of a key. Only an edge row per block (five numbers)
    is sorted by key; blocks stay where they were grouped and take their edges from there.
    """
    order = Window.partitionBy("__key").orderBy("__block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("__local", ranges.islands(F.col("__frames"))).withColumns(
        {"__lo": F.array_min("__frames"), "__hi": F.array_max("__frames")}
    ).drop("__frames")
    edges = local.select(
        "__key", "__block", "__lo", "__hi", F.size("__local").alias("__n"), F.try_element_at("__local", F.lit(-1))["first"].alias("__open")
    ).withColumns({"__prev_hi": F.lag("__hi").over(order), "__next_lo": F.lead("__lo").over(order)})
    edges = edges.withColumn("__goes_on", F.coalesce(F.col("__prev_hi") == F.col("__lo") - 1, F.lit(False)))
    opened = F.when(~((F.col("__n") == 1) & F.col("__goes_on")), F.col("__open"))
    edges = edges.withColumn("__carry", F.last(opened, ignorenulls=True).over(earlier))
    edges = edges.select(F.col("__key").alias("__ekey"), F.col("__block").alias("__eblock"), "__next_lo", "__goes_on", "__carry")
    joined = local.join(edges, (F.col("__key") == F.col("__ekey")) & (F.col("__block") == F.col("__eblock")))
    n = F.size("__local")
    runs = F.transform(
        "__local",
        lambda r, i: F.struct(
            F.when((i == 0) & F.col("__goes_on"), F.col("__carry")).otherwise(r["first"]).alias("first"),
            r["last"].alias("last"),
            F.when(i < n - 1, F.get("__local", i + 1)["first"])
            .otherwise(F.col("__next_lo")).alias("next"),
        ),
    )
    closed = F.filter(runs, lambda r: r["next"].isNull() | (r["next"] > r["last"] + 1))
    held = [c for c in blocks.columns if c not in ("__key", "__frames")]
    return joined.withColumn("__runs", closed).select(
        *[F.col("__key")[k].alias(k) for k in keys], *held, "__lo", "__hi", "__runs"
    )


def _blocks_of_frames(df: DataFrame, keys: Sequence[str], frame: Column, aggs: Sequence[Column] = ()) -> DataFrame:
    rows = df.withColumns({"__frame": frame.cast("bigint"), "__hash": F.xxhash64(*[F.col(k) for k in keys])})
    # rows without a frame have a block of their own, before all others
    rows = rows.withColumn("__block", F.coalesce(F.floor(F.col("__frame") / BLOCK), F.lit(-(1 << 62))))
    return rows.groupBy("__hash", *keys, "__block").agg(
        F.array_sort(F.collect_set("__frame")).alias("__frames"), *aggs
    )


def united_intervals(df: DataFrame, keys: Sequence[str], first: str = "FIRSTFRAME", last: str = "LASTFRAME") -> DataFrame:
    """Intervals of a key that overlap or touch made one: ``keys``, ``first`` and ``last``, a row per union.

    A sweep over interval rows, without the numbers inside. Of intervals with equal starts the longest is kept
    before the shuffle, so a block of 4096 starts has as many rows at most, however many intervals there are. Within
    a block an interval opens a run where it begins beyond all that came before. Blocks hand on how far they
    reach and which run they leave open: one row per block is sorted by key.
    """
    rows = df.where(F.col(last) >= F.col(first)).groupBy(_key(keys).alias("__key"), F.col(first).alias("__f")).agg(F.max(last).alias("__l"))
    rows = rows.withColumn("__block", F.floor(F.col("__f") / BLOCK))
    inside = Window.partitionBy("__key", "__block").orderBy("__f")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    # what starts alone within its block, and how far the block reached before it
    local = rows.withColumn("__reach", F.max("__l").over(so_far))
    local = local.withColumn("__starts", F.coalesce(F.col("__f") > F.col("__reach") + 1, F.lit(True)))
    order = Window.partitionBy("__key").orderBy("__block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = local.groupBy("__key", "__block").agg(
        F.max("__l").alias("__hi"), F.max(F.when(F.col("__starts"), F.col("__f"))).alias("__open")
    ).withColumn("__before", F.max("__hi").over(earlier))
    # the block's last own start begins a run only if nothing before the block reaches it
    edges = edges.withColumn("__begun", F.when(F.coalesce(F.col("__open") > F.col("__before") + 1, F.lit(True)), F.col("__open")))
    edges = edges.withColumn("__carry", F.last("__begun", ignorenulls=True).over(earlier))
    edges = edges.select(F.col("__key").alias("__ekey"), F.col("__block").alias("__eblock"), "__before", "__carry")
    joined = local.join(edges, (F.col("__key") == F.col("__ekey")) & (F.col("__block") == F.col("__eblock")))
    begins = F.col("__starts") & F.coalesce(F.col("__f") > F.col("__before") + 1, F.lit(True))
    own = F.last(F.when(begins, F.col("__f")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = joined.select("__key", "__l", F.coalesce(own, F.col("__carry")).alias(first))
    return runs.groupBy("__key", first).agg(F.max("__l").alias(last)).select(*[F.col("__key")[k].alias(k) for k in keys], first, last)


def _edge_runs(blocks: DataFrame) -> DataFrame:
    """Per block its first and last run as ``__edges``, and as texts what lies between them.

    An edge is ``{block, first, last, span, gap}``: ``span`` are the runs up to the block's last one, ``gap`` the frames
    missing up to it, both null for the last run of a block. Inner runs cannot touch another block.
    """
    runs = F.col("__local")
    n = F.size(runs)
    inner = F.array_join(F.transform(F.slice(runs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda r: ranges.range_text(r["first"], r["last"])), ", ")
    gaps = F.array_join(
        F.transform(
            F.slice(runs, F.lit(1), F.greatest(n - 1, F.lit(0))),
            lambda r, i: ranges.range_text(r["last"] + 1, F.get(runs, i + 1)["first"] - 1),
        ), ", ",
    )

    def edge(run: Column, span: Column, gap: Column) -> Column:
        return F.struct(F.col("__block").alias("block"), run["first"].alias("first"), run["last"].alias("last"), span.alias("span"), gap.alias("gap"))

    none = F.lit(None).cast("string")
    alone = edge(F.get(runs, 0), none, none)
    edges = (
        F.when(n == 1, F.array(alone))
        .when(n > 1, F.array(edge(F.get(runs, 0), inner, gaps), edge(F.get(runs, n - 1), none, none)))
        .otherwise(F.slice(F.array(alone), 1, 0))
    )
    local = blocks.withColumns({"__count": F.size("__frames"), "__lo": F.get("__frames", 0), "__hi": F.get("__frames", F.size("__frames") - 1)})
    # most blocks are one run, which needs no walk over its frames
    whole = F.array(F.struct(F.col("__lo").alias("first"), F.col("__hi").alias("last")))
    dense = F.col("__hi") - F.col("__lo") + 1 == F.col("__count")
    local = local.withColumn("__local", F.when(dense, whole).otherwise(ranges.islands(F.col("__frames"))))
    return local.drop("__frames").withColumn("__edges", edges).drop("__local")


def _folded(df: DataFrame, keys: Sequence[str], frame: Column, partial: Sequence[Column], whole: Sequence[Column]) -> DataFrame:
    """Range and gap texts of every key as ``__span`` and ``__gap``, beside ``__lo``, ``__hi`` and ``__count``.

    Rows are folded per block, then the blocks' edge runs per key; both combine before the shuffle. ``partial`` are
    aggregates of a block, ``whole`` those of a key over them. Groups are led by a hash of their key, so that
    where Spark sorts rows to group them, it compares numbers and not long names.
    """
    blocks = _blocks_of_frames(df, keys, frame, partial)
    folded = _edge_runs(blocks).groupBy("__hash", *keys).agg(
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__count").alias("__count"),
        F.flatten(F.array_sort(F.collect_list("__edges"))).alias("__edges"), *whole,
    )
    edges = F.col("__edges")
    n = F.size(edges)
    opens = F.filter(edges, lambda r, i: (i == 0) | (F.get(edges, i - 1)["last"] < r["first"] - 1))
    closes = F.filter(edges, lambda r, i: (i == n - 1) | (F.get(edges, i + 1)["first"] > r["last"] + 1))
    only = F.get(edges, 0)
    joined = folded.withColumns({
        "__opens": F.when(n == 1, F.array(only["first"])).otherwise(F.transform(opens, lambda r: r["first"])),
        "__closes": F.when(n == 1, edges).otherwise(closes),
    })
    # the run of an edge with a span of its own ends there, for another of its block follows
    span = F.zip_with(
        "__opens", "__closes",
        lambda first, r: F.concat_ws(", ", ranges.range_text(first, r["last"]), F.when(r["span"] != "", r["span"])),
    )
    last = F.size("__opens") - 1
    gap = F.transform(
        F.slice("__closes", F.lit(1), F.greatest(last, F.lit(0))),
        lambda r, i: F.coalesce(r["gap"], ranges.range_text(r["last"] + 1, F.get("__opens", i + 1) - 1)),
    )
    texts = {
        "__span": F.when(n == 1, ranges.range_text(only["first"], only["last"])).otherwise(F.array_join(span, ", ")),
        "__gap": F.when(n == 1, F.lit("")).otherwise(F.array_join(gap, ", ")),
    }
    return joined.withColumns(texts).drop(
        "__hash", "__edges", "__opens", "__closes"
    )


def sequence_ranges(df: DataFrame, keys: Sequence[str], frame: Column) -> DataFrame:
    """One row per run of consecutive frames: ``FIRSTFRAME``, ``LASTFRAME`` and ``NEXTFRAME``.

    The long form of range and gap texts; it has no limit on runs per sequence.
    """
    blocks = _blocks_of_frames(df.where(frame.isNotNull()), keys, frame).select(_key(keys).alias("__key"), "__block", "__frames")
    edges = _block_edges(blocks, keys)
    return edges.select(*keys, F.inline("__runs").alias("FIRSTFRAME", "LASTFRAME", "NEXTFRAME"))


def frame_ranges(
    df: DataFrame, keys: Sequence[str], frame: Column, sums: Mapping[str, str] | None = None
) -> DataFrame:
    """Range text, gap text and frame counts per key, with sums of further columns."""
    sums = sums or {}
    folded = _folded(
        df.where(frame.isNotNull()), keys, frame,
        [F.sum(c).alias(f"__sum_{name}") for name, c in sums.items()],
        [F.sum(f"__sum_{name}").alias(f"__sum_{name}") for name in sums],
    )
    return folded.select(
        *keys, F.col("__lo").alias("FIRSTFRAME"), F.col("__hi").alias("LASTFRAME"), F.col("__count").alias("FRAMES"),
        (F.col("__hi") - F.col("__lo") + 1 - F.col("__count")).alias("MISSING"),
        F.col("__span").alias("FRAMERANGE"), F.col("__gap").alias("MISSINGFRAMES"),
        *[F.col(f"__sum_{name}").alias(name) for name in sums],
    )


def missing_frames(df: DataFrame, keys: Sequence[str], frame: Column) -> DataFrame:
    """Gaps between first and last frame, one row per gap."""
    runs = sequence_ranges(df, keys, frame).where(F.col("NEXTFRAME").isNotNull())
    return runs.select(
        *keys, (F.col("LASTFRAME") + 1).alias("FIRSTMISSING"), (F.col("NEXTFRAME") - 1).alias("LASTMISSING")
    )


def missing_count(df: DataFrame, keys: Sequence[str], frame: Column) -> DataFrame:
    """Expected minus present distinct frames per key."""
    distinct = df.select(*keys, frame.cast("bigint").alias("__f")).where("__f is not null").distinct()
    return distinct.groupBy(*keys).agg(
        (F.max("__f") - F.min("__f") + 1 - F.count(F.lit(1))).alias("MISSING")
    )


def union_ranges(df: DataFrame, keys: Sequence[str], text: Column, name: str = "MISSINGFRAMES") -> DataFrame:
    """Range texts of a group parsed, united and written again; no text gives a blank."""
    found = df.select(*keys, F.inline(ranges.parse_intervals(text)).alias("__first", "__last"))
    part = F.struct("__first", ranges.range_text(F.col("__first"), F.col("__last")).alias("t"))
    united = united_intervals(found, keys, "__first", "__last").groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ", ").alias("__text")
    )
    groups = df.select(*keys).distinct()
    renamed = united.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__text")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return groups.join(renamed, same, "left").select(
        *keys, F.coalesce("__text", F.lit("")).alias(name)
    )


def newest_row(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """All attributes of the row with the latest time of each group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(time, *ties)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*").select(*df.columns)


def merge_partial_sequences(df: DataFrame) -> DataFrame:
    """Partial rows of one sequence and padding made one row.

    First and last frame, gaps and sizes are combined, the creation time is the earliest, and
    the other fields come from the row created last. Single rows stay as they are.
    """
    keys = ["SEQUENCEFILENAME", "NUMBERPADDING"]
    merged = [c for c in ("FIRSTFRAME", "LASTFRAME", "TOTALSIZE", "CREATION_TIME", "MISSINGFRAMES") if c in df.columns]
    rest = [c for c in df.columns if c not in keys and c not in merged]
    base = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__none"))
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.max_by(base, F.struct("CREATION_TIME", *rest)).alias("__base"),
        F.min("FIRSTFRAME").alias("FIRSTFRAME"),
        F.max("LASTFRAME").alias("LASTFRAME"),
        F.sum("TOTALSIZE").alias("TOTALSIZE"),
        F.min("CREATION_TIME").alias("CREATION_TIME"),
        F.min("MISSINGFRAMES").alias("__text"),
    )
    gaps = union_ranges(df, keys, F.col("MISSINGFRAMES"), "__united").select(
        *[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], "__united"
    )
    same = [F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
    joined = stats.join(gaps, same, "left")
    text = F.when(F.col("__rows") == 1, F.col("__text")).otherwise(F.col("__united"))
    out = joined.withColumn("MISSINGFRAMES", text)
    return out.select(*[F.col(f"__base.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def summarize_sequences(
    df: DataFrame, order_by: Sequence[str] = ("FILE",), split_single: bool = False
) -> DataFrame:
    """One row per frame sequence; rows outside sequences pass through.

    Sizes are added, the creation time is the latest, ``FILE`` becomes the sequence name, and
    first frame, last frame, ranges and gaps are texts. ``SEQUENCEPOSITION`` becomes the range
    text. Other columns come from the first row by ``order_by``. With ``split_single``,
    sequences of one row get their real file name back and no frame columns.
    """
    key = "SEQUENCENAME"
    added = ["FIRSTFRAME", "LASTFRAME", "FRAMERANGE", "MISSINGFRAMES"]
    folded = [key, "SEQUENCEPOSITION", "FILESIZE", "CREATION_TIME"]
    rest = [c for c in df.columns if c not in folded and c not in added]
    members, plain = split_rows(df, F.coalesce(F.col(key), F.lit("")) != "")
    plain = plain.withColumns({c: F.lit(None).cast("string") for c in added}).withColumns(
        {
            "FILESIZE": F.col("FILESIZE").cast("string").try_cast("bigint"),
            "SEQUENCEPOSITION": F.col("SEQUENCEPOSITION").cast("string"),
        }
    )

    # a position cell may list several frames: count its row and size once
    positions = F.split(F.col("SEQUENCEPOSITION").cast("string"), ",")
    ordered = [c for c in dict.fromkeys(order_by)]
    others = [c for c in rest if c not in ordered]
    rows = (
        members.select(
            key, "CREATION_TIME", F.col("FILESIZE").cast("string").try_cast("bigint").alias("FILESIZE"),
            F.struct(*[F.col(c) for c in others], F.lit(0).alias("__none")).alias("__rest"), F.struct(*ordered).alias("__order"),
            F.posexplode_outer(positions).alias("__at", "__text"),
        )
        .withColumn("__once", F.coalesce(F.col("__at") == 0, F.lit(True)))
    )
    frame = F.when(F.col("__text").rlike(r"^\d+$"), F.col("__text").try_cast("bigint"))
    summed = (
        _folded(
            rows, [key], frame,
            [
                F.sum(F.when(F.col("__once"), F.col("FILESIZE"))).alias("__size"),
                F.max("CREATION_TIME").alias("__created"),
                F.sum(F.col("__once").cast("int")).alias("__rows"),
                F.min_by("__rest", "__order").alias("__base"),
                F.min("__order").alias("__first"),
            ],
            [
                F.min_by("__base", "__first").alias("__base"),
                F.min("__first").alias("__first"),
                F.coalesce(F.sum("__size"), F.lit(0)).alias("FILESIZE"),
                F.max("__created").alias("CREATION_TIME"),
                F.sum("__rows").alias("__rows"),
            ],
        )
        .withColumns({
            "FIRSTFRAME": F.coalesce(F.col("__lo").cast("string"), F.lit("")),
            "LASTFRAME": F.coalesce(F.col("__hi").cast("string"), F.lit("")),
            "FRAMERANGE": F.col("__span"), "MISSINGFRAMES": F.col("__gap"), "SEQUENCEPOSITION": F.col("__span"),
        })
    )
    # the order columns are those of the first row already
    base = {c: F.col("__first")[c] if c in ordered else F.col("__base")[c] for c in rest}
    single = (F.col("__rows") == 1) if split_single else F.lit(False)
    columns = [*df.columns, *[c for c in added if c not in df.columns]]
    picked = []
    for c in columns:
        if c == "FILE":
            value = F.when(single, base["FILE"]).otherwise(F.col(key))
        elif c in rest:
            value = base[c]
            if c == "PADDING":
                value = F.when(single, F.lit(None)).otherwise(value)
        elif c in added and split_single:
            value = F.when(single, F.lit(None)).otherwise(F.col(c))
        else:
            value = F.col(c)
        picked.append(value.alias(c))
    return summed.select(*picked).unionByName(plain.select(*columns))


def expand_sequences(df: DataFrame) -> DataFrame:
    """One row per frame: ``%0Nd`` filled in source, destination and target.

    Needs ``SRC, DEST, TARGET, ACTIONTYPE, NUMBEROFFRAMES, INPUTFIRSTFRAME, INCREMENT``.
    """
    steps = F.when(
        F.col("NUMBEROFFRAMES") > 0, F.sequence(F.lit(0), F.col("NUMBEROFFRAMES").cast("int") - 1)
    )
    step = F.coalesce(F.col("INCREMENT").cast("bigint"), F.lit(1))
    texts = ("SRC", "DEST", "TARGET")
    # what is the same for all frames of a row is worked out before there is a row per frame
    rows = df.withColumns({f"__{c}": frame_holders(F.col(c)) for c in texts})
    frames = rows.withColumn("__i", F.explode(steps)).withColumn(
        "__f", F.col("INPUTFIRSTFRAME").cast("bigint") + F.col("__i") * step
    )
    filled = [fill_frame(F.col(c), F.col("__f"), F.col(f"__{c}")).alias(c) for c in texts]
    return frames.select(*filled, F.col("ACTIONTYPE"), F.col("__f").alias("FRAME"))


def frame_holders(text: Column) -> Column:
    """Distinct ``%d`` and ``%0Nd`` of a text as ``{holder, width}``."""
    pads = F.array_distinct(F.regexp_extract_all(text, F.lit(r"%(\d*)d"), F.lit(1)))
    return F.transform(
        pads,
        lambda p: F.struct(
            F.concat(F.lit("%"), p, F.lit("d")).alias("holder"), F.coalesce(p.try_cast("int"), F.lit(0)).alias("width")
        ),
    )


def fill_frame(text: Column, frame: Column, holders: Column | None = None) -> Column:
    """``%d`` and ``%0Nd`` in a text replaced by the padded frame number.

    ``holders`` are those of ``frame_holders``, where they are known already. Up to two are filled by compiled
    code, further ones by a fold.
    """
    holders = frame_holders(text) if holders is None else holders
    digits = frame.cast("string")

    def put(done: Column, hit: Column) -> Column:
        return F.replace(done, hit["holder"], F.lpad(digits, F.greatest(hit["width"], F.length(digits)), "0"))

    count = F.size(holders)
    one = put(text, F.get(holders, 0))
    return (
        F.when(holders.isNull(), F.lit(None).cast("string")).when(count == 0, text).when(count == 1, one)
        .when(count == 2, put(one, F.get(holders, 1))).otherwise(F.aggregate(holders, text, put))
    )


def expand_ranges(df: DataFrame, link: str = "PROVISIONEDLINK") -> DataFrame:
    """Rows with a first frame become one row per frame in ``FILE`` and link; others pass."""
    first, last = (F.col(c).try_cast("bigint") for c in ("FIRSTFRAME", "LASTFRAME"))
    frames = F.when(
        first.isNotNull() & (last >= first), F.sequence(first, last)
    ).when(first.isNull(), F.array(F.lit(None).cast("bigint")))
    padding = F.col("PADDING").try_cast("int")
    rows = df.withColumn("FRAME", F.explode(frames))
    digits = F.col("FRAME").cast("string")
    shown = F.lpad(digits, F.greatest(padding, F.length(digits)), "0")
    holder = F.concat(F.lit("%0"), padding.cast("string"), F.lit("d"))

    def put(name: str) -> Column:
        filled = F.replace(F.col(name), holder, shown)
        return F.when(F.col("FRAME").isNull() | padding.isNull(), F.col(name)).otherwise(filled)

    return rows.withColumns({"FILE": put("FILE"), link: put(link)})

"""Bytes of documents that a long string covers which also starts elsewhere.

Method. A document's starts of ``length``-byte strings are cut into runs that share their anchor, the
96-byte gram of the string with the smallest hash. Equal strings have equal anchors, so only texts
below one anchor are compared, and anchors that occur once are never compared. The texts of anchors
that come more than once meet in one task, which builds their suffix array and Burrows-Wheeler
transform and expands intervals breadth first by backward extension: level by level this derives every
common prefix below ``length``, and stops there. Neighbours without a shorter common prefix are repeats.
Stretches of the texts go into the array only if the first and the last ``PROBE`` bytes of their strings
come twice among the texts of the task.

Of the texts only segments below anchors that come more than once are shuffled. Tasks read what was found for
their part of the input from the shared folder.

Bounds. A task compares blocks of at most ``BLOCK`` bytes plus one anchor's texts. An anchor with over
``HOT`` runs is split by a hash of each whole string, which keeps equal strings together.

Cases. Null and empty texts have no bytes and lose none; texts shorter than ``length`` lose none.
Repeated rows are repeats of each other. Null or repeated ids are kept as they are. An empty table
gives an empty table. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch, by_part, frugal, rows_beside, with_row
from pathloom.llm.textgrams import gram_hashes, window_minima

GRAM = 96
BLOCK = 1 << 19
HOT = 1_000_000
# bytes at both ends of a string that must come twice before it is compared
PROBE = 128
# bytes hashed at once, and of a text that is taken in pieces
SLICE = 128 << 10
PIECE = 4 << 20
# never part of a UTF-8 text
SENTINEL = b"\xff"
# place of a text that is a whole segment
WHOLE = -1
POSITION_BITS = 24


# --- suffix array and intervals -------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``data`` in order of their first ``depth`` bytes at least.

    Ranks by 8 bytes are put together to ranks by three times as many, as long as three ranks fit a
    word, and by twice as many beyond.
    """
    n = len(data)
    ring = np.concatenate([data, np.resize(data, 8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= ring[j : j + n]
    order = np.argsort(key).astype(np.int32)
    open_rows = np.arange(n, dtype=np.int32)
    head, tied = _ranks(key[order], open_rows)
    rank = np.empty(n, np.int32)
    rank[order] = head
    open_rows = open_rows[tied]
    reach, joined = 8, 3 if n <= 1 << 21 else 2
    bits = np.uint64(64 // joined)
    while reach < depth and len(open_rows):
        at = order[open_rows]
        key = head[open_rows].astype(np.uint64)
        for j in range(1, joined):
            follow = (at + np.int32(j * reach % n)) % n
            key <<= bits
            key |= rank[follow].astype(np.uint64)
        by = np.argsort(key)
        order[open_rows] = at = at[by]
        heads, tied = _ranks(key[by], open_rows)
        head[open_rows] = heads
        rank[at] = heads
        open_rows = open_rows[tied]
        reach *= joined
    return order


def _ranks(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of ``rows`` with the same key as each, and whether another one has that key."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    heads = np.maximum.accumulate(np.where(fresh, rows, np.int32(0)))
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    return heads, tied


def bounded_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix array, whether it shares ``length`` bytes with the row before.

    Level by level, intervals of rows with a common string are extended backwards by the bytes before
    them. The end of a new interval has the level as its common prefix; what is still open at
    ``length`` shares at least that much.
    """
    n = len(data)
    before = data[order - 1]
    by_byte = np.argsort(before, kind="stable").astype(np.int32)  # rows in the order of the suffixes one byte longer
    byte = before[by_byte]
    new_byte = np.append(True, byte[1:] != byte[:-1])
    step = np.empty(n, np.int32)
    step[by_byte] = np.arange(n, dtype=np.int32)
    short = np.zeros(n + 1, bool)
    short[0] = short[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        if total > n // 6:
            # most rows take part: pass over all of them instead of sorting
            edge = np.zeros(n + 1, np.int32)
            edge[low] = np.arange(1, len(low) + 1)
            inside = np.zeros(n + 1, np.int8)
            inside[low] += 1
            inside[high] -= 1
            held = np.cumsum(inside[:n], dtype=np.int8).view(bool)
            owner = np.where(held, np.maximum.accumulate(edge[:n]), 0)
            which = owner[by_byte]
            first = new_byte.copy()
            first[1:] |= which[1:] != which[:-1]
            start = np.flatnonzero(first)
            end = np.append(start[1:], n)
            real = which[start] > 0
            new_low, new_high = start[real], end[real]
        else:
            which = np.repeat(np.arange(len(low), dtype=np.int64), size)
            rows = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
            key = step[rows].astype(np.int64) << 32 | which
            key.sort()
            rows = key >> 32
            which = key & 0xFFFFFFFF
            first = np.ones(total, bool)
            first[1:] = (rows[1:] != rows[:-1] + 1) | (which[1:] != which[:-1]) | new_byte[rows[1:]]
            start = np.flatnonzero(first)
            new_low = rows[start]
            new_high = rows[np.append(start[1:], total) - 1] + 1
        new = ~short[new_high]
        low, high = new_low[new], new_high[new]
        short[high] = True
    return ~short[:n]


def repeats(texts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, which of its ``length``-byte strings also start elsewhere in ``texts``.

    A text with a count above one stands for as many equal texts.
    """
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"".join(t + SENTINEL for t in texts), np.uint8)
    live = _candidates(data, begins, begins + sizes - length + 1, length)
    hit = np.zeros(len(data), bool)
    if len(live):
        edge = np.zeros(len(data) + 1, np.int32)
        edge[live] += 1
        edge[live + length] -= 1
        cover = np.cumsum(edge[:-1]) > 0
        # each covered run, and one byte after it that ends it
        taken = cover.copy()
        taken[1:] |= cover[:-1]
        rows = np.flatnonzero(taken)
        small = np.where(cover[rows], data[rows], np.uint8(SENTINEL[0]))
        order = suffix_array(small, length)
        shared = bounded_prefixes(small, order, length)
        twice = shared.copy()
        twice[:-1] |= shared[1:]
        hit[rows[order[twice]]] = True
        # a string that runs over the end of its run is none of a text
        inside = np.zeros(len(data), bool)
        inside[live] = True
        hit &= inside
    out = []
    for begin, size, count in zip(begins.tolist(), sizes.tolist(), counts):
        found = hit[begin : begin + size - length + 1]
        out.append(np.ones(len(found), bool) if count > 1 else found)
    return out


def _candidates(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Starts from ``begins`` to ``ends`` whose string may come twice: its first and its last ``PROBE`` bytes do.

    Grams are counted by a part of their hash, so some starts stay that could go; none is lost.
    """
    edge = np.zeros(len(data) + 1, np.int32)
    edge[begins] += 1
    edge[ends] -= 1
    starts = np.flatnonzero(np.cumsum(edge))
    size = min(PROBE, length)
    grams = gram_hashes(data, size)
    slot = np.uint64(64 - max(20, len(starts).bit_length() + 2))
    for shift in (0, length - size):
        keys = (grams[starts + shift] >> slot).astype(np.int64)
        if len(keys):
            starts = starts[np.bincount(keys)[keys] > 1]
    return starts


# --- anchors --------------------------------------------------------------------------------


def _runs(data, starts, ends, length):
    """Runs of all texts of a block: number of the text, first start, end of starts, anchor, occurrences."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none
    grams = gram_hashes(data, GRAM)
    width = length - GRAM + 1
    where = np.uint64((1 << POSITION_BITS) - 1)
    least = window_minima((grams & ~where) | np.arange(len(grams), dtype=np.uint64), width)
    place = (least & where).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)[: len(place)]
    valid = np.arange(len(place)) + length <= ends[owner]
    anchor = grams[place]
    cut = np.ones(len(place), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    # runs of repetitive texts end at multiples of 512, so that a segment stays short
    local = np.arange(len(place)) - starts[owner]
    cut |= local % 512 == 0
    moved = cut.copy()
    moved[1:] |= place[1:] != place[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(place))
    seen = np.add.reduceat(moved, first) if len(first) else none
    good = valid[first]
    first, last, seen = first[good], last[good], seen[good]
    return owner[first], first, last, anchor[first], seen


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Texts in blocks: text number and place of each piece, bytes, starts and ends.

    A text above ``PIECE`` bytes is taken in pieces that overlap, so each start lies in one piece.
    """
    owners: list[int] = []
    places: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for place in range(0, max(len(text) - length + 1, 0), PIECE):
            piece = text[place : place + PIECE + length - 1] if len(text) > PIECE else text
            owners.append(i)
            places.append(place)
            pieces.append(piece)
            size += len(piece)
            if size >= SLICE:
                yield _joined(owners, places, pieces)
                owners, places, pieces, size = [], [], [], 0
    if pieces:
        yield _joined(owners, places, pieces)


def _joined(owners, places, pieces):
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    return np.array(owners), np.array(places), np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends


def _texts(column: pa.Array) -> list[bytes]:
    return column.fill_null(b"").to_pylist() if column.null_count else column.to_pylist()


def _anchor_counts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in (x for whole in batches for x in by_part(whole)):
            found = [_runs(data, starts, ends, length)[3:] for _, _, data, starts, ends in _blocks(_texts(batch["text"]), length)]
            if not found:
                continue
            anchor, seen = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(anchor)
            anchor, seen = anchor[by], seen[by]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else by
            yield pa.record_batch({
                "anchor": anchor[first].view(np.int64),
                "part": np.full(len(first), part, np.int32),
                "n": np.add.reduceat(seen, first).astype(np.int64) if len(first) else seen.astype(np.int64),
            })

    return run


class _Segments:
    """The segments of a part whose anchor comes more than once."""

    def __init__(self, folder: str, part: int, length: int):
        found = rows_beside(folder, part, ["anchor", "splits"])
        self.length = length
        if found is None:
            self.anchors = np.zeros(0, np.uint64)
            self.splits = np.zeros(0, np.int64)
            return
        anchors = found["anchor"].to_numpy().view(np.uint64)
        by = np.argsort(anchors)
        self.anchors, self.splits = anchors[by], found["splits"].to_numpy()[by]

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Text number, first start, anchor, splits and bytes of each segment."""
        if not len(self.anchors):
            return
        rest = self.length - 1
        for owners, places, data, starts, ends in _blocks(texts, self.length):
            owner, first, last, anchor, _ = _runs(data, starts, ends, self.length)
            spot = np.searchsorted(self.anchors, anchor)
            spot[spot == len(self.anchors)] = 0
            keep = self.anchors[spot] == anchor
            owner, first, last, anchor, spot = owner[keep], first[keep], last[keep], anchor[keep], spot[keep]
            raw = data.tobytes()
            local = first - starts[owner] + places[owner]
            pieces = [raw[f : t + rest] for f, t in zip(first.tolist(), last.tolist())]
            yield from zip(owners[owner].tolist(), local.tolist(), anchor.view(np.int64).tolist(), self.splits[spot].tolist(), pieces)


def _segment_rows(folder: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, known = None, -1
        for part, batch in (x for whole in batches for x in by_part(whole)):
            if part != known:
                segments, known = _Segments(folder, part, length), part
            rows: dict[bytes, list] = {}
            for _, _, anchor, splits, piece in segments.of(_texts(batch["text"])):
                row = rows.get(piece)
                if row is None:
                    rows[piece] = [anchor, splits, 1]
                else:
                    row[2] += 1
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for piece, (anchor, splits, n) in rows.items():
                name = xxhash.xxh3_128_digest(piece)
                if splits <= 1:
                    texts = [(0, WHOLE, piece)]
                else:
                    texts = [(xxhash.xxh3_64_intdigest(w := piece[i : i + length]) % splits, i, w) for i in range(len(piece) - length + 1)]
                for salt, i, text in texts:
                    for column, value in zip(out, (anchor, salt, name, i, text, n)):
                        column.append(value)
            if out[0]:
                yield pa.record_batch({
                    "anchor": pa.array(out[0], pa.int64()), "salt": pa.array(out[1], pa.int32()),
                    "part": pa.array([part] * len(out[0]), pa.int32()), "name": pa.array(out[2], pa.binary()),
                    "at": pa.array(out[3], pa.int32()), "text": pa.array(out[4], pa.binary()), "n": pa.array(out[5], pa.int64()),
                })

    return run


def _compare(length: int):
    """Groups come sorted by anchor, salt and text, so equal texts are neighbours."""

    def block(group, texts, counts, members):
        marks: list = [None] * len(texts)
        many = []
        for i, n in enumerate(counts):
            alone = (i == 0 or group[i - 1] != group[i]) and (i + 1 == len(texts) or group[i + 1] != group[i])
            if alone and n > 1:
                # copies of one text, and nothing to compare it with
                marks[i] = np.ones(len(texts[i]) - length + 1, bool)
            else:
                many.append(i)
        if many:
            for i, mark in zip(many, repeats([texts[i] for i in many], np.array([counts[i] for i in many]), length)):
                marks[i] = mark
        out: tuple[list, ...] = ([], [], [], [])
        for i, mark in enumerate(marks):
            if not mark.any():
                continue
            bits = np.packbits(mark).tobytes()
            for member in members[i]:
                for column, value in zip(out, (*member, bits)):
                    column.append(value)
        return pa.record_batch({
            "part": pa.array(out[0], pa.int32()), "name": pa.array(out[1], pa.binary()),
            "at": pa.array(out[2], pa.int32()), "bits": pa.array(out[3], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        texts: list[bytes] = []
        counts: list[int] = []
        members: list[list] = []
        size, last = 0, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("anchor", "salt", "text", "part", "name", "at", "n")]
            for anchor, salt, text, part, name, at, n in zip(*columns):
                key = (anchor, salt)
                if key != last and size >= BLOCK:
                    yield block(group, texts, counts, members)
                    group, texts, counts, members, size = [], [], [], [], 0
                if key == last and texts and texts[-1] == text:
                    counts[-1] += n
                    members[-1].append((part, name, at))
                else:
                    group.append(key)
                    texts.append(text)
                    counts.append(n)
                    members.append([(part, name, at)])
                    size += len(text)
                last = key
        if texts:
            yield block(group, texts, counts, members)

    return run


# --- spans ----------------------------------------------------------------------------------


def _spans(anchors: str, marks: str, length: int, keep: list[str], characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, known, last = None, {}, -1
        for part, batch in (x for whole in batches for x in by_part(whole)):
            if part != last:
                segments, last = _Segments(anchors, part, length), part
                known = _marks(rows_beside(marks, part, ["name", "at", "bits"]))
            texts = _texts(batch["text"])
            covers: dict[int, np.ndarray] = {}
            for owner, first, _, _, piece in segments.of(texts):
                for at, bits in known.get(xxhash.xxh3_128_digest(piece), ()):
                    width = len(piece) - length + 1 if at == WHOLE else 1
                    mark = np.unpackbits(np.frombuffer(bits, np.uint8), count=width)
                    cover = covers.get(owner)
                    if cover is None:
                        cover = covers[owner] = np.zeros(len(texts[owner]), bool)
                    begin = first + max(at, 0)
                    cover[begin : begin + width] |= mark.view(bool)
            kept, spans = [], []
            for i, text in enumerate(texts):
                found = _cover(covers[i], length) if i in covers else []
                if characters:
                    found = _whole_characters(text, found)
                spans.append(found)
                kept.append(_without(text, found))
            columns = {c: batch[c] for c in keep}
            columns["text"] = batch["text"]
            columns["kept"] = pa.array(kept, pa.binary())
            columns["spans"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch(columns)

    return run


def _marks(table: pa.Table | None) -> dict[bytes, list[tuple[int, bytes]]]:
    """Marked starts of each segment: one entry for a whole segment, or one for each of its strings."""
    out: dict[bytes, dict] = {}
    if table is not None:
        for name, at, bits in zip(*(table[c].to_pylist() for c in ("name", "at", "bits"))):
            out.setdefault(name, {})[at] = bits
    return {name: list(found.items()) for name, found in out.items()}


def _cover(starts: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of bytes covered by strings that start at the marked places."""
    at = np.flatnonzero(starts)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    begin = at[np.append(0, gap + 1)]
    end = at[np.append(gap, len(at) - 1)] + length
    return [{"start": int(b), "end": int(e)} for b, e in zip(begin, end)]


def _whole_characters(text: bytes, spans: list[dict]) -> list[dict]:
    """Spans without the bytes of characters that they cover in part."""
    out = []
    for span in spans:
        begin, end = span["start"], span["end"]
        while begin < end and text[begin] & 0xC0 == 0x80:
            begin += 1
        while begin < end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append({"start": begin, "end": end})
    return out


def _without(text: bytes, spans: list[dict]) -> bytes:
    if not spans:
        return text
    out, at = [], 0
    for span in spans:
        out.append(text[at : span["start"]])
        at = span["end"]
    return b"".join([*out, text[at:]])


def repeated_spans(
    docs: DataFrame, text: str | Column = "text", keep: list[str] = ("doc_id",), length: int = 200,
    hot: int = HOT, characters: bool = False,
) -> DataFrame:
    """Columns ``keep`` of each document, ``text`` and ``kept`` (binary), and ``spans``, the removed bytes.

    ``length`` is above ``GRAM``. ``characters``: only whole characters are removed, so that ``kept`` is UTF-8.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    clash = {"text", "kept", "spans"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    scratch = Scratch(docs.sparkSession, "suffix")
    names = [f"k{i}" for i in range(len(keep))]
    source = F.col(text) if isinstance(text, str) else text
    columns = [*(F.col(c).alias(n) for c, n in zip(keep, names)), source.cast("binary").alias("text")]
    rows = with_row(docs, columns, scratch)
    bare = rows.select("row", "text")
    counts = scratch.put(bare.mapInArrow(frugal(_anchor_counts(length)), "anchor long, part int, n long"), "anchors")
    twice = counts.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1")
    splits = F.ceil(F.col("total") / F.lit(hot)).cast("long")
    found = counts.join(twice, "anchor").select("part", "anchor", splits.alias("splits"))
    anchors = scratch.beside(found, "found")
    scratch.drop("anchors")
    segments = bare.mapInArrow(
        frugal(_segment_rows(anchors, length)),
        "anchor long, salt int, part int, name binary, at int, text binary, n long",
    )
    grouped = segments.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "text")
    marks = grouped.mapInArrow(frugal(_compare(length)), "part int, name binary, at int, bits binary")
    marks = scratch.beside(marks, "marks")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{n} {fields[n]}" for n in names)
    out = rows.mapInArrow(
        frugal(_spans(anchors, marks, length, names, characters)),
        f"{schema}, text binary, kept binary, spans array<struct<start: bigint, end: bigint>>",
    )
    return out.withColumnsRenamed(dict(zip(names, keep)))

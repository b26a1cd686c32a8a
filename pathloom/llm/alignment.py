"""Two tokenizers' tokens aligned by where they end, with corpus-wide counts of the pairs they form.

Method, in Arrow tables inside each task. Neither tokenizer joins what stands before a space with the space, so texts
are taken in units, a word with the white space before it, and a worker encodes each distinct unit once. Ids of a slice of texts are flattened, each with the index of its text;
byte lengths of the ids are summed within each text, so a token's key is its text and the byte where it ends. An
Acero hash join of both tokenizers' tables on that key gives the links. Ends that both share cut the text into
groups. ``Table.group_by`` counts the pairs per text and per part of the input (``PART_BYTES`` of text at most).

Spark adds the partial counts up by pair. A pair that most documents hold comes once per part there, not once
per document. Each part then gets the totals of its own pairs, and its documents look their links up in them;
what is shuffled per document is one row with its distinct pairs.

Only the best count of each id of the second tokenizer is broadcast: one row per entry of its vocabulary.

Cases. Null and empty texts have no tokens, nor have texts that the bytes of the tokens of either tokenizer do not
give back (one that normalises, or the mark U+2581 in a text). Rows with equal or null keys are documents of their
own. Special tokens' strings inside texts are plain text. Very long texts are encoded whole. An empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.scratch import Scratch, frugal, give_back

# bytes of text that are encoded at once, and that share a part
SLICE_BYTES = 1 << 20
PART_BYTES = 24 << 20
# entries of a vocabulary up to which a row each may be broadcast
VOCABULARY = 1 << 20
# units that a worker remembers; it starts afresh beyond
MAX_UNITS = 200_000
# bits of a key that hold the place of an end
END_BITS = 40
DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"

_aligners: dict[tuple[str, str], "Aligner"] = {}


def aligner(first: str, second: str) -> "Aligner":
    """The worker's aligner for two tokenizer files."""
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def byte_of_character() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others in turn from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Tokens of texts by two tokenizers: byte-level (a ``tokenizers`` file) and pieces (a ``sentencepiece`` file)."""

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._first = Tokenizer.from_file(first)
        self._first.encode_special_tokens = True
        self._second = sentencepiece.SentencePieceProcessor(model_file=second)
        byte_of = byte_of_character()
        self.size_a = self._first.get_vocab_size(with_added_tokens=True)
        self.size_b = self._second.get_piece_size()
        entries = [self._first.id_to_token(i) or "" for i in range(self.size_a)]
        self.bytes_a = pa.array([bytes(byte_of[c] for c in e) for e in entries], pa.binary())
        self.bytes_b = pa.array([self._piece(i) for i in range(self.size_b)], pa.binary())
        self._length_a = pc.binary_length(self.bytes_a).cast(pa.int64())
        self._length_b = pc.binary_length(self.bytes_b).cast(pa.int64())
        a, b = range(self.size_a), range(self.size_b)
        pieces = (self._second.id_to_piece(i) for i in range(self.size_b))
        splits = getattr(self._first.pre_tokenizer, "use_regex", False) and not self._first.pre_tokenizer.add_prefix_space
        self.by_unit = bool(splits) and not any("▁" in p.lstrip("▁") for p in pieces)
        self._forget()
        self._texts = pa.array([
            *(f"{i}," for i in a), *(f"{i}|" for i in a), *(f"{i}," for i in b), *(f"{i};" for i in b), *(f"{i}" for i in b),
        ], pa.large_string())

    def _piece(self, i: int) -> bytes:
        piece = self._second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self._second.is_byte(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._known = [array("i"), array("i")]
        self._sizes = [array("i"), array("i")]

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text, by both."""
        a = [e.ids for e in self._first.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        return a, self._second.encode(texts, num_threads=1)

    def _learn(self, units: list[str]) -> np.ndarray:
        """Code of each unit; new ones are encoded."""
        if len(self._code) > MAX_UNITS:
            self._forget()
        code = self._code
        new = list(dict.fromkeys(u for u in units if u not in code))
        code.update(zip(new, range(len(code), len(code) + len(new))))
        for known, sizes, found in zip(self._known, self._sizes, self._encode(new)):
            for ids in found:
                known.extend(ids)
                sizes.append(len(ids))
        return np.fromiter((code[u] for u in units), np.int64, len(units))

    def _lists_by_unit(self, texts: list[str]) -> list[pa.ListArray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat = split.flatten().dictionary_encode()
        words, which = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        # a space is a border where something printable, no mark for a space, stands before it and something behind it
        closed = np.fromiter((w != "" and w[-1] != "▁" and w[-1].isprintable() for w in words), bool, len(words))
        filled = np.fromiter((w != "" for w in words), bool, len(words))
        begins = np.append(True, closed[which[:-1]]) & filled[which] if len(which) else np.zeros(0, bool)
        begins[offsets[:-1]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(which)))
        units = which[first]
        for i in np.flatnonzero(size > 1).tolist():
            units[i] = len(words)
            words.append(" ".join(words[w] for w in which[first[i] : first[i] + size[i]]))
        codes = self._learn(words)[units]
        ends = np.cumsum(begins)[offsets[1:] - 1]
        out = []
        for known, sizes in zip(self._known, self._sizes):
            ids, each = np.frombuffer(known, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)
            begin = (np.cumsum(each) - each)[codes]
            each = each[codes]
            after = np.cumsum(each)
            taken = ids[np.arange(after[-1]) + np.repeat(begin - (after - each), each)]
            edges = np.append(0, after)[np.append(0, ends)].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(taken)))
        return out

    def _ids(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both, empty where the bytes of one do not give space and text."""
        a, b = self._lists_by_unit(texts) if self.by_unit else map(_lists, self._encode(texts))
        wanted = pa.array([f" {t}".encode() for t in texts], pa.large_binary())
        good = pa.array([bool(t) for t in texts])
        for ids, known in ((a, self.bytes_a), (b, self.bytes_b)):
            pieces = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), known.take(ids.values).cast(pa.large_binary()))
            good = pc.and_(good, pc.equal(pc.binary_join(pieces, pa.scalar(b"", pa.large_binary())), wanted))
        none = pa.array([[]], pa.list_(pa.int32()))
        return tuple(x if pc.all(good).as_py() else pc.if_else(good, x, none[0]) for x in (a, b))

    def align(self, texts: list[str]) -> tuple[pa.Table, pa.Table]:
        """A row per text (counts and digest), and ``doc``, ``pair``, ``n``: how often a text links each pair."""
        a, b = self._ids(texts)
        sides = []
        for ids, lengths, name in ((a, self._length_a, "a"), (b, self._length_b, "b")):
            flat, doc = ids.flatten(), pc.list_parent_indices(ids).cast(pa.int64())
            ends = _ends_within(lengths.take(flat), ids)
            key = pc.bit_wise_or(pc.shift_left(doc, END_BITS), ends)
            sides.append(pa.table({"key": key, name: flat.cast(pa.int64()), f"{name}_at": pa.array(np.arange(len(flat)))}))
        links = sides[0].join(sides[1], "key", join_type="inner", use_threads=False)
        doc = pc.shift_right(links["key"], END_BITS)
        pair = pc.add(pc.multiply(links["a"], self.size_b), links["b"])
        pairs = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        pairs = pairs.rename_columns(["doc", "pair", "n"])

        count = len(texts)
        per_doc = np.bincount(doc.to_numpy(), minlength=count) if len(doc) else np.zeros(count, np.int64)
        groups = self._groups(a, b, links["a_at"].to_numpy(), links["b_at"].to_numpy())
        rows = pa.table({
            "n_a": pc.list_value_length(a).cast(pa.int64()), "n_b": pc.list_value_length(b).cast(pa.int64()),
            # tokens have bytes, so a shared end is the end of one token on each side
            "n_groups": pa.array(per_doc, pa.int64()), "n_links": pa.array(per_doc, pa.int64()),
            "groups_sha256": pa.array([sha256(g.as_buffer()).hexdigest() if len(g.as_buffer() or b"") else "" for g in groups], pa.string()),
        })
        return rows, pairs

    def _groups(self, a: pa.ListArray, b: pa.ListArray, at_a: np.ndarray, at_b: np.ndarray) -> pa.Array:
        """Groups of each text as text: ids of the first, a bar, ids of the second; groups between semicolons."""
        ids_a, ids_b = a.flatten().to_numpy().astype(np.int64), b.flatten().to_numpy().astype(np.int64)
        cut_a, cut_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        cut_a[at_a], cut_b[at_b] = True, True
        ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        # texts end in a shared end, so groups are numbered through all texts
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        spot_a = np.arange(len(ids_a)) + np.append(0, ends_b)[group_a]
        spot_b = np.arange(len(ids_b)) + ends_a[group_b] if len(ids_b) else np.zeros(0, np.int64)
        last = np.zeros(len(ids_b), bool)
        ends = np.cumsum(pc.list_value_length(b).to_numpy())
        last[ends[pc.list_value_length(b).to_numpy() > 0] - 1] = True
        which = np.empty(len(ids_a) + len(ids_b), np.int64)
        which[spot_a] = ids_a + self.size_a * cut_a
        which[spot_b] = ids_b + 2 * self.size_a + self.size_b * np.where(last, 2, cut_b)
        sizes = pc.list_value_length(a).to_numpy().astype(np.int64) + pc.list_value_length(b).to_numpy()
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), self._texts.take(pa.array(which)))
        return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _ends_within(lengths: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Sum of lengths up to each element, from the start of its list."""
    total = pc.cumulative_sum(lengths)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.append(0, total.to_numpy())[offsets[:-1]] if len(lists) else np.zeros(0, np.int64)
    return pc.subtract(total, pa.array(before, pa.int64()).take(pc.list_parent_indices(lists)))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts of about ``SLICE_BYTES`` together, with the number of the first; null as empty."""
    at, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def _as_lists(pairs: pa.Table, count: int, code: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """``pair`` and ``n`` of each document as lists."""
    doc = pairs["doc"].to_numpy()
    order = np.argsort(doc, kind="stable")
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=count))).astype(np.int32))
    taken = pairs.take(pa.array(order))
    return tuple(pa.ListArray.from_arrays(offsets, taken[c].combine_chunks().cast(kind)) for c, kind in (("pair", code), ("n", pa.int32())))


def _aligned(first: str, second: str, code: pa.DataType, part_bytes: int):
    """A row per document, and rows with the pair counts of each part."""
    lists = pa.list_(code), pa.list_(pa.int32())

    def counts(part: int, partial: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(partial).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        for at in range(0, whole.num_rows, 8192):
            some = whole.slice(at, 8192)
            n = some.num_rows
            columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), some[c].combine_chunks().cast(k)) for c, k in (("pair", code), ("n_sum", pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([part]), *columns], ["part", "part_pairs", "part_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(first, second)
        part, size, partial = TaskContext.get().partitionId() << 24, 0, []
        shape = None
        for batch in batches:
            keys = batch["key"]
            if shape is None:
                documents = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
                shape = pa.schema([
                    ("part", pa.int64()), ("key", keys.type), *documents, ("pairs", lists[0]), ("counts", lists[1]),
                    ("part_pairs", lists[0]), ("part_counts", pa.list_(pa.int64())),
                ])

            def filled(found: pa.RecordBatch) -> pa.RecordBatch:
                names = found.schema.names
                return pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in names else pa.nulls(found.num_rows, f.type) for f in shape], schema=shape)

            for at, texts in _slices(batch["text"].to_pylist()):
                rows, pairs = tokens.align(texts)
                found, often = _as_lists(pairs, len(texts), code)
                columns = {"part": pa.array([part] * len(texts), pa.int64()), "key": keys.slice(at, len(texts)), "pairs": found, "counts": often}
                columns |= {c: rows[c].combine_chunks() for c in rows.column_names}
                yield filled(pa.RecordBatch.from_pydict(columns))
                partial.append(pairs.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]))
                size += sum(map(len, texts))
                if size >= part_bytes:
                    yield from map(filled, counts(part, partial))
                    part, size, partial = part + 1, 0, []
        if partial:
            yield from map(filled, counts(part, partial))

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the sums over their links. A part's totals come before its documents.

    All texts are encoded by now, so a worker that encoded some forgets the tokenizers and the units it knew.
    """
    if _aligners:
        _aligners.clear()
        give_back()
    part, pairs, totals, best, ready = None, [], [], [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch["part"].to_numpy()
        lookup = batch["pairs"].is_null().to_numpy(zero_copy_only=False)
        change = np.flatnonzero((parts[1:] != parts[:-1]) | (lookup[1:] != lookup[:-1])) + 1
        for begin, end in zip([0, *change.tolist()], [*change.tolist(), len(parts)]):
            some = batch.slice(begin, end - begin)
            if parts[begin] != part:
                part, pairs, totals, best, ready = parts[begin], [], [], [], False
            if lookup[begin]:
                for held, name in ((pairs, "pair"), (totals, "total"), (best, "best")):
                    held.append(some[name].to_numpy(zero_copy_only=False))
                continue
            if pairs and not ready:
                order = np.argsort(whole := np.concatenate(pairs))
                pairs, totals, best = [whole[order]], [np.concatenate(totals)[order]], [np.concatenate(best)[order]]
                ready = True
            sums = [np.zeros(end - begin, np.int64)] * 2
            if pairs:
                found = np.searchsorted(pairs[0], some["pairs"].flatten().to_numpy())
                often = some["counts"].flatten().to_numpy().astype(np.int64)
                edges = np.append(0, np.cumsum(pc.list_value_length(some["pairs"]).to_numpy()))
                sums = [np.diff(np.append(0, np.cumsum(x))[edges]) for x in (often * best[0][found], often * totals[0][found])]
            names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(some[c] for c in names), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], [*names, "n_best", "count_sum"]
            )


def align(
    docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str | Column = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per document ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` and ``count_sum``.

    ``first`` is a byte-level tokenizer file, ``second`` a piece model. ``count_sum`` adds up, over a document's links, how
    often the whole corpus links that pair; ``n_best`` are the links with the highest such count of their second id.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    size_a, size_b = (n := aligner(first, second)).size_a, n.size_b
    narrow = size_a * size_b < 1 << 31
    code, kind = (pa.int32(), "int") if narrow else (pa.int64(), "bigint")
    source = F.col(text) if isinstance(text, str) else text
    table = docs.select(F.col(key).alias("key"), source.cast("string").alias("text"))
    of_key = table.schema["key"].dataType.simpleString()
    lists = f"pairs array<{kind}>, counts array<int>, part_pairs array<{kind}>, part_counts array<bigint>"
    found = scratch.put(table.mapInArrow(frugal(_aligned(first, second, code, part_bytes)), f"part long, key {of_key}, {DOCUMENT}, {lists}"), "aligned")

    partial = found.where("part_pairs IS NOT NULL").select("part", F.inline(F.arrays_zip("part_pairs", "part_counts"))).toDF("part", "pair", "n")
    totals = scratch.put(partial.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    of_b = F.pmod("pair", F.lit(size_b))
    best = totals.groupBy(of_b.alias("b")).agg(F.max("total").alias("highest"))
    best = F.broadcast(best) if size_b <= VOCABULARY else best
    marked = totals.join(best, of_b == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    needed = partial.select("part", "pair").join(marked, "pair")

    documents = found.where("pairs IS NOT NULL").drop("part_pairs", "part_counts")
    both = documents.unionByName(needed, allowMissingColumns=True)
    # nulls first: totals of a part stand before its documents
    ordered = both.repartition("part").sortWithinPartitions("part", F.col("pairs").isNotNull())
    out = ordered.mapInArrow(_looked_up, f"key {of_key}, {DOCUMENT}, n_best long, count_sum long")
    return out.withColumnRenamed("key", key)

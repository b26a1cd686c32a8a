"""Toxicity by subword embeddings averaged into a linear softmax.

Method. A word stands for its character n-grams, each hashed to a bucket with a vector. A document is the
weighted average of the vectors of all subwords of its distinct words, and a linear softmax over two classes
is put on top. A subword in ``h`` of ``n`` rows of the sample weighs ``log((n + 1) / (h + 1)) ** 2 * h / (h + 20)``:
little if most rows hold it, little if hardly one does, and nothing is left out. Vectors and softmax are trained jointly in numpy, on a bounded sample of labelled rows, by
adaptive gradient steps. A misspelling that was never seen shares most n-grams with the word it is made
of, so it shares most of its vector. For scoring, vectors and softmax fold into one number a bucket, which
changes nothing in the result, and each distinct word is looked up once per worker.

Fit. At most ``sample`` rows of each label, those with the smallest hash of their text, and no more once
their texts reach ``sample_bytes``; whole texts. Their distinct buckets with counts are what reaches the
driver, at most ``BUCKETS`` a row. Scoring has no bound.

Cases. A null, empty or wordless text scores what the bias alone gives. Repeated rows score alike. Without
labelled rows of both labels every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 17
SHORTEST, LONGEST = 3, 5
SLICE = 8 << 20
MAX_WORDS = 500_000
# words whose subwords are worked out at once
LEARN = 8192
EDGES = " .,;:!?\"'()[]{}<>|*#%&$-_/\\+=~`"


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word with its edges marked, and of the word itself."""
    word = word.strip(EDGES)
    if not word:
        return []
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}
    grams.add(marked)
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def all_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of every word in one pass: pairs (word number, bucket), in their order."""
    marked = [f"<{w}>".encode() if w else b"" for w in (w.strip(EDGES) for w in words)]
    data = np.frombuffer(b"".join(marked), np.uint8)
    # a character begins at each byte that continues none
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(begin, append=len(data))
    ends = np.cumsum([len(m) for m in marked])
    word = np.searchsorted(ends, begin, "right")
    last = np.searchsorted(begin, ends)[word]
    whole = np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) % BUCKETS
    own = np.flatnonzero(np.fromiter(map(bool, marked), np.bool_, len(marked)))
    pairs = [own * BUCKETS + whole[own]]
    # the n-grams that start at each character grow by a character a round
    at = np.arange(len(begin))
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for n in range(1, LONGEST + 1):
        more = at + n <= last[at]
        at, crc = at[more], crc[more]
        place, size = begin[at + n - 1], width[at + n - 1]
        crc = CRC[(crc ^ data[place]) & 0xFF] ^ (crc >> 8)
        for k in range(1, int(size.max(initial=0))):
            some = np.flatnonzero(size > k)
            crc[some] = CRC[(crc[some] ^ data[place[some] + k]) & 0xFF] ^ (crc[some] >> 8)
        if n >= SHORTEST:
            pairs.append(word[at] * BUCKETS + (~crc).astype(np.int64) % BUCKETS)
    both = np.sort(np.concatenate(pairs))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both // BUCKETS, both % BUCKETS


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        limit = SLICE + (sizes[at - 1] if at else 0)
        to = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def distinct_words(texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, int]]:
    """For slices of ``texts``: the words, and pairs (text number, word number) of each text's distinct words."""
    for piece in _slices(texts.fill_null("").cast(pa.large_string())):
        lists = pc.utf8_split_whitespace(pc.utf8_lower(piece))
        words = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(piece), dtype=np.int64), sizes)
        pairs = np.sort(owner * len(words.dictionary) + words.indices.to_numpy())
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        width = max(len(words.dictionary), 1)
        yield words.dictionary.to_numpy(zero_copy_only=False).tolist(), pairs // width, pairs % width, len(piece)


@dataclass
class Model:
    """Two numbers a bucket, and the bias: the softmax of two classes over averaged vectors, folded."""

    weight: np.ndarray
    bias: float
    mass: np.ndarray


def masses(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What each bucket weighs in an average, by the number of ``bags`` that hold it."""
    holders = np.bincount(np.concatenate([ids for ids, _ in bags]), minlength=BUCKETS) if bags else np.zeros(BUCKETS)
    return np.log((len(bags) + 1) / (holders + 1)) ** 2 * holders / (holders + 20)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 8, epochs: int = 8, step: float = 0.3, batch: int = 64, seed: int = 7) -> Model:
    """Vectors and softmax fitted jointly. ``bags`` hold the distinct buckets of each document, and how often each comes."""
    mass = masses(bags)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, mass)
    rng = np.random.default_rng(seed)
    # a bucket that no row of the sample holds says nothing
    vectors = np.zeros((BUCKETS, dims))
    soft = rng.normal(0, 0.3, (dims, 2))
    bias = np.zeros(2)
    seen_v, seen_s, seen_b = np.full((BUCKETS, dims), 1e-8), np.full((dims, 2), 1e-8), np.full(2, 1e-8)
    shares = []
    for ids, counts in bags:
        part = counts * mass[ids]
        shares.append(part / max(part.sum(), 1e-12))
    # both classes weigh as they occur, so that the scores are probabilities
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            owner = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            ids = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([shares[i] for i in some])
            mean = np.stack([np.bincount(owner, vectors[ids, d] * share, len(some)) for d in range(dims)], axis=1)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p /= len(some)
            back = p @ soft.T
            used, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[owner, d] * share, len(used)) for d in range(dims)], axis=1)
            g_soft, g_bias = mean.T @ p, p.sum(axis=0)
            seen_v[used] += grad**2
            vectors[used] -= step * grad / np.sqrt(seen_v[used])
            seen_s += g_soft**2
            soft -= step * g_soft / np.sqrt(seen_s)
            seen_b += g_bias**2
            bias -= step * g_bias / np.sqrt(seen_b)
    fold = soft[:, 1] - soft[:, 0]
    return Model(vectors @ fold, float(bias[1] - bias[0]), mass)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, at = batch["label"].to_numpy(), 0
        for words, owner, word, size in distinct_words(batch["text"]):
            found = [np.array(subwords(w), np.int64) for w in words]
            ends = np.searchsorted(owner, np.arange(1, size + 1))
            ids, counts = [], []
            for own in np.split(word, ends[:-1]):
                # counted bucket by bucket, so a text of any length takes the same room
                total = np.zeros(BUCKETS, np.uint32)
                for w in own:
                    total[found[w]] += 1
                held = np.flatnonzero(total)
                ids.append(held.astype("<u4").tobytes())
                counts.append(total[held].astype("<u4").tobytes())
            yield pa.record_batch({
                "label": pa.array(labels[at : at + size], pa.int32()),
                "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()),
            })
            at += size


def fit(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", learn: Column | None = None,
    sample: int = 1500, sample_bytes: int = 16 << 20, **settings,
) -> Model:
    """Model of the labelled rows of ``docs`` for which ``learn`` holds; labels other than 0 and 1 are left out."""
    hashed = F.xxhash64(F.col(text).cast("string"))
    known = docs if learn is None else docs.where(learn)
    known = known.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), hashed.alias("h"), F.octet_length(F.col(text).cast("string")).alias("size"))
    goal = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").distinct()
    known = known.join(goal, "key")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return train([], np.zeros(0, np.int64))
    # thin out by hash before the exact choice, so that few rows meet
    share = F.when(F.col("label") == 1, min(1.0, 2 * sample / total[1])).otherwise(min(1.0, 2 * sample / total[0]))
    near = known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    per = Window.partitionBy("label").orderBy("h", "key")
    before = F.coalesce(F.sum("size").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = near.withColumns({"nth": F.row_number().over(per), "before": before})
    chosen = ranked.where((F.col("nth") <= sample) & (F.col("before") < sample_bytes)).select("key", "h", "label").distinct()
    # at most 2 * sample rows
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), hashed.alias("h"))
    rows = texts.join(F.broadcast(chosen), ["key", "h"]).select("label", "text").distinct()
    found = rows.mapInArrow(_bags, "label int, ids binary, counts binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["ids"]), bytes(r["counts"])))
    marks = np.array([r["label"] for r in found], np.int64)
    bags = [(np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4")) for r in found]
    model = train(bags, marks, **settings)
    # the sample holds the labels in other shares than the data
    n = np.bincount(marks, minlength=2)
    model.bias += float(np.log(total[1] / total[0]) - np.log(n[1] / n[0]))
    return model


class _Known:
    """Sum of the weights and of the masses of each word's subwords, for the words that a worker has met."""

    def __init__(self, model: Model):
        self._model, self._pull = model, model.weight * model.mass
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._sums, self._masses = array("d"), array("d")

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), LEARN):
            some = words[at : at + LEARN]
            word, bucket = all_subwords(some)
            self._code.update(zip(some, range(len(self._code), len(self._code) + len(some))))
            self._sums.frombytes(np.bincount(word, self._pull[bucket], len(some)).tobytes())
            self._masses.frombytes(np.bincount(word, self._model.mass[bucket], len(some)).tobytes())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._code) > MAX_WORDS:
            self._forget()
        code = self._code
        self._learn([w for w in words if w not in code])
        codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        return np.array(self._sums)[codes], np.array(self._masses)[codes]


_words: dict[int, _Known] = {}


def _score(model: Model, name: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _words:
            _words.clear()
            _words[name] = _Known(model)
        known = _words[name]
        for batch in batches:
            scores = []
            for words, owner, word, size in distinct_words(batch["text"]):
                sums, counts = known.of(words)
                total = np.bincount(owner, sums[word], size)
                n = np.bincount(owner, counts[word], size)
                logit = total / np.maximum(n, 1e-12) + model.bias
                scores.append(1 / (1 + np.exp(-np.clip(logit, -50, 50))))
            columns = {c: batch[c] for c in batch.schema.names if c != "text"}
            columns["score"] = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.record_batch(columns)

    return run


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of label 1."""
    names = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    name = zlib.crc32(model.weight.tobytes() + model.mass.tobytes()) ^ hash(model.bias)
    return df.mapInArrow(_score(model, name), f"{schema}, score double").withColumnsRenamed(dict(zip(names, keep)))

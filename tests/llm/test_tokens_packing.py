"""Token ids, packing and token files against the tokenizer and plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from pathloom.llm import packing, tokenfile, tokens  # noqa: E402
from pathloom.llm.scratch import Scratch  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", " ", "\n", "Hello, World!", "it's  I'll we've", "don't.", "ábc É H̱", "x y z", "\x1c\x1d a\tb\r\nc", "THE.!? end.,",
    "<|endoftext|> and <|startoftext|>a", "12345 6,7", "naïve ΣΑΣ İstanbul ß", "日本語 テキスト", "😀😀!", "!!!! ,,,,", "word;word: word?", "ab" * 3000,
]
ROWS = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "no id"), (3, "same id"), (3, "same id"), (99, None)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, part int")


def expected(text, path=WORDS):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_tokenizers(path):
    ids, ends = tokens.TextEncoder(path).encode(pa.array([*TRICKY, None]))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [expected(t, path) for t in [*TRICKY, None]]


def test_words_of_letters_and_marks_need_no_whole_encoding(monkeypatch):
    text = "Zürich éclair, naïveté;%% ÀÇĐ (ab) ththin,%%% Straße! don't, x'll? ŉa İb ﬁn \u212bngstrom e\u0301t\u00e9 <|endoftext|>, ab<|endoftext|>"
    one = tokens.TextEncoder(WORDS)
    whole, asked = one._whole, []
    monkeypatch.setattr(one, "_whole", lambda w: asked.append(w) or whole(w))
    assert one.encode(pa.array([text]))[0].tolist() == expected(text)
    assert not {"Zürich", "éclair,", "naïveté;%%", "ÀÇĐ", "ththin,%%%", "Straße!"} & set(asked)


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 3)
    one = tokens.TextEncoder(WORDS)
    for text in TRICKY * 2:
        ids, _ = one.encode(pa.array([text]))
        assert ids.tolist() == expected(text)


def test_pack_holds_every_id_once(spark):
    rows = packing.pack(docs(spark), WORDS, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 64
        by_doc[r["doc_id"]].append((r["start"], ids.tolist()))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for used in by_sequence.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 64
    for key in {k for k, _ in ROWS}:
        want = sorted(sum(([*expected(t), 0] for k, t in ROWS if k == key), []))
        assert sorted(i for _, ids in by_doc[key] for i in ids) == want
    total = sum(len(expected(t)) + 1 for _, t in ROWS)
    assert len(by_sequence) <= -(-total // 64) + 2


def test_pack_of_no_rows(spark):
    assert packing.pack(docs(spark, []), WORDS).collect() == []


def test_plan_places_all_without_overlap():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 64, 2048])
        counts = defaultdict(int)
        for _ in range(rng.randint(0, 300)):
            counts[rng.randint(1, capacity)] += 1
        plan = packing.Plan(dict(counts), capacity)
        bins = defaultdict(list)
        for length, slots in plan.slots.items():
            assert sum(s[0] for s in slots) == counts[length]
            for count, first, each, offset in slots:
                for i in range(count):
                    bins[first + i // each].append((offset + i % each * length, length))
        large = 0
        for used in bins.values():
            at = 0
            for offset, length in sorted(used):
                assert offset == at
                at += length
            assert at <= capacity
            large = max(large, sum(3 * n > capacity for _, n in used))
        assert large <= 2
        assert len(bins) == plan.sequences
        total = sum(n * c for n, c in counts.items())
        assert plan.sequences >= -(-total // capacity)


def test_pairs_of_large_pieces():
    plan = packing.Plan({6: 2, 4: 2, 5: 3}, 10)
    assert plan.sequences == 4  # 6+4, 6+4, 5+5, 5


def test_token_files(spark):
    folder = Scratch(spark, "test").root
    tokenfile.write_ids(docs(spark), folder, WORDS)
    rows = tokenfile.read_ids(spark, folder).orderBy("start").collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in rows:
        assert (r["start"], 4 * r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]
    keys = [r["key"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted(((k, [*expected(t), 1]) for k, t in ROWS), key=repr)
    assert sorted(((r["key"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows), key=repr) == want
    some = tokenfile.read_ids(spark, folder, keys=[3, 17, 500]).collect()
    assert sorted(r["key"] for r in some) == [3, 3, 3, 17]
    crc = {r["key"]: r["c"] for r in tokenfile.read_ids(spark, folder, keys=[17]).select("key", F.crc32("ids").alias("c")).collect()}
    assert crc[17] == zlib.crc32(np.array([*expected(TRICKY[17]), 1], "<u4").tobytes())


def test_token_files_of_no_rows(spark):
    folder = Scratch(spark, "test").root
    assert tokenfile.write_ids(docs(spark, []), folder, WORDS).count() == 0
    assert tokenfile.read_ids(spark, folder).count() == 0


class Memory:
    def __init__(self, data):
        self.data, self.at = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def test_frames_are_read_alone_and_checked(tmp_path):
    import io

    import zstandard

    sink = io.BytesIO()
    writer = tokenfile.FrameWriter(sink)
    ids = np.arange(300_000, dtype=np.uint32)
    ends = np.array([5, 5, 70_000, 250_000, 300_000])
    writer.add(np.arange(5), ids, ends)
    writer.close()
    data = sink.getvalue()
    reader = tokenfile.FrameReader(Memory(data))
    starts = [0, *ends[:-1]]
    for i, (begin, end) in enumerate(zip(starts, ends)):
        assert np.frombuffer(reader.document(i), "<u4").tolist() == ids[begin:end].tolist()
    fresh = tokenfile.FrameReader(Memory(data))
    fresh.document(4)
    assert fresh.frames_read == 2
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == ids.astype("<u4").tobytes()
    broken = bytearray(data)
    broken[40] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.FrameReader(Memory(bytes(broken))).document(0)

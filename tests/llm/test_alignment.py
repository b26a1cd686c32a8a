"""Aligned tokens beside a plain walk over both tokenizers' tokens."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pathloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, part string, pairs int, best string, key int"


def brute(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    from_char = alignment.byte_of_character()

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    docs, counts = [], Counter()
    for key, text in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        wide_a = [bytes(from_char[c] for c in first.id_to_token(i)) for i in a]
        wide_b = [piece(i) for i in b]
        if b"".join(wide_a) != (" " + text).encode() or b"".join(wide_b) != (" " + text).encode():
            a = b = wide_a = wide_b = []
        groups, links, i, j, at_a, at_b, own_a, own_b = [], [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(wide_a[i])
                own_a.append(a[i])
                i += 1
            else:
                at_b += len(wide_b[j])
                own_b.append(b[j])
                j += 1
            if at_a == at_b:
                links.append((own_a[-1], own_b[-1]))
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        counts.update(links)
        docs.append((key, len(a), len(b), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((
        (str(k), na, nb, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         sha256(text.encode()).hexdigest() if text else "") for k, na, nb, links, text in docs
    ))


def rows_of(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((str(r.doc_id), *(r[c] for c in names)) for r in df.collect())


def sample():
    rng = random.Random(3)
    words = ["the", "The", "naïve", "données", "über", "12345", "don't", "日本語", "🙂", "▁", "x▁y", "<s>", "<|endoftext|>", "\n", "\t", "  ", " ", "é", "ﬁ", "\x00", "zzzqqq", "internationalization"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "\n"), (None, "the same"), (None, "the same"), (504, "the same"), (505, "word " * 30_000), (506, " lead"), (507, "trail ")]
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_alignment_is_the_plain_walk(spark, parts):
    rows = sample()
    df = spark.createDataFrame([(*r, "p", 1, "b", 2) for r in rows], SCHEMA).repartition(parts)
    found, want = rows_of(alignment.align(df, A, B)), brute(rows)
    assert found == want
    assert any(w[1] == 0 for w in want) and any(w[5] < w[4] for w in want)


def test_several_parts_of_one_task(spark):
    rows = [(i, f"{'some words again and again ' * (9 * i)}{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    with_parts = alignment.align(df, A, B, part_bytes=5000)
    assert rows_of(with_parts) == brute(rows)


def test_parts_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1)

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(Task))
    batch = pa.RecordBatch.from_pydict({"key": [1, 2, 3], "text": ["ab cd", "ef gh", "i"]})
    out = pa.Table.from_batches(list(alignment._aligned(A, B, pa.int32(), 5)(iter([batch]))))
    assert len(set(out["part"].to_pylist())) == 3
    assert out.filter(pc.is_valid(out["pairs"]))["key"].to_pylist() == [1, 2, 3]


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    both = alignment.Aligner(A, B)
    assert both.by_unit
    marks = [" ", "  ", "\n", " \n", "\n ", "\t", "\xa0", " \xa0", "\u2003 ", "\x85", "\x1f ", "\u200b ", "\u0301", " \u0301", "a", "don't", "'s", "1", "12", "é", "日本", "!", "...", "▁", "🙂", "<s>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["", " ", "  ", "\n"]
    for found, want in zip(both._lists_by_unit(texts), both._encode(texts)):
        assert found.to_pylist()[:-4] == want[:-4]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op13_token_alignment"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(found) == brute([tuple(d) for d in docs])
    assert [t for c, t in found.dtypes if c != "groups_sha256"] == ["bigint"] * 7


def test_lookups_forget_the_tokenizers(monkeypatch):
    monkeypatch.setattr(alignment, "_aligners", {("a", "b"): object()})
    assert list(alignment._looked_up(iter([]))) == []
    assert alignment._aligners == {}

"""Near duplicates, repeated passages and benchmark windows against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, minhash, suffix
from pathloom.llm.scratch import Scratch
from pathloom.llm.textgrams import gram_hashes, window_minima

VOCABULARY = ["the", "of", "and", "in", *(f"w{i}" for i in range(300))]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 5, "x", "y") for k, t in rows], "doc_id long, text string, row int, part string, comp string")


def sentences(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near_rows(seed):
    rng = random.Random(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (None, "two words"), (1005, "TWO words"), (1006, "two  words")]
    for group in range(12):
        base = sentences(rng, rng.randint(20, 120)).split()
        for copy in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            rows.append((group * 100 + copy, " ".join(words).title() if copy % 3 == 0 else " ".join(words)))
    rows += [(7, sentences(rng, 9000)), (7, rows[-1][1])]
    return rows


def brute_components(rows, k):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        old = smallest.get(find(i))
        smallest[find(i)] = key if old is None else old if key is None else min(old, key)
    return [(key, len(s), smallest[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets))], len({find(i) for i in range(len(rows))})


@pytest.mark.parametrize("size", [1, 40, 600, 50_000])
def test_parity_sketches_rule_out_no_link(size):
    rng = np.random.default_rng(size)
    for gone in {0, size // 12, size // 9, size // 5, size // 2}:
        base = rng.integers(0, 2**64, size + gone, np.uint64)
        left, right = base[:size], base[gone:]
        common = size - gone
        x, y = (minhash._sketches([minhash.parity_sketch(s).tobytes()]) for s in (left, right))
        may = bool(minhash._may_link(x, y, np.array([2 * size]), 80)[0])
        assert may or 100 * common < 80 * (2 * size - common)
        if size == 600 and gone >= size // 5:
            assert not may


@pytest.mark.parametrize("words, chunk", [(2, 1000), (5, 3)])
def test_near_duplicates(spark, monkeypatch, words, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = near_rows(words)
    got = minhash.near_duplicates(frame(spark, rows), words=words).collect()
    want, groups = brute_components(rows, words)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    # one row stays of each component; rows without words are components of their own
    assert sum(r["stays"] for r in got) == groups


def test_links_between_two_components_are_confirmed_once(spark, monkeypatch):
    """A group of near copies: links inside what is already connected are neither confirmed nor walked again."""
    rng = random.Random(11)
    base = sentences(rng, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.randrange(len(words))] = f"odd{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    sizes, put = {}, Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    got = minhash.near_duplicates(frame(spark, rows), words=2).collect()
    want, _ = brute_components(rows, 2)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)
    assert sizes["pairs"] > 3 * len(rows)
    assert sum(n for name, n in sizes.items() if name.startswith("links") or name.endswith("edges0")) < sizes["pairs"] / 4


def test_drop_near_duplicates_keeps_columns(spark):
    rows = near_rows(3)
    docs = frame(spark, rows)
    left = minhash.drop_near_duplicates(docs, words=5)
    assert left.columns == docs.columns
    assert left.count() == brute_components(rows, 5)[1]


def test_near_duplicates_of_no_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


# --- repeated passages ---------------------------------------------------------------------


def brute_removed(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + length] = b"\1" * length
    return [bytes(b for b, c in zip(t, m) if not c) for t, m in zip(texts, cover)], [len(re.findall(b"\1+", bytes(m))) for m in cover]


def passage_rows(seed):
    rng = random.Random(seed)
    passages = [sentences(rng, n) for n in (60, 90, 45, 200)] + ["é" * 150, "ab" * 200, "x" * 900, "日本" * 60]
    rows = [(900, None), (901, ""), (902, "short"), (903, "z" * 199), (904, "q" * 200), (905, "q" * 200), (None, "v" * 250)]
    for i in range(40):
        parts = [sentences(rng, rng.randint(0, 40)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 30) :])
        rows.append((i, " ".join(parts)))
    return rows + rows[10:14]


@pytest.mark.parametrize("hot, block", [(10**6, 1 << 20), (3, 4000)])
def test_repeated_spans(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rows = passage_rows(hot % 7)
    got = suffix.repeated_spans(frame(spark, rows), hot=hot).collect()
    texts = [(t or "").encode() for _, t in rows]
    kept, spans = brute_removed(texts, 200)
    want = sorted(((k, t, s) for (k, _), t, s in zip(rows, kept, spans)), key=repr)
    assert sorted(((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr) == want


def test_whole_characters_stay_valid(spark):
    rows = passage_rows(5)
    for r in suffix.repeated_spans(frame(spark, rows), characters=True).collect():
        bytes(r["kept"]).decode()


def test_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1024)
    rng = random.Random(2)
    long = sentences(rng, 1500)
    texts = [long.encode(), (sentences(rng, 50) + long[2000:2600]).encode()]
    runs = []
    for owners, places, data, starts, ends in suffix._blocks(texts, 200):
        owner, first, last, anchor, _ = suffix._runs(data, starts, ends, 200)
        for o, f, t in zip(owner, first, last):
            runs += [(int(owners[o]), int(f - starts[o] + places[o]) + i) for i in range(int(t - f))]
    assert sorted(runs) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 199)]


def test_repeated_spans_of_no_rows(spark):
    assert suffix.repeated_spans(frame(spark, [])).collect() == []


def test_repeats_equals_brute_force():
    import numpy as np

    rng = random.Random(8)
    for length in (3, 8, 20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 120))) for _ in range(12)] + [b"a" * 60]
        places = {}
        for t in texts:
            for p in range(len(t) - length + 1):
                places[t[p : p + length]] = places.get(t[p : p + length], 0) + 1
        for t, mark in zip(texts, suffix.repeats(texts, np.ones(len(texts), int), length)):
            assert mark.tolist() == [places[t[p : p + length]] > 1 for p in range(len(t) - length + 1)]


@pytest.mark.parametrize("probe", [5, 12, 20])
def test_repeats_in_stretches_of_longer_texts(monkeypatch, probe):
    monkeypatch.setattr(suffix, "PROBE", probe)
    rng = random.Random(probe)
    shared = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(15, 40))) for _ in range(5)]
    texts = []
    for _ in range(30):
        parts = [rng.choice(shared) if rng.random() < 0.4 else bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(6)]
        texts.append(b"".join(parts).ljust(20, b"z"))
    places = {}
    for t in texts:
        for p in range(len(t) - 19):
            places[t[p : p + 20]] = places.get(t[p : p + 20], 0) + 1
    assert 0 < sum(n > 1 for n in places.values()) < len(places)
    for t, mark in zip(texts, suffix.repeats(texts, np.ones(len(texts), int), 20)):
        assert mark.tolist() == [places[t[p : p + 20]] > 1 for p in range(len(t) - 19)]


@pytest.mark.parametrize("size", [1, 7, 300, (1 << 21) + 5])
def test_suffix_array_orders_rotations(size):
    data = np.random.default_rng(size).integers(0, 3, size).astype(np.uint8)
    order = suffix.suffix_array(data, 200)
    assert sorted(order.tolist()) == list(range(size))
    ring = np.concatenate([data, np.resize(data, 200)]).tobytes()
    some = range(size - 1) if size < 1000 else random.Random(1).sample(range(size - 1), 2000)
    assert all(ring[order[i] : order[i] + 200] <= ring[order[i + 1] : order[i + 1] + 200] for i in some)


def test_gram_hashes_and_minima():
    import numpy as np

    data = np.frombuffer(b"abcabcabcabdabcabcab", np.uint8)
    h = gram_hashes(data, 5)
    assert all((h[i] == h[j]) == (data[i : i + 5].tobytes() == data[j : j + 5].tobytes()) for i in range(len(h)) for j in range(len(h)))
    assert window_minima(np.array([5, 1, 4, 3, 9]), 3).tolist() == [1, 1, 3]


# --- benchmark windows ---------------------------------------------------------------------


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        out.append((key, len(w), len(hit), len(found - {None}), sorted(str(x) for x in found - {None})))
    return out


def benchmark_rows():
    rng = random.Random(6)
    items = [(i, sentences(rng, rng.randint(3, 40))) for i in range(12)]
    items += [(20, "Solo42"), (21, None), (22, " .,"), (23, "the of"), (None, sentences(rng, 12)), (2, sentences(rng, 15)), (24, "the " * 14), (25, "Émile, du PONT-neuf")]
    rows = [(100, None), (101, ""), (102, "a solo42, b"), (103, "of the of the"), (None, items[0][1]), (104, "the " * 30), (105, "dit émile du pont neuf! Émile du pont")]
    for i in range(30):
        parts = [sentences(rng, 30), (rng.choice(items)[1] or "").upper(), sentences(rng, 20)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return rows + rows[-2:], items


@pytest.mark.parametrize("most", [250_000, 0])
def test_contamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    rows, items = benchmark_rows()
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute_contamination(rows, items), key=repr)


def test_drop_contaminated(spark):
    rows, items = benchmark_rows()
    docs = frame(spark, rows)
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns
    want = [k for k, _, hit, _, _ in brute_contamination(rows, items) if not hit]
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(map(repr, want))


def test_contamination_of_no_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows, items = benchmark_rows()
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.contamination(frame(spark, rows), none).agg(F.sum("n_hit")).first()[0] == 0

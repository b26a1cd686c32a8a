"""Archives, nearest neighbours, shards, languages and toxicity against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import langid, neighbours, sharding, toxicity, warc
from pathloom.llm.scratch import Scratch


def test_archive_round_trip(spark):
    long, other = "<p>é same</p>" * 100, "x" * 1000
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "short"), (6, "short"), (7, other), (8, long)]
    pages = spark.createDataFrame([(k, f"http://h/{k}", t, "y") for k, t in rows], "page_id long, url string, html string, headers string")
    folder = Scratch(spark, "test").root
    warc.write_warc(pages, folder)
    found = warc.read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    found = found.select(warc.page_id_of("record_id").alias("k"), "record_type", warc.page_id_of("refers_to").alias("r"), "payload").collect()
    got = {r["k"]: (r["record_type"], r["r"]) for r in found}
    want = {k: ("revisit", 8) if k in (1, 2) else ("response", None) for k, _ in rows}
    assert len(found) == len(rows) and got == want
    texts = dict(rows)
    for r in found:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == (texts[r["k"]] or "").encode()


@pytest.mark.parametrize("count", [0, 5, 400])
def test_nearest_equals_brute_force(spark, count):
    rng = random.Random(count)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(count)]
    vectors += [(i + count, list(v)) for i, v in vectors[:3]]  # ties
    bad = [(9001, None), (9002, [0.0] * 6), (9003, [1.0] * 5 + [float("nan")]), (9004, [1.0] * 5 + [None]), (9010, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<double>, score string")
    rows = neighbours.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    want = []
    for q, v in vectors:
        if q % 10 == 0:
            near = sorted((math.dist(v, w), i) for i, w in vectors if i != q)[:10]
            want += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [w[:3] for w in sorted(want)]
    assert [r["score"] for r in rows] == pytest.approx([w[3] for w in sorted(want)])


def test_shards_by_table(spark):
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 101)
    assert sorted(map(table.count, range(3))) == [33, 34, 34]
    fewer = sharding.lookup_table(names[:2], 101)
    assert sum(x != y for x, y in zip(table, fewer) if x < 2) < 34
    df = spark.createDataFrame([(i, "x") for i in (1, 2, 2, None, None)], "doc_id long, note string")
    rows = sharding.assign_shards(df, "doc_id", names, 101).collect()
    assert len(rows) == 5
    for r in rows:
        key = "\\N" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 101
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], names[table[slot]])
    assert sharding.assign_shards(df.limit(0), "doc_id", names, 101).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df.withColumn("Slot", F.lit(1)), "doc_id", names)


ENGLISH = "the house and the garden with the old river were there when they came from their long walk".split()
GERMAN = "das haus und der garten mit dem alten fluss waren schon da als sie von ihrem langen weg kamen".split()


def test_languages(spark):
    rng = random.Random(1)
    text = {"en": lambda n: " ".join(rng.choices(ENGLISH, k=n)), "de": lambda n: " ".join(rng.choices(GERMAN, k=n))}
    known = [(lang, text[lang](60)) for lang in ("en", "de") for _ in range(20)] + [(None, "nothing"), ("en", None)]
    model = langid.fit(spark.createDataFrame(known, "lang string, text string"))
    assert sorted(model) == ["de", "en"]
    asked = [(i, text[lang](n), lang) for i, (lang, n) in enumerate([("en", 40), ("de", 40), ("en", 9000), ("de", 9000)])]
    asked += [(10, None, "und"), (11, "", "und"), (12, "12 34 !?", "und")]
    df = spark.createDataFrame([(i, t, want, 0.5) for i, t, want in asked], "doc_id long, text string, lang string, score double")
    rows = langid.predict(df, model, ["doc_id"]).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == {i: want for i, _, want in asked}
    assert all(0 <= r["score"] <= 1 and r["rejected"] == (r["lang_pred"] == "und") for r in rows)
    none = langid.predict(df, langid.fit(df.limit(0)), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(asked)


def test_toxicity_of_misspellings(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(ENGLISH, k=30) + (["stupid", "idiot"] if i % 6 == 0 else []))) for i in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, "toxic")
    asked = [(1, "the old river idiott"), (2, "the old river"), (3, None), (4, ""), (5, "the garden " * 20_000)]
    found = toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert len(score) == len(asked) and all(0 <= s <= 1 for s in score.values())
    assert score[1] > score[2] and score[5] < 0.3


def test_toxicity_score_is_the_softmax_of_weighted_vectors(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(ENGLISH, k=20) + (["stupid"] if i % 4 == 0 else [])) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), "toxic")
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, None), (4, "qqqq"), (5, " . ")]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()
    assert len(found) == len(rows)
    texts = {**dict(rows), 3: "", 5: ""}
    for r in found:
        ids = [b for w in sorted(set(texts[r["doc_id"]].lower().split())) for b in toxicity.subwords(w)]
        mass = model.mass[ids].sum()
        logit = (model.weight[ids] * model.mass[ids]).sum() / mass if mass else 0.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit - model.bias)), abs=1e-9)
    empty = toxicity.score(df.limit(0), model, ["doc_id"])
    assert empty.count() == 0


def test_toxicity_subwords_of_many_words_at_once(monkeypatch):
    words = ["", "a", "..", "hello", "Zürich!", "日本語テスト", "x😀y😀😀z", "aaaaaaa", "<>", "don't", "\x00b", "hello."]
    word, bucket = toxicity.all_subwords(words)
    for i, w in enumerate(words):
        assert bucket[word == i].tolist() == toxicity.subwords(w)
    assert [len(x) for x in toxicity.all_subwords([])] == [0, 0] == [len(x) for x in toxicity.all_subwords(["", "."])]
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.0, rng.random(toxicity.BUCKETS))
    monkeypatch.setattr(toxicity, "MAX_WORDS", 4)
    monkeypatch.setattr(toxicity, "LEARN", 3)
    known = toxicity._Known(model)
    for some in (words, words[3:], words[:2], []):
        sums, masses = known.of(some)
        ids = [toxicity.subwords(w) for w in some]
        assert np.allclose(sums, [(model.weight[i] * model.mass[i]).sum() for i in ids])
        assert np.allclose(masses, [model.mass[i].sum() for i in ids])


def test_toxicity_sees_words_of_any_share_and_of_long_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfghklmn", k=7))
    # the toxic word is in half of all rows, and comes after thousands of other words
    rows = [(i, " ".join([*(word() for _ in range(3000 if i < 20 else 20)), *(["stupid"] if i % 2 else [])])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), "toxic")
    asked = spark.createDataFrame([(1, "stupid"), (2, "garden")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model, ["doc_id"]).collect()}
    assert score[1] > score[2] + 0.2
    alike = toxicity.fit(df, df.select("doc_id", F.lit(1).alias("toxic")), "toxic")
    assert {r["score"] for r in toxicity.score(asked, alike, ["doc_id"]).collect()} == {0.5}

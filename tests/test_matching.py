"""Terms in texts: the gram index against plain search."""

import random
import re

from pathloom.operators import joins, matching


def _words(rng, count, longest, letters="ab/é"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def _found(df, columns, terms, **options):
    rows = matching.matches(df, columns, terms, "NAME", **options).collect()
    texts = [f"__t{i}" for i in range(len(columns))]
    return sorted(((tuple(r[t] for t in texts), r.COLUMN_NO, r.NAME, r.n) for r in rows), key=repr)


def test_matches_equal_plain_search_for_terms_of_every_size(spark):
    rng = random.Random(5)
    texts = [*_words(rng, 80, 30), "", None, "ab" * 400]
    names = [*_words(rng, 60, 12), "", None, "ab", "ab", "b" * 40]
    df = spark.createDataFrame([(t,) for t in texts + texts], "FILE string")
    terms = spark.createDataFrame(list(zip(names, range(len(names)))), "NAME string, n int")
    want = sorted(((t,), 0, w, n) for t in set(texts) - {None} for n, w in enumerate(names) if w and w in t)
    assert _found(df, ["FILE"], terms) == sorted(want, key=repr)
    assert len({len(w) for _, _, w, _ in want}) > 5


def test_matches_in_several_columns_any_case(spark):
    rng = random.Random(6)
    rows = list(zip(_words(rng, 60, 12, "aB/"), [*_words(rng, 50, 9, "Ab"), *[None] * 10]))
    names = sorted(set(_words(rng, 30, 5, "abB")) - {""})
    df = spark.createDataFrame(rows, "FILE string, LINK string")
    terms = spark.createDataFrame(list(zip(names, range(len(names)))), "NAME string, n int")
    want = sorted(
        ((r, i, w, n) for r in set(rows) for i, t in enumerate(r) if t is not None
         for n, w in enumerate(names) if w.lower() in t.lower()), key=repr,
    )
    assert _found(df, ["FILE", "LINK"], terms, ignore_case=True) == want


def test_whole_words_with_pattern_characters(spark):
    texts = ["/x/a.c/y", "/x/abc/y", "a.c", "za.c", "/q/a\\Eb/", "/q/aEb/"]
    df = spark.createDataFrame([(t,) for t in texts], "FILE string")
    terms = spark.createDataFrame([("a.c", 0), ("a\\Eb", 1)], "NAME string, n int")
    got = _found(df, ["FILE"], terms, whole_word=True)
    want = [((t,), 0, w, n) for t in texts for n, w in enumerate(["a.c", "a\\Eb"]) if re.search(rf"\b{re.escape(w)}\b", t)]
    assert got == sorted(want, key=repr)


def test_a_term_is_filed_under_its_rarest_gram(spark):
    names = [f"SH00{i}" for i in range(10)] + ["x", "yy", "longer_than_eight"]
    terms = spark.createDataFrame([(n,) for n in [*names, "SH001", "", None]], "NAME string")
    got = {r.TERM: r.GRAM for r in matching.gram_index(terms, "NAME").collect()}
    assert set(got) == set(names)
    assert all(got[f"SH00{i}"] == f"H00{i}" for i in range(10))
    assert (got["x"], got["yy"], len(got["longer_than_eight"])) == ("x", "yy", 8)


def test_no_terms_and_no_texts(spark):
    df = spark.createDataFrame([("/a/b", "p")], "FILE string, PROJECT string")
    shots = spark.createDataFrame([("b",)], "SHOTNAME string")
    assert [r.SHOTNAME for r in joins.assign_shot(df, shots.limit(0)).collect()] == [""]
    assert joins.assign_shot(df.limit(0), shots).collect() == []


def test_last_column_wins_and_first_shot_within_it(spark):
    rows = [("/SH01/SH02", "03", None), ("/SH02", None, "01 02"), ("x", "y", "z"), (None, None, None), ("/SH02", None, "01 02")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, FILE string, SEQUENCE string, LINK string")
    shots = spark.createDataFrame([("SH01",), ("SH02",), ("SH03",)], "SHOTNAME string")
    got = {r.id: r.SHOTNAME for r in joins.assign_shot_multi(df, shots, "SH").collect()}
    assert got == {0: "SH03", 1: "SH01", 2: "", 3: "", 4: "SH01"}
    assert [r.SHOTNAME for r in joins.assign_shot_multi(df.select("id"), shots, "SH").limit(1).collect()] == [""]


def test_rows_per_text_do_not_follow_the_number_of_term_lengths(spark):
    """A text gives at most one row per position and gram size."""
    terms = spark.createDataFrame([("a" * n,) for n in range(1, 60)], "NAME string")
    assert {len(r.GRAM) for r in matching.gram_index(terms, "NAME").collect()} == {1, 2, 4, 8}

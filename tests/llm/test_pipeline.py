"""Row numbers under other splits, and the stages of the pipeline on odd input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import minhash, suffix
from pathloom.llm.scratch import Scratch, with_row

SF = "/root/testdata/sf0.001"
SPLITS = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def folder_of_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(8, "doc_id").write.parquet(path)
    return path


@pytest.fixture
def one_task(spark):
    """From the call on, a task reads as many files as there are."""

    def on():
        for key, value in SPLITS.items():
            spark.conf.set(key, value)

    yield on
    for key in SPLITS:
        spark.conf.unset(key)


def test_a_row_keeps_its_number(spark, folder_of_files, one_task):
    docs = spark.read.parquet(folder_of_files)
    rows = with_row(docs, [F.col("doc_id")], Scratch(spark, "rows"))
    before = {r.doc_id: r.row for r in rows.collect()}
    tasks = rows.rdd.getNumPartitions()
    one_task()
    again = spark.read.parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    assert again.rdd.getNumPartitions() == 1 < tasks
    assert {r.doc_id: r.row for r in again.collect()} == before and len(set(before.values())) == len(before)


def test_results_do_not_depend_on_splits(spark, folder_of_files, one_task):
    docs = spark.read.parquet(folder_of_files)

    def spans():
        return sorted((r.doc_id, tuple(map(tuple, r.spans))) for r in suffix.repeated_spans(docs).select("doc_id", "spans").collect())

    def classes():
        return sorted(map(tuple, minhash.near_duplicates(docs, words=2).collect()))

    want = spans(), classes()
    assert any(s for _, s in want[0])
    one_task()
    assert (spans(), classes()) == want


ODD = "score double, margin string, rejected int, lang_pred string, kept string, spans int, doc string, row int, part int, window int"


def odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(
        [(900_001, None, None, None, None), (900_002, "", "en", "x", 0), (900_003, " \n ", "en", "x", 3), (None, "12 34", None, "x", 5),
         (900_005, "the same words of one text and of another " * 4000, "en", "x", 1)], docs.schema)
    more = more.union(more.where("doc_id = 900005"))
    names = [f.split() for f in ODD.split(", ")]
    return docs.union(more).select("*", *(F.lit("7").cast(kind).alias(name) for name, kind in names))


@pytest.mark.parametrize("at", range(5))
def test_stages_keep_columns_and_take_odd_rows(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    docs = odd_rows(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows
    if at < 4:
        assert out.columns == docs.columns and all(r.score == 7.0 and r.rejected == 7 and r.kept == "7" and r.row == 7 for r in rows)
        ids = [r.doc_id for r in rows]
        assert (None in ids) == (name != "language") and ids.count(900_005) <= (2 if name != "near_duplicates" else 1)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.collect() == []
    else:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = Scratch(spark, "stage").put(stage(spark, left, SF), "out")
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in left.select("doc_id").collect()}
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    # the language stage rejects few, and what is dropped later has a reason
    assert left.count() > 0.5 * docs.count()

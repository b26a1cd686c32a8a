"""Documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written as Parquet and read
back as the next stage's ``docs``. All but the last return the columns of ``documents``.

1. language: documents without a clear language go (no letter, or the same size in two languages).
2. near_duplicates: of documents linked by 0.8 of their five-word shingles the one with the smallest id stays.
3. repeated_passages: passages of 200 bytes and more that occur more than once are cut from the texts.
4. benchmark: documents that hold ten consecutive words of a benchmark item go.
5. packing: token ids in sequences of 2048.

Cases, for every stage. A null or empty text, or one without a letter, is rejected by the first stage; later stages
keep it where they are called alone: it has no shingles, no passages, no windows, and one end id. Texts are taken
whole, however long. Of repeated rows one stays in the second stage; rows that share an id and differ in text are
documents of their own. Ties go to the smallest id, and among equal ids to any one row. An empty table gives an
empty table. Columns beyond those of ``documents`` are kept, whatever their names, up to packing, which returns its own.
Packing reads ``doc_id`` and ``text`` alone.

A stage deletes what the stage before it stored beside its result: write a stage's result before calling the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, langid, minhash, packing, suffix
from pathloom.llm.scratch import Scratch
from pathloom.session import delete_folder, stored_folders

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
# no SQL: compression sizes, minhashes and token ids
ORACLE_SQL = None


def _bundled(docs: DataFrame) -> DataFrame:
    """``text``, and all other columns as ``doc``, so that no name of theirs meets one of an operator's own."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("doc"), "text")


def _unbundled(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select("doc.*", "text").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(_bundled(docs), langid.fit(docs), ["doc"])
    return _unbundled(found.where(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(_bundled(docs), keep=["doc"], characters=True)
    found = found.select("doc", F.when(F.col("text").isNotNull(), F.col("kept").cast("string")).alias("text"))
    return _unbundled(found, docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


# what the last stage of each application has stored for its result
_spent: dict[str, list[str]] = {}


def _stage(operate: Callable) -> Callable:
    """``operate`` as a stage: its ``docs`` are the written result of the stage before, so what that one stored goes."""

    @wraps(operate)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        for folder in _spent.pop(application, []):
            delete_folder(spark, folder)
        before = set(stored_folders(spark))
        out = operate(spark, docs, sf_dir)
        _spent[application] = [f for f in stored_folders(spark) if f not in before]
        return out

    return run_stage


STAGES = [
    ("language", _stage(language)),
    ("near_duplicates", _stage(near_duplicates)),
    ("repeated_passages", _stage(repeated_passages)),
    ("benchmark", _stage(benchmark)),
    ("packing", _stage(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each returns is written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Tables of snapshots: what is read, what is rewritten, and what a failed or late writer leaves."""

import pytest
from pyspark.sql import functions as F

from pathloom.plans.inventory import delete_rows
from pathloom.sources.snapshots import Conflict, SnapshotTable


def files_of(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in (path / "data").rglob("*.parquet")}


@pytest.fixture
def held(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for n in range(3):
        rows = spark.range(n * 100, n * 100 + 100, 1, 2).select(
            F.concat(F.lit("f"), "id").alias("FILE"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), F.expr("id div 10"))).alias("SEQUENCENAME"))
        table.append(rows, f"2024010{n + 1}")
    return table


def gone(spark, *rows):
    return spark.createDataFrame(rows, "FILE string, SEQUENCENAME string")


def names(df):
    return sorted(r.FILE for r in df.collect())


def test_reading_as_of_a_stamp(spark, held):
    assert held.read().count() == 300 and held.read("20240102").count() == 200 and held.read("2024010199").count() == 100
    with pytest.raises(FileNotFoundError):
        held.read("2023")
    held.overwrite(held.read().limit(0), "20240109")
    assert held.read().count() == 0 and held.read("20240108").count() == 300


def test_deleted_positions_then_compaction(spark, held, tmp_path):
    before = files_of(tmp_path / "t")
    version = delete_rows(held, gone(spark, ("f7", None), ("f8", "s0"), ("", "s1"), (None, "")), "20240104")
    assert version == 4 and files_of(tmp_path / "t") == before
    want = sorted(f"f{i}" for i in range(300) if i != 7 and not (i < 20 and i % 2 == 0))
    assert names(held.read()) == want and held.read("20240103").count() == 300
    # a second delete over the first
    delete_rows(held, gone(spark, ("f250", None)), "20240105", compact=True)
    want.remove("f250")
    assert names(held.read()) == want
    after = files_of(tmp_path / "t")
    _, entry = held.current()
    kept = [f for f in entry["files"] if f in before]
    # two files of the six have hits: the first and the last but one
    assert len(kept) == 4 and all(after[f] == before[f] for f in kept)
    assert held.compact("20240106") == held.versions()[-1]


def test_fallback_to_sequences(spark, held):
    delete_rows(held, gone(spark, ("nowhere", "s1")), "20240104", fallback=True)
    assert held.read().count() == 295
    delete_rows(held, gone(spark, ("f1", "s2")), "20240105", fallback=True)
    assert held.read().count() == 294


def test_failed_and_late_writers(spark, held, tmp_path):
    version, entry = held.current()

    @F.udf("string")
    def fails(x):
        raise ValueError("no")

    with pytest.raises(Exception):
        held.append(held.read().withColumn("FILE", fails("FILE")), "20240104")
    assert held.current() == (version, entry) and held.read().count() == 300
    assert held.commit(version, {**entry, "stamp": "20240105"}) == version + 1
    with pytest.raises(Conflict):
        held.commit(version, entry)
    assert held.versions() == [1, 2, 3, 4]


def test_old_snapshots_expire(spark, held, tmp_path):
    delete_rows(held, gone(spark, ("f1", "s1")), "20240104", compact=True)
    want = names(held.read())
    assert held.expire(1) > 0
    assert held.versions() == [5] and names(held.read()) == want
    _, entry = held.current()
    assert set(files_of(tmp_path / "t")) == set(entry["files"])
    assert not list((tmp_path / "t" / "deletes").glob("*"))


def test_empty_table_and_no_hits(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.append(gone(spark).limit(0), "1")
    assert table.read().collect() == []
    delete_rows(table, gone(spark, ("a", "b")), "2", compact=True)
    assert table.read().collect() == []

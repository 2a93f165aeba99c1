"""Tables between steps: where they lie, and how they go."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import shared


def test_tables_of_a_scope_are_removed(spark, tmp_path):
    rows = spark.range(5)
    with shared.scope(spark):
        one = shared.written(rows)
        path = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        one.write.parquet(str(tmp_path / "result"))
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and spark.read.parquet(str(tmp_path / "result")).count() == 5
    kept = shared.written(rows)
    assert kept.count() == 5


def test_a_scope_ends_with_a_failure_too(spark):
    with pytest.raises(ZeroDivisionError):
        with shared.scope(spark):
            path = shared.written(spark.range(2)).inputFiles()[0].removeprefix("file://")
            raise ZeroDivisionError
    assert not os.path.exists(path)


def test_what_is_written_on_the_way_to_a_settled_table_is_removed(spark):
    way = []

    def make():
        way.append(shared.written(spark.range(7)))
        return way[0].where("id > 2")

    with shared.scope(spark):
        kept = shared.settled(spark, make)
        assert kept.count() == 4 and not os.path.exists(way[0].inputFiles()[0].removeprefix("file://"))
        path = kept.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path)


def test_slices_are_written_one_after_the_other(spark):
    assert [shared.slices(n, 10) for n in (0, 10, 11, 40, 10_000)] == [1, 1, 2, 4, shared.MOST_SLICES]
    rows, seen = spark.range(20), []

    def make(part):
        seen.append(sorted(r["id"] for r in part(rows).collect()))
        return part(rows).groupBy("id").count()

    with shared.scope(spark):
        made = shared.sliced(3, F.col("id"), make)
        assert seen == [list(range(k, 20, 3)) for k in range(3)] and len(shared._scopes[-1]) == 3
        assert sorted(r["id"] for r in made.collect()) == list(range(20))
        assert shared.sliced(1, F.col("id"), lambda part: part(rows)) is rows and len(shared._scopes[-1]) == 3


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}
    before, was = held(), spark.conf.get(shared.SHUFFLE_CLEANUP)
    shared.written(spark.range(10_000).repartition(3, "id"))
    assert held() <= before and spark.conf.get(shared.SHUFFLE_CLEANUP) == was


def test_files_are_put_over_what_stands_there(spark, tmp_path):
    for data in (b"one", b"two"):
        shared.put(spark, str(tmp_path / "x.json"), data)
        assert (tmp_path / "x.json").read_bytes() == data
    assert shared.exists(spark, str(tmp_path / "x.json")) and not shared.exists(spark, str(tmp_path / "y.json"))
    shared.removed(spark, str(tmp_path / "x.json"), str(tmp_path / "y.json"))
    assert not (tmp_path / "x.json").exists()

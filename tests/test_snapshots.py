import threading

import pytest
from pyspark.sql import functions as F

from markloom.sources import snapshots


def test_a_failing_rewrite_leaves_the_old_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert snapshots.save(spark.range(3), path) == 1
    broken = spark.range(1000).select(F.when(F.col("id") > 990, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        snapshots.save(broken, path)
    assert snapshots.load(spark, path).count() == 3
    assert snapshots.numbers(spark, path) == [1]
    assert len(list((tmp_path / "s" / "versions").iterdir())) == 1


def test_a_reader_during_rewrites_sees_one_version(spark, tmp_path):
    path = f"{tmp_path}/s"
    snapshots.save(spark.range(10).withColumn("v", F.lit(1)), path)
    held = snapshots.load(spark, path)
    assert snapshots.save(spark.range(20).withColumn("v", F.lit(2)), path) == 2
    assert [tuple(r) for r in held.groupBy("v").count().collect()] == [(1, 10)]
    assert [tuple(r) for r in snapshots.load(spark, path).groupBy("v").count().collect()] == [(2, 20)]
    assert snapshots.load(spark, path, 1).count() == 10


def test_old_versions_are_cleared(spark, tmp_path):
    path = f"{tmp_path}/s"
    for n in range(5):
        snapshots.save(spark.range(n), path, keep=2)
    assert snapshots.numbers(spark, path) == [5, 4]
    assert len(list((tmp_path / "s" / "versions").iterdir())) == 2
    (tmp_path / "s" / "versions" / "left").mkdir()
    snapshots.save(spark.range(9), path)
    assert (tmp_path / "s" / "versions" / "left").exists()
    snapshots.save(spark.range(9), path, abandoned=-1)
    assert not (tmp_path / "s" / "versions" / "left").exists()
    assert snapshots.load(spark, path).count() == 9


def test_half_a_publication_is_passed_over(spark, tmp_path):
    path = f"{tmp_path}/s"
    snapshots.save(spark.range(4), path)
    (tmp_path / "s" / "published" / f"{2:020d}").write_text('{"version": "x')
    assert snapshots.load(spark, path).count() == 4
    assert snapshots.save(spark.range(5), path) == 3
    assert snapshots.load(spark, path).count() == 5


def test_savers_at_the_same_time_take_different_numbers(spark, tmp_path):
    path, got = f"{tmp_path}/s", []
    all_ = [threading.Thread(target=lambda n=n: got.append(snapshots.save(spark.range(n), path, keep=9))) for n in range(1, 5)]
    for t in all_:
        t.start()
    for t in all_:
        t.join()
    assert sorted(got) == [1, 2, 3, 4]
    assert sorted(snapshots.load(spark, path, n).count() for n in got) == [1, 2, 3, 4]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(snapshots.NoSnapshot):
        snapshots.load(spark, f"{tmp_path}/none")
    snapshots.save(spark.range(0), f"{tmp_path}/empty")
    assert snapshots.load(spark, f"{tmp_path}/empty").count() == 0
    snapshots.discard(spark, f"{tmp_path}/empty")
    snapshots.discard(spark, f"{tmp_path}/none")
    with pytest.raises(snapshots.NoSnapshot):
        snapshots.load(spark, f"{tmp_path}/empty")

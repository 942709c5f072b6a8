"""Versioned tables: reads during and after writes, failed writes, pruning; the plan of deletions against hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tracequarry.sources import versions


def test_readers_and_writers(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    first = versions.publish(spark.range(10), path)
    old = versions.current(spark, path)
    begun = old.rdd.toLocalIterator()
    seen = [next(begun).id]
    second = versions.publish(old.select((F.col("id") + 100).alias("id")), path)  # reads what it replaces
    assert sorted(seen + [r.id for r in begun]) == list(range(10)) and old.count() == 10
    assert sorted(r.id for r in versions.current(spark, path).collect()) == list(range(100, 110))
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(broken, path)
    assert versions.current(spark, path).count() == 10 and [v for v, _ in versions.versions(spark, path)][-1] == second
    third = versions.publish(spark.range(1), path)
    gone = versions.prune(spark, path, keep=1)
    assert first in gone and second in gone and third not in gone and versions.current(spark, path).count() == 1
    assert not [p for p in (tmp_path / "table").iterdir() if p.name.startswith("_current.")]


PLAN = "run string, path string, modified long, bytes long, synced boolean"


def plan(spark, marks, **options):
    """Names to delete of checkpoints c1, c2, .. (oldest first) with these sync marks and 10 bytes each."""
    df = spark.createDataFrame([("r", f"c{i}", i, 10, m) for i, m in enumerate(marks, 1)], PLAN)
    return sorted(r.path for r in versions.retention(df, group=["run"], **options).where("delete").collect())


def test_retention(spark):
    y, n = True, False
    assert plan(spark, [y, y, y, y], keep=2) == ["c1", "c2"]
    assert plan(spark, [y, n, y, y, y], keep=2) == ["c1"]  # c2 is not synced: it and what follows wait
    assert plan(spark, [n, y, y], keep=1) == []
    assert plan(spark, [None, y, y], keep=1) == []
    assert plan(spark, [n, n, y], keep=1, only_synced=False) == ["c1", "c2"]
    assert plan(spark, [n, y, n], keep=1, limit_bytes=30) == ["c1", "c2"]  # the threshold forces
    assert plan(spark, [n, y, n], keep=1, limit_bytes=31) == []
    assert plan(spark, [n, n], keep=1, force=F.lit(True)) == ["c1"]
    assert plan(spark, [y], keep=1) == [] and plan(spark, [y, y], keep=5) == []
    two = spark.createDataFrame([("a", "x", 1, 5, True), ("a", "y", 1, 7, True), ("b", "z", 0, 1, True)], PLAN)
    got = {r.path: (r.rank, r.bytes_so_far, r.delete) for r in versions.retention(two, keep=1, group=["run"]).collect()}
    assert got == {"x": (2, 12, True), "y": (1, 7, False), "z": (1, 1, False)}


def test_listed_files_are_planned_and_deleted(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"step-{k}").mkdir()
        (tmp_path / f"step-{k}" / "weights.bin").write_bytes(b"x" * (k + 1))
    (tmp_path / "notes.txt").write_text("not listed")
    files = versions.listed(spark, str(tmp_path), "*.bin").withColumn("run", F.lit("r")).withColumn("synced", F.lit(True)).withColumn("modified", F.col("path"))
    done = versions.retention(files, keep=1, group=["run"])
    assert sorted((r.bytes, r.delete) for r in done.collect()) == [(1, True), (2, True), (3, True), (4, False)]
    assert versions.delete_planned(done) == 3
    assert sorted(p.parent.name for p in tmp_path.rglob("*.bin")) == ["step-3"]

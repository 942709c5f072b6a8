"""Tables whose versions are folders: a write never touches what a reader reads, and one pointer says which version holds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "_current"


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, text: str) -> None:
    """The file ``path`` with a new text in one step: written beside it, then renamed over it."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    fs, beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, at = _path(spark, path)
    over = sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(at.toUri(), sc._jsc.hadoopConfiguration()).rename(beside, at, over)


def publish(df: DataFrame, path: str, **options) -> str:
    """Write ``df`` as a new version of the table at ``path`` and let it hold from then on; returns its name.

    Readers that have begun go on with the version they opened.  If the write fails, or the driver is lost before the swap, the old version
    holds and the unfinished folder is one of those that ``prune`` deletes.  Of two writers the later swap wins; neither mixes with the other.
    """
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(f"{path}/{name}")
    _swap(spark, f"{path}/{POINTER}", name)
    return name


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that holds when this is called."""
    name = _text(spark, f"{path}/{POINTER}")
    if name is None:
        raise FileNotFoundError(f"no version of {path} has been published")
    return spark.read.parquet(f"{path}/{name}")


def versions(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change) of all folders, oldest first; the one that holds is last whatever its time."""
    fs, at = _path(spark, path)
    holds = _text(spark, f"{path}/{POINTER}")
    found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-")]
    return sorted(found, key=lambda v: (v[0] == holds, v[1], v[0]))


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` latest versions (the one that holds always stays); returns the names deleted."""
    gone = [name for name, _ in versions(spark, path)[: -max(1, keep)]]
    for name in gone:
        fs, at = _path(spark, f"{path}/{name}")
        fs.delete(at, True)
    return gone


def retention(files: DataFrame, *, keep: int, group: list[str], only_synced: bool = True, limit_bytes: int | None = None, force: Column | None = None) -> DataFrame:
    """``files(group.., path, modified, bytes, synced)`` with its rank (1 the newest), the bytes of all newer ones and itself, and whether to delete it.

    The ``keep`` newest of a group always stay.  Older ones go, oldest first, but with ``only_synced`` none goes that is not synced, nor any newer than
    it: what follows an unsynced one waits for it.  A group whose files hold ``limit_bytes`` or more is forced: then all older ones go, synced or not.
    Null ``synced`` counts as not synced; equal times are ordered by path.
    """
    newest = Window.partitionBy(*group).orderBy(F.desc("modified"), F.desc("path"))
    oldest = Window.partitionBy(*group).orderBy("modified", "path")
    rows = files.withColumn("rank", F.row_number().over(newest)).withColumn("bytes_so_far", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.sum("bytes").over(Window.partitionBy(*group))
    forced = (F.lit(False) if limit_bytes is None else whole >= limit_bytes) | (F.lit(False) if force is None else force)
    unbroken = F.min(F.coalesce("synced", F.lit(False)).cast("int")).over(oldest.rowsBetween(Window.unboundedPreceding, 0)) == 1
    free = unbroken if only_synced else F.lit(True)
    return rows.withColumn("delete", (F.col("rank") > keep) & (forced | free))


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files below ``path``: Spark's own listing, and no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def delete_planned(plan: DataFrame, path_col: str = "path") -> int:
    """Delete the paths that a plan names; they go one by one to the file system of each, so the plan may be of any size."""
    n = 0
    for row in plan.where("delete").select(path_col).toLocalIterator():
        fs, at = _path(plan.sparkSession, row[0])
        n += bool(fs.delete(at, True))
    return n

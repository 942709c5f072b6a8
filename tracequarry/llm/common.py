"""Helpers shared by the operators of this subpackage: reading, cutting lineage, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
PASS_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  A small one in fewer splits than there are cores is dealt out; larger ones stay as their files are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` for columns of an operator's own that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_recording: list[list[str]] = []


def write_shared(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def recorded():
    """The list of the tables that ``cut`` writes inside; who has written all results that read them may delete them."""
    own: list[str] = []
    _recording.append(own)
    try:
        yield own
    finally:
        _recording.pop()


def drop_cut(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that nothing reads any more."""
    delete_tables(df.sparkSession, [df._cut_path])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later reads survive lost executors.

    What was shuffled for it is not needed any more; Spark deletes such files once the driver's garbage
    collector has found their plan unused, so it is asked to look.
    """
    out, path = write_shared(df, "cut")
    out._cut_path = path
    if _recording:
        _recording[-1].append(path)
    return out


def release() -> None:
    """Give freed memory of this worker back, so that an idle worker does not hold what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def text_slices(column: pa.Array, limit: int = PASS_BYTES):
    """Yield (first row, row offsets, bytes) for runs of whole texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, offsets[start : end + 1] - offsets[start], raw[offsets[start] : offsets[end]]
        start = end

"""Incremental receipts: exactly-once appends by key and running summaries with Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.receipts import KEY

#: A batch that touches more partitions than this reads the keys of all of them.
MOST_PARTITIONS = 200


def read_receipts(spark: SparkSession, path: str, schema: str, files_a_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def append_once(stream: DataFrame, target: str, checkpoint: str, key=KEY):
    """Appends rows whose key is not there yet, for each micro-batch; a batch that is run again adds nothing.

    The target is partitioned by arm and budget, so the anti-join reads only the partitions a batch touches.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        fresh = batch.dropDuplicates(key)
        touched = batch.select("arm", "budget").distinct().limit(MOST_PARTITIONS + 1).collect()
        try:
            old = batch.sparkSession.read.parquet(target).select(*key)
            if touched and len(touched) <= MOST_PARTITIONS:
                old = old.where(reduce(Column.__or__, [F.col("arm").eqNullSafe(t.arm) & F.col("budget").eqNullSafe(t.budget) for t in touched]))
            fresh = fresh.join(old, key, "left_anti")
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").partitionBy("arm", "budget").parquet(target)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_summary(stream: DataFrame, window: str = "1 day", late: str = "1 day", time: str = "at") -> DataFrame:
    """Counts by arm and event-time window; state is dropped once the watermark has passed a window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))

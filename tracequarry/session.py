"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable; adaptive execution splits skewed partitions and merges small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(name: str = "tracequarry", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A session; master and memory only take effect when none runs yet."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions or cpus)})
    if "SPARK_MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def swept(*sessions: SparkSession):
    """Inside, a query's shuffled files are deleted when it is done; elsewhere only when the driver's heap happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [s.conf.get(name, None) for s in sessions]
    for s in sessions:
        s.conf.set(name, "true")
    try:
        yield
    finally:
        for s, value in zip(sessions, before):
            s.conf.set(name, value) if value is not None else s.conf.unset(name)


def register_functions(spark: SparkSession) -> None:
    """SQL names for what SQL cannot say: ``audit_deduction(text)`` and the table function ``run_scratchpad(text)``."""
    from pyspark.sql.functions import pandas_udf, udtf

    from .operators import executor

    @pandas_udf("is_valid boolean, certified_answer string, n_steps int, error_context string")
    def audit_deduction(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([executor.audit(t or "") for t in text], columns=["is_valid", "certified_answer", "n_steps", "error_context"])

    @udtf(returnType="step_index int, raw_text string, step_type string, expression string, value string, passed boolean, checkpoint_id string")
    class RunScratchpad:
        def eval(self, text: str):
            for _, row in executor.Scratchpad().rows(text or ""):
                yield tuple(row.values())

    spark.udf.register("audit_deduction", audit_deduction)
    spark.udtf.register("run_scratchpad", RunScratchpad)

"""Energy of runs from power samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trapezoid(samples: DataFrame, idle_mw: int = 6750, *, run: str = "run_id", t: str = "t", mw: str = "mw") -> DataFrame:
    """(run, n, joules): area of power above idle over time by the trapezoid rule; microseconds and milliwatts stay whole until the end."""
    w = Window.partitionBy(run).orderBy(t, mw)
    above = F.greatest(F.col(mw) - idle_mw, F.lit(0))
    rows = samples.select(run, F.col(t).alias("t"), F.col(mw).alias("mw"), above.alias("p")).withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("q", F.col("p") + F.lag("p").over(w))
    area = F.sum(F.col("q").cast("decimal(18,0)") * F.col("dt").cast("decimal(18,0)"))
    return rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(area.cast("double"), F.lit(0.0)) / 2e9).alias("joules"))


def mean_power(samples: DataFrame, idle_mw: int = 6750, *, run: str = "run_id", t: str = "t", mw: str = "mw") -> DataFrame:
    """(run, n, joules): mean power above idle times the span of the samples."""
    above = F.greatest(F.col(mw) - idle_mw, F.lit(0))
    return samples.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.sum(above).alias("s"), (F.max(t) - F.min(t)).alias("span")).select(run, "n", (F.col("s").cast("double") * F.col("span").cast("double") / F.col("n") / 1e9).alias("joules"))


#: Shares of the design power that an idle and a busy processor are taken to draw.
IDLE_SHARE, BUSY_SHARE = 0.15, 0.85


def idle_baseline(samples: DataFrame, tdp_mw: int = 45_000, *, run: str = "run_id", mw: str = "mw") -> DataFrame:
    """(run, idle_mw): mean idle power; a run without readings gets a share of its design power."""
    return samples.groupBy(run).agg(F.coalesce(F.sum(mw).cast("double") / F.count(mw), F.lit(tdp_mw * IDLE_SHARE)).alias("idle_mw"))


def dynamic(samples: DataFrame, runs: DataFrame, idle_mw: int = 6750, tdp_mw: int = 45_000, *, run: str = "run_id") -> DataFrame:
    """(run, joules, is_estimate) of each row of ``runs(run, duration_us, has_meter)``.

    Two samples or more are integrated; one stands for the whole duration, none for idling.  Without a meter the power is
    estimated from the design power, and flagged.
    """
    single = F.greatest(F.max("mw") - idle_mw, F.lit(0)).alias("above")
    measured = trapezoid(samples, idle_mw, run=run).join(samples.groupBy(run).agg(single), run)
    rows = runs.join(measured, run, "left")
    seconds, metered = F.col("duration_us") / 1e6, F.coalesce("has_meter", F.lit(False))
    estimate = seconds * (max(0.0, tdp_mw * BUSY_SHARE - idle_mw) / 1000.0)
    read = F.when(F.col("n") >= 2, F.col("joules")).otherwise(F.coalesce("above", F.lit(0)) / 1000.0 * seconds)
    return rows.select(run, F.when(metered, read).otherwise(estimate).alias("joules"), (~metered).alias("is_estimate"))

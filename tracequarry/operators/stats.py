"""Effect sizes, rank statistics, paired bootstrap and decision rules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio


def cohen_d(receipts: DataFrame, arm: str, base: str, value: str = "tokens_emitted") -> DataFrame:
    """Standardised difference of means by budget; null for fewer than two values, 0 without spread.

    Moments are integer sums, so any order of adding gives the same result.
    """
    v = F.col(value).cast("long")
    of = lambda a, name: [F.count_if(F.col("arm") == a).alias(f"n_{name}"), F.sum(F.when(F.col("arm") == a, v)).alias(f"s_{name}"), F.sum(F.when(F.col("arm") == a, v * v)).alias(f"q_{name}")]
    m = receipts.where(F.col("arm").isin(arm, base)).groupBy("budget").agg(*of(arm, "a"), *of(base, "b"))
    spread = lambda x: F.col(f"q_{x}") - F.try_divide(F.col(f"s_{x}").cast("double") * F.col(f"s_{x}").cast("double"), F.col(f"n_{x}").cast("double"))
    pooled = F.try_divide(spread("a") + spread("b"), (F.col("n_a") + F.col("n_b") - 2).cast("double"))
    diff = ratio(F.col("s_a"), F.col("n_a")) - ratio(F.col("s_b"), F.col("n_b"))
    d = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), F.lit(None)).when(pooled <= 0, F.lit(0.0)).otherwise(diff / F.sqrt(pooled))
    return m.select("budget", "n_a", "n_b", d.alias("cohen_d"))


def common_language(receipts: DataFrame, arm: str, base: str, value: str = "tokens_emitted") -> DataFrame:
    """P(value of arm < value of base) by budget from counts of distinct values: no pairs are made.

    Values are counted first, so the running sum per budget goes over distinct values only.
    """
    counts = receipts.where(F.col("arm").isin(arm, base)).groupBy("budget", F.col(value).alias("v")).agg(F.count_if(F.col("arm") == arm).alias("a"), F.count_if(F.col("arm") == base).alias("b"))
    w = Window.partitionBy("budget").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.withColumn("above", F.coalesce(F.sum("b").over(w), F.lit(0)))
    return above.groupBy("budget").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("above")).alias("wins")).select("budget", "n_a", "n_b", ratio(F.col("wins"), F.col("n_a") * F.col("n_b")).alias("cles"))


def paired(receipts: DataFrame, arm: str, base: str) -> DataFrame:
    """Both arms' rows of a problem side by side: one aggregation by (budget, problem) instead of a self-join."""
    pick = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    both = receipts.where(F.col("arm").isin(arm, base)).groupBy("budget", "problem_id").agg(pick(arm, "is_correct").alias("ok_a"), pick(base, "is_correct").alias("ok_b"), pick(arm, "mj").alias("mj_a"), pick(base, "mj").alias("mj_b"))
    return both.where("ok_a is not null and ok_b is not null")


#: Weights of Poisson(1) by the first 16 bits of a hash, so each probability is met to 2^-16.
_CUMULATED = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
POISSON = np.searchsorted(_CUMULATED, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def poisson_weights(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """A weight for each key and replicate, from a hash of both."""
    mix = lambda x, shift, factor: (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    spread = lambda x: mix(mix(x, 30, 0xBF58476D1CE4E5B9), 27, 0x94D049BB133111EB)
    start = spread(keys.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    steps = np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return POISSON[spread(start[:, None] + steps) >> np.uint64(48)]


def outcome_weights(keys: np.ndarray, counts: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """The summed weights of ``counts`` problems for each key and replicate: Poisson(count), from a stream of the key's own."""
    weights = poisson_weights(keys, reps, seed).astype(float)
    for i in np.flatnonzero(counts > 1):
        stream = np.random.Philox(key=[int(keys[i]) & (2**64 - 1), seed & (2**64 - 1)])
        weights[i] = np.random.Generator(stream).poisson(counts[i], reps)
    return weights


def paired_bootstrap(receipts: DataFrame, arm: str, base: str, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """95 % interval of (joules per correct of base minus arm), resampling problems, by budget.

    Each problem has a Poisson(1) weight in each replicate, so a replicate is a sum and problems need not meet in one
    task.  Problems of equal outcome count alike, and n such weights add up to a Poisson(n) weight: one is drawn for each
    distinct outcome and replicate.  Where all outcomes differ that is a draw for each problem and replicate, as it must be.
    Draws hang on outcome, count and seed only, never on tasks.  Replicates without a correct answer drop out; bounds are
    elements of the sorted replicates, not interpolated.
    """
    values = ["ok_a", "ok_b", "mj_a", "mj_b"]
    outcomes = paired(receipts, arm, base).groupBy("budget", *values).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("budget", *values))
    outcomes = outcomes.repartition(outcomes.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work

    def sums(batches):
        total = {}
        for rows in batches:
            for budget, own in rows.groupby("budget"):
                sofar = total.setdefault(int(budget), np.zeros((reps, 4)))
                for k in range(0, len(own), 128):
                    part = own.iloc[k : k + 128]
                    sofar += outcome_weights(part["key"].to_numpy(np.int64), part["n"].to_numpy(np.int64), reps, seed).T @ part[values].to_numpy(float)
        for budget, sofar in total.items():
            yield pd.DataFrame({"budget": budget, "rep": np.arange(reps)} | {c: sofar[:, i] for i, c in enumerate(values)})

    partial = outcomes.mapInPandas(sums, "budget int, rep int, ok_a double, ok_b double, mj_a double, mj_b double")
    each = partial.groupBy("budget", "rep").agg(*[F.sum(c).alias(c) for c in ("ok_a", "ok_b", "mj_a", "mj_b")]).where("ok_a > 0 and ok_b > 0")
    delta = (F.col("mj_b") / F.col("ok_b") - F.col("mj_a") / F.col("ok_a")) / 1000.0
    listed = each.groupBy("budget").agg(F.sort_array(F.collect_list(delta)).alias("d"))
    at = lambda q: F.get("d", F.floor(F.size("d") * q).cast("int"))
    return listed.select("budget", F.size("d").alias("n_reps"), at(0.025).alias("lo"), at(0.975).alias("hi")).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def decision(receipts: DataFrame, arm: str, base: str, slack: float = 0.02) -> DataFrame:
    """The accuracy clause of the decision rule by budget, with both accuracies and their difference."""
    acc = lambda a: ratio(F.count_if((F.col("arm") == a) & F.col("is_correct")), F.count_if(F.col("arm") == a))
    cells = receipts.groupBy("budget").agg(acc(arm).alias("acc_arm"), acc(base).alias("acc_base"))
    return cells.withColumn("delta", F.col("acc_arm") - F.col("acc_base")).withColumn("verdict", F.when(F.col("acc_arm") >= F.col("acc_base") - slack, "CONFIRMED").otherwise("NULL"))


def decision_with_interval(receipts: DataFrame, arm: str, base: str, slack: float = 0.02, reps: int = 10_000, seed: int = 42) -> DataFrame:
    """The whole rule by budget: confirmed if the interval of saved energy excludes zero and accuracy holds.

    ``adds_format_value`` asks for savings, so for a lower bound above zero.  A budget without an interval is not confirmed.
    """
    rows = decision(receipts, arm, base, slack).withColumnRenamed("verdict", "accuracy_verdict")
    bounds = paired_bootstrap(receipts, arm, base, reps, seed)
    held = F.col("accuracy_verdict") == "CONFIRMED"
    both = rows.join(bounds, "budget", "left").withColumn("excludes_zero", F.coalesce("excludes_zero", F.lit(False)))
    saves = F.coalesce(F.col("lo") > 0, F.lit(False))
    return both.withColumn("adds_format_value", saves & held).withColumn("verdict", F.when(F.col("excludes_zero") & held, "CONFIRMED").otherwise("NULL"))

"""Aggregations over receipts: one hash aggregation each, with formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quantiles that the interval is used with.
Z_ROUNDED, Z_EXACT, Z_SHORT = 1.96, 1.959963984540054, 1.95996
THRESHOLDS = (32, 64, 128, 256, 512, 1024, 2048)


def count_if(c: Column) -> Column:
    return F.count_if(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null for b = 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z_ROUNDED) -> tuple[Column, Column]:
    """Bounds of the score interval; (0, 0) for no observations."""
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    zz = z * z
    den = F.lit(1.0) + F.try_divide(F.lit(zz), n)
    centre = p + F.try_divide(F.lit(zz), n * 2.0)
    half = F.sqrt(F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(F.lit(zz), n * n * 4.0)) * F.lit(z)
    return F.coalesce(F.greatest(F.lit(0.0), (centre - half) / den), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (centre + half) / den), F.lit(0.0))


def cells_of(receipts: DataFrame, keys=("arm", "budget")) -> DataFrame:
    """The sums of each cell that its summary is made of; sums of parts add up to those of the whole."""
    return receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_correct")).alias("correct"), count_if(F.col("truncated")).alias("truncated"), F.sum("mj").cast("long").alias("mj"), F.sum("tokens_emitted").cast("long").alias("tokens"))


def summarised(cells: DataFrame, keys=("arm", "budget"), z: float = Z_ROUNDED) -> DataFrame:
    lo, hi = wilson(F.col("correct"), F.col("n"), z)
    return cells.select(*keys, "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), lo.alias("ci_lo"), hi.alias("ci_hi"), "truncated", (F.col("mj") / 1000.0).alias("total_joules"), ratio(F.col("mj"), F.col("correct") * 1000).alias("joules_per_correct"), ratio(F.col("tokens"), F.col("n")).alias("mean_tokens"))


def cell_summary(receipts: DataFrame, keys=("arm", "budget"), z: float = Z_ROUNDED) -> DataFrame:
    """n, correct, accuracy, interval, truncated, joules, joules per correct (null for none) and mean tokens per cell."""
    return summarised(cells_of(receipts, keys), keys, z)


def category_accuracy(receipts: DataFrame, low: int = 5) -> DataFrame:
    cells = receipts.groupBy("budget", "category", "arm").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_correct")).alias("correct"))
    lo, hi = wilson(F.col("correct"), F.col("n"))
    return cells.select("budget", "category", "arm", "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), lo.alias("ci_lo"), hi.alias("ci_hi"), (F.col("n") < low).alias("low_n"))


def overthinking(receipts: DataFrame, keys=("arm", "budget"), thresholds=THRESHOLDS) -> DataFrame:
    """Accuracy within each token threshold, the area under it, token efficiency and their harmonic mean."""
    within = [count_if(F.col("is_correct") & (F.col("tokens_emitted") <= t)).alias(f"k_{t}") for t in thresholds]
    cells = receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("is_correct")).alias("correct"), F.sum("tokens_emitted").alias("tokens"), *within)
    n = F.col("n").cast("double")
    # the area over [0, t1, t2, ...] of the counts, as an integer twice as large, divided once
    twice, before, prior = F.lit(0), 0, F.lit(0)
    for t in thresholds:
        twice = twice + (prior + F.col(f"k_{t}")) * (t - before)
        before, prior = t, F.col(f"k_{t}")
    accuracy = ratio(F.col("correct"), F.col("n"))
    mean = F.col("tokens") / n
    economy = F.least(F.lit(1.0), F.lit(256.0) / F.greatest(mean, F.lit(1.0)))
    out = cells.select(*keys, "n", accuracy.alias("accuracy"), mean.alias("mean_tokens"), *[(F.col(f"k_{t}") / n).alias(f"oaa_{t}") for t in thresholds], (twice / (n * 2.0 * thresholds[-1])).alias("auc_oaa"), economy.alias("token_efficiency"))
    both = F.col("accuracy") + F.col("token_efficiency")
    return out.withColumn("overthinking_score", F.when(both > 0, F.col("accuracy") * 2.0 * F.col("token_efficiency") / both).otherwise(F.lit(0.0)))


def choke(low: Column, high: Column) -> Column:
    """Share of the accuracy at the large budget that the small budget loses."""
    return F.when(high > 1e-6, (high - low) / high).when(low <= 1e-6, F.lit(0.0)).otherwise(F.lit(-1.0))


def budget_choke_factor(receipts: DataFrame, low: int = 256, high: int = 2048) -> DataFrame:
    part = lambda b: (F.count_if((F.col("budget") == b) & F.col("is_correct")), F.count_if(F.col("budget") == b))
    (k0, n0), (k1, n1) = part(low), part(high)
    arms = receipts.where(F.col("budget").isin(low, high)).groupBy("arm").agg(ratio(k0, n0).alias("acc_low"), ratio(k1, n1).alias("acc_high"))
    return arms.withColumn("choke_factor", choke(F.col("acc_low"), F.col("acc_high")))


def posthoc_budgets(receipts: DataFrame, budgets=(64, 128, 256, 512, 1024, 2048)) -> DataFrame:
    """What one run would have scored under smaller budgets; energy is prorated by tokens, in whole millijoules."""
    b = F.explode(F.array(*map(F.lit, budgets))).alias("limit")
    rows = receipts.select("arm", "is_correct", "tokens_emitted", "mj", b)
    right = F.col("is_correct") & (F.col("tokens_emitted") <= F.col("limit"))
    spent = F.when(F.col("tokens_emitted") <= F.col("limit"), F.col("mj")).otherwise(F.expr("mj * limit div tokens_emitted"))
    cells = rows.groupBy("arm", "limit").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.sum(spent).alias("mj"))
    return cells.select("arm", "limit", "n", "correct", ratio(F.col("correct"), F.col("n")).alias("accuracy"), "mj", ratio(F.col("mj"), F.col("correct") * 1000).alias("joules_per_correct"))


def contamination_gap(receipts: DataFrame, alert: float = 0.05) -> DataFrame:
    clean = ~F.col("is_contaminated")
    cells = receipts.groupBy("arm", "budget").agg(ratio(F.count_if(F.col("is_correct")), F.count(F.lit(1))).alias("acc_all"), ratio(F.count_if(F.col("is_correct") & clean), F.count_if(clean)).alias("acc_clean"))
    return cells.withColumn("gap", F.col("acc_all") - F.col("acc_clean")).withColumn("alert", F.abs(F.col("gap")) > alert)


def rollups(receipts: DataFrame) -> DataFrame:
    """Three independent rollups in one pass: by category, by year and by arm."""
    sets = receipts.groupingSets([["category"], ["year"], ["arm"]], "category", "year", "arm")
    return sets.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.sum("tokens_emitted").alias("tokens"), F.count_if("truncated").alias("truncated"))


def information_efficiency(receipts: DataFrame, base_arm: str = "A") -> DataFrame:
    """Both scales of accuracy per token, traffic, and ratios to the base arm, by budget."""
    cells = receipts.groupBy("budget", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.sum("tokens_emitted").alias("tokens"), F.min("tokens_emitted").alias("min_tokens"), F.max("tokens_emitted").alias("max_tokens"))
    acc, mean = F.col("correct") * 100.0 / F.col("n"), F.col("tokens") / F.col("n").cast("double")
    cells = cells.select("budget", "arm", "n", "correct", "tokens", "min_tokens", "max_tokens", acc.alias("pass_at_1"), (acc / (mean / 100.0)).alias("per_hundred"), (acc / mean * 1000.0).alias("per_thousand"), (mean * 3.0).alias("traffic"))
    base = cells.where(F.col("arm") == base_arm).select("budget", F.col("tokens").alias("base_tokens"), F.col("per_thousand").alias("base_rate"))
    joined = cells.join(base, "budget")  # one row per budget
    return joined.select(*cells.columns, ((1 - F.col("tokens") / F.col("base_tokens")) * 100.0).alias("compression"), (F.col("per_thousand") / F.greatest(F.col("base_rate"), F.lit(0.001))).alias("rate_multiple"))


def ock_score(receipts: DataFrame, english_tokens: int = 250) -> DataFrame:
    """Accuracy times one plus the log of the token saving (never below one)."""
    cells = receipts.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.sum("tokens_emitted").alias("tokens"))
    saving = F.col("n") * float(english_tokens) / F.col("tokens")
    return cells.select("arm", "n", ratio(F.col("correct"), F.col("n")).alias("accuracy"), ((1 - 1 / saving) * 100.0).alias("savings"), (ratio(F.col("correct"), F.col("n")) * (1 + F.ln(F.greatest(F.lit(1.0), saving)))).alias("ock"))


def distribution(receipts: DataFrame, *keys: str) -> DataFrame:
    return receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

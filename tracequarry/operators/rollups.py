"""Summaries of graded completions: slices of receipts, rollups by dimension, arms by subject, and the two benchmark headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import choke, overthinking, ratio, wilson

#: Fixed value: what a verdict of the symbolic layer is called.
RESCUED = "sympy_symbolic"


def slices(receipts: DataFrame) -> DataFrame:
    """(scope, arm, budget, ..) of all receipts and of the clean ones: each arm and budget, each arm, and the whole, in one pass.

    Accuracy and interval have 4 digits, joules 2, tokens 1; joules per correct answer are null without one.  ``rescued`` counts verdicts of the symbolic layer.
    """
    scope = F.explode(F.when(F.coalesce("is_contaminated", F.lit(False)), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean")))).alias("scope")
    rows = receipts.select("*", scope)
    sets = rows.groupingSets([["scope", "arm", "budget"], ["scope", "arm"], ["scope"]], "scope", "arm", "budget")
    cells = sets.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.count_if("truncated").alias("truncated"), F.sum("mj").alias("mj"),
        F.sum("tokens_emitted").alias("tokens"), F.count_if(F.col("verification_method") == RESCUED).alias("rescued"),
    )
    lo, hi = wilson(F.col("correct"), F.col("n"))
    return cells.select(
        "scope", "arm", "budget", "n", "correct", F.round(ratio(F.col("correct"), F.col("n")), 4).alias("accuracy"), F.round(lo, 4).alias("ci_lo"), F.round(hi, 4).alias("ci_hi"), "truncated",
        F.round(F.col("mj") / 1000.0, 2).alias("total_joules"), F.round(ratio(F.col("mj"), F.col("correct") * 1000), 2).alias("joules_per_correct"), F.round(ratio(F.col("tokens"), F.col("n")), 1).alias("mean_tokens"), "rescued",
    )


def by_dimension(rows: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, ..): independent rollups of graded completions in one pass; rows without a value of a dimension are not in it.

    ``rows`` has is_correct, tokens_emitted, english_tokens and the flags noise, bypass, plan and intent.
    """
    numbers = {d: F.grouping_id().alias("_set") for d in dimensions[:1]}
    sets = rows.groupingSets([[d] for d in dimensions], *dimensions)
    flags = [F.count_if(f).alias(f"{f}_count") for f in ("noise", "bypass", "plan", "intent")]
    cells = sets.agg(*numbers.values(), F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.sum("tokens_emitted").alias("symbolic_tokens"), F.sum("english_tokens").alias("english_tokens"), *flags)
    # A dimension's bit is 0 in its own set; the first has the highest bit.
    whole, k = (1 << len(dimensions)) - 1, len(dimensions)
    mine = [F.col("_set") == whole - (1 << (k - 1 - i)) for i in range(k)]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, d in zip(mine, dimensions):
        name, value = F.when(own, d).otherwise(name), F.when(own, F.col(d).cast("string")).otherwise(value)
    found = cells.withColumns({"dimension": name, "value": value}).where("value IS NOT NULL AND value <> ''")
    saved = (1 - ratio(F.col("symbolic_tokens"), F.col("english_tokens"))) * 100.0
    return found.select("dimension", "value", "total", "correct", "symbolic_tokens", "english_tokens", "noise_count", "bypass_count", "plan_count", "intent_count", F.round(F.col("correct") * 100.0 / F.col("total"), 2).alias("accuracy"), F.round(saved, 2).alias("compression"))


def arms_by_subject(rows: DataFrame) -> DataFrame:
    """(arm, subject, ..): a row for each arm (subject null) and for each of its subjects, in one pass.

    ``rows`` has arm, subject, is_correct, truncated, tokens and latency_ms.  Rows without a subject count in their arm only.
    """
    sets = rows.groupingSets([["arm"], ["arm", "subject"]], "arm", "subject")
    cells = sets.agg(
        F.grouping("subject").alias("_all"), F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"), F.count_if("truncated").alias("truncated"), F.sum("latency_ms").alias("latency_ms"),
    ).where("_all = 1 OR subject IS NOT NULL")
    accuracy, mean = F.col("correct") * 100.0 / F.col("n"), F.col("tokens") / F.col("n").cast("double")
    return cells.select(
        "arm", "subject", "n", "correct", F.round(accuracy, 2).alias("pass_at_1"), F.round(mean, 1).alias("mean_tokens"), "min_tokens", "max_tokens", F.round(F.col("truncated") * 100.0 / F.col("n"), 2).alias("truncation_rate"),
        F.round(F.col("latency_ms") / 1000.0 / F.col("n"), 2).alias("mean_latency"), F.round(F.coalesce(F.try_divide(accuracy, mean), F.lit(0.0)) * 1000.0, 2).alias("information_efficiency"), F.round(mean * 3.0, 1).alias("traffic"),
    )


def overthinking_with_choke(receipts: DataFrame, low: int = 256, high: int = 2048) -> DataFrame:
    """Overthinking of each arm and budget beside the arm's choke factor.

    The large budget is ``high``; where an arm lacks it, the largest budget of all receipts; where it lacks that too, its accuracy counts as 0, as at a lacking ``low``.
    """
    cells = receipts.groupBy("arm", "budget").agg(ratio(F.count_if("is_correct"), F.count(F.lit(1))).alias("accuracy"))
    largest = cells.agg(F.max("budget").alias("largest"))
    at = lambda budget: F.max(F.when(F.col("budget") == budget, F.col("accuracy")))
    arms = cells.crossJoin(F.broadcast(largest)).groupBy("arm")  # a single row beside a row for each arm and budget
    arms = arms.agg(F.coalesce(at(F.lit(low)), F.lit(0.0)).alias("acc_low"), F.coalesce(at(F.lit(high)), at(F.col("largest")), F.lit(0.0)).alias("acc_high"))
    arms = arms.withColumn("choke_factor", choke(F.col("acc_low"), F.col("acc_high")))
    return overthinking(receipts).join(arms, "arm")


def modern_headline(rows: DataFrame, *keys: str, clean: Column) -> DataFrame:
    """(keys, n, correct, pass_at_1, cleanliness, tokens, savings, ock): the headline of a benchmark, percentages with 2 digits.

    ``rows`` has is_correct, tokens_emitted and english_tokens; ``clean`` tells whether a completion ends cleanly.  The score is the accuracy in per cent times
    1 + ln of how many times fewer tokens there are than in English, at least 1.
    """
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), F.count_if(clean).alias("clean"), F.sum("tokens_emitted").alias("tokens"), F.sum("english_tokens").alias("english"))
    accuracy = F.col("correct") * 100.0 / F.col("n")
    fewer = F.when(F.col("tokens") > 0, F.col("english") / F.col("tokens").cast("double")).otherwise(1.0)
    saved = F.when(F.col("english") > 0, (1 - F.col("tokens") / F.col("english").cast("double")) * 100.0).otherwise(0.0)
    return cells.select(
        *keys, "n", "correct", F.round(accuracy, 2).alias("pass_at_1"), F.round(F.col("clean") * 100.0 / F.col("n"), 2).alias("cleanliness"), "tokens", "english",
        F.round(saved, 2).alias("savings"), F.round(accuracy * (1 + F.log(F.greatest(F.lit(1.0), fewer))), 2).alias("ock"),
    )


def proxy_grid(receipts: DataFrame, decay: float = 500.0, tight: int = 256) -> DataFrame:
    """The grid of arms and budgets with stand-ins for the curve metrics: an economy that falls off with the mean length.

    ``auc_proxy`` is accuracy times economy, ``overthinking_proxy`` their harmonic mean; joules per correct answer are null without one.
    """
    right = F.count_if("is_correct")
    cells = receipts.groupBy("arm", "budget").agg(
        F.count(F.lit(1)).alias("n"), right.alias("correct"), F.avg("tokens_emitted").alias("mean_tokens"), (F.sum("mj") / 1000.0 / F.count(F.lit(1))).alias("mean_joules"),
        F.count_if(F.col("is_correct") & (F.col("tokens_emitted") <= tight)).alias("_within"),
    )
    share, economy = F.col("correct") / F.col("n").cast("double"), F.exp(-F.col("mean_tokens") / decay)
    lo, hi = wilson(F.col("correct"), F.col("n"))
    return cells.select(
        "arm", "budget", "n", "correct", (share * 100.0).alias("accuracy"), (lo * 100.0).alias("ci_lo"), (hi * 100.0).alias("ci_hi"), "mean_tokens", "mean_joules", F.try_divide(F.col("mean_joules"), share).alias("joules_per_correct"),
        (F.col("_within") * 100.0 / F.col("n")).alias("oaa_tight"), (share * economy).alias("auc_proxy"), F.when(share + economy > 0, 2 * share * economy / (share + economy)).otherwise(0.0).alias("overthinking_proxy"),
    )


def cache_footprint(receipts: DataFrame, *, layers: int = 28, heads: int = 12, head_dim: int = 128, bytes_each: int = 2, memory_mb: int = 4096) -> DataFrame:
    """What an arm's sequences hold of a key-value cache: bytes a token, MB of the mean sequence, and how many fit ``memory_mb`` at once."""
    a_token = 2 * layers * heads * head_dim * bytes_each
    mb = F.avg("tokens_emitted") * a_token / F.lit(1048576.0)
    cells = receipts.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("tokens_emitted").alias("mean_tokens"), mb.alias("mb"))
    return cells.select("arm", "n", F.lit(a_token).cast("long").alias("bytes_a_token"), "mean_tokens", "mb", F.floor(F.try_divide(F.lit(float(memory_mb)), F.col("mb"))).alias("concurrent"))

"""Summaries of valuations, ablations, conversions and audits, and the small selections that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curriculum import hash_order
from .metrics import ratio, wilson

#: Rows are numbered bucket by bucket; only the sizes of so many buckets are added up in one place.
NUMBER_BUCKETS = 4096


def _cells(receipts: DataFrame, keys, *more: Column) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tokens_emitted", "latency_ms")]
    return receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"), *sums, *more)


def valuation(receipts: DataFrame, keys=("arm",)) -> DataFrame:
    """Accuracy, energy and latency per correct answer (null for none), means, and whether any energy is an estimate."""
    n, correct = F.col("n"), F.col("correct")
    cells = _cells(receipts, keys, F.sum("mj").alias("mj"), F.bool_or("is_estimate").alias("is_estimate"))
    return cells.select(
        *keys, "n", "correct", ratio(correct, n).alias("accuracy"), (F.col("mj") / 1000.0).alias("total_joules"), ratio(F.col("mj"), correct * 1000).alias("joules_per_correct"),
        ratio(F.col("latency_ms"), correct * 1000).alias("latency_per_correct"), ratio(F.col("latency_ms"), n * 1000).alias("mean_latency"), ratio(F.col("tokens_emitted"), n).alias("mean_tokens"), "is_estimate",
    )


def ablation(receipts: DataFrame, base: str = "A") -> DataFrame:
    """Accuracy with its interval, token range, latency, pass rate per token, and the base arm's mean tokens over an arm's."""
    cells = _cells(receipts, ["arm"], F.min("tokens_emitted").alias("min_tokens"), F.max("tokens_emitted").alias("max_tokens"))
    n, correct, mean = F.col("n"), F.col("correct"), ratio(F.col("tokens_emitted"), F.col("n"))
    lo, hi = wilson(correct, n)
    of_base = F.max(F.when(F.col("arm") == base, mean)).over(Window.partitionBy(F.lit(0)))  # a row per arm
    return cells.select("arm", "n", "correct", ratio(correct, n).alias("accuracy"), lo.alias("ci_lo"), hi.alias("ci_hi"), mean.alias("mean_tokens"), "min_tokens", "max_tokens", ratio(F.col("latency_ms"), n * 1000).alias("mean_latency"), F.try_divide(ratio(correct, n) * 100.0, mean).alias("pass_per_token"), F.try_divide(of_base, mean).alias("compression"))


def conversion(rows: DataFrame, source: str = "source") -> DataFrame:
    """Processed, converted and rejected by source, and the mean compression of what was converted.

    Expects ``converted``, ``english_tokens`` and ``symbolic_tokens``.  Compressions are added in whole billionths, so any order gives one result.
    """
    done = F.col("converted")
    saved = F.round((1 - F.col("symbolic_tokens") / F.greatest(F.col("english_tokens"), F.lit(1))) * 1e9).cast("long")
    sums = rows.groupBy(source).agg(F.count(F.lit(1)).alias("processed"), F.count_if(done).alias("converted"), F.sum(F.when(done, saved)).alias("saved"))
    return sums.select(source, "processed", "converted", (F.col("processed") - F.col("converted")).alias("rejected"), (ratio(F.col("saved"), F.col("converted")) / 1e9).alias("mean_compression"))


def token_savings(rows: DataFrame) -> DataFrame:
    """One row: tokens in English and in symbols, what is saved in per cent, and the time taken."""
    sums = rows.agg(F.sum("english_tokens").alias("english_tokens"), F.sum("symbolic_tokens").alias("symbolic_tokens"), F.sum("latency_ms").alias("ms"))
    saved = (1 - ratio(F.col("symbolic_tokens"), F.col("english_tokens"))) * 100.0
    return sums.select("english_tokens", "symbolic_tokens", saved.alias("savings"), (F.col("ms") / 1000.0).alias("seconds"))


def plain_pass_rate(traces: DataFrame, answer: Column, matches) -> DataFrame:
    """One row: rows, right ones and their share, by an answer policy and a verifier ``matches(answer, truth)``."""
    right = F.coalesce(matches(F.col("_answer"), F.col("ground_truth")), F.lit(False))
    rows = traces.select("ground_truth", answer.alias("_answer")).select(right.alias("right"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("correct")).withColumn("pass_at_1", ratio(F.col("correct"), F.col("n")))


def dimensions(receipts: DataFrame, *names: str) -> DataFrame:
    """(dimension, value): the distinct values of each column, in one pass."""
    seen = receipts.groupingSets([[c] for c in names], *names).agg(F.grouping_id().alias("g"))
    pick = [((F.col("g") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))), c) for i, c in enumerate(names)]
    first = lambda made: F.coalesce(*[F.when(own, made(c)) for own, c in pick])
    return seen.select(first(F.lit).alias("dimension"), first(lambda c: F.col(c).cast("string")).alias("value"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; tasks keep no more than that before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def audited(items: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    """Items with their verdict; an item that was never scored counts as wrong."""
    verdicts = scored.select(id_col, F.col("is_correct").alias("_scored"))
    return items.join(verdicts, id_col, "left").withColumn("is_correct", F.coalesce("_scored", F.lit(False))).drop("_scored")


def numbered(rows: DataFrame, id_col: str, pattern: str = "EVAL-200-%03d", seed: int = 42) -> DataFrame:
    """Rows with ``place`` (from 1) in a reproducible shuffle and a label made of it.

    Rows meet by the first digits of their hash; only bucket sizes are added up across them.
    """
    keyed = rows.withColumn("_h", hash_order(id_col, seed)).withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most NUMBER_BUCKETS rows
    starts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", id_col))
    placed = keyed.withColumn("_within", within).join(F.broadcast(starts), "_bucket").withColumn("place", F.col("_start") + F.col("_within"))
    return placed.withColumn("label", F.format_string(pattern, "place")).drop("_h", "_bucket", "_within", "_start")


def ordered_distinct(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(value, position): each value once, where it came first."""
    return rows.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


def token_audit(rows: DataFrame) -> DataFrame:
    """Each example's compression to three places."""
    return rows.withColumn("compression", F.round(1 - F.col("symbolic_tokens") / F.greatest(F.col("english_tokens"), F.lit(1)), 3))

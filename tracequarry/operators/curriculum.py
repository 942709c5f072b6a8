"""Sampling and curriculum: stratified, quota and round-robin selection, mixes, injected negatives, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import number
from ..functions.text import stripped


def ranked(df: DataFrame, strata, *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))


def hash_order(id_col: str, seed: int) -> Column:
    """A reproducible shuffle: the same in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, k: int = 40, seed: int = 42) -> DataFrame:
    """At most ``k`` rows of each stratum, by hash; keeping the best k per task first lets large strata stay apart."""
    return ranked(df, [stratum], hash_order(id_col, seed), id_col).where(F.col("rn") <= k)


def round_robin(df: DataFrame, strata: list[str], id_col: str, limit: int) -> DataFrame:
    """One row of each stratum in turn until ``limit``; ordered by turn, then stratum."""
    return ranked(df, strata, id_col).where(F.col("rn") <= limit).orderBy("rn", *strata).limit(limit)


def quota_fill(df: DataFrame, stratum: str, id_col: str, total: int = 200) -> DataFrame:
    """``total // strata`` rows of each stratum, then the rest in turns from strata that have more."""
    n = df.select(stratum).distinct().count()
    quota = total // max(n, 1)
    return ranked(df, [stratum], id_col).where(F.col("rn") <= total).orderBy(F.col("rn") > quota, "rn", stratum).limit(total)


def split_rows(df: DataFrame, id_col: str, validation: int = 500, seed: int = 42) -> DataFrame:
    """``split`` = validation for the first rows by hash, else train; the cut is found with a bounded top-k, not a global rank."""
    h = hash_order(id_col, seed)
    last = df.select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(validation).agg(F.max(F.struct("h", "i")).alias("m")).first()["m"]
    if last is None:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(F.struct(h.alias("h"), F.col(id_col).alias("i")) <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["i"]).alias("i")), "validation").otherwise("train"))


#: Concepts that are left alone when negatives are injected (fixed values of the recipe's domains).
EXEMPT = ("factual_bypass", "intent_dialogue", "social_dialogue", "factual")


def inject_negatives(samples: DataFrame, id_col: str, domain_col: str = "domain", text_col: str = "full_target") -> DataFrame:
    """Every third row of a domain outside the exempt ones starts with a hypothesis that is checked and dropped.

    The place of a row is its rank by id; a running count per id range would do as well at scale, since only the
    remainder matters, so ids that are numbers are used as they are.
    """
    picked = (F.col(id_col) % 3 == 0) & F.contains(F.col(text_col), F.lit("<think>")) & ~F.col(domain_col).isin(*EXEMPT)
    guess = F.when(F.col(domain_col).rlike("polynomial"), "hyp [u^2 = u + 2] | verify(u^2 == u + 2)✗ | backtrack | ").when(F.col(domain_col).rlike("remainder"), "hyp [x = r1 + m1] | verify(x % m2 == r2)✗ | backtrack | ").when(F.col(domain_col).rlike("legendre"), "hyp [v = n // p] | verify(v == total)✗ | backtrack | ").otherwise("hyp [first guess] | verify(first guess)✗ | backtrack | ")
    return samples.withColumn("is_contrastive_negative", F.coalesce(picked, F.lit(False))).withColumn(text_col, F.when(F.col("is_contrastive_negative"), F.replace(F.col(text_col), F.lit("<think>"), F.concat(F.lit("<think>"), guess))).otherwise(F.col(text_col)))


def replay_mix(new: DataFrame, old: DataFrame, id_col: str, anchors: int = 200, seed: int = 42) -> DataFrame:
    """New samples and a seeded handful of older ones; columns missing on one side are null."""
    kept = old.orderBy(hash_order(id_col, seed), id_col).limit(anchors)
    return new.withColumn("origin", F.lit("new")).unionByName(kept.withColumn("origin", F.lit("anchor")), allowMissingColumns=True)


def chat_format(df: DataFrame, prompt: str, answer: str, system: str) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), stripped(c).alias("content"))
    return df.withColumn("messages", F.array(turn("system", F.lit(system)), turn("user", F.col(prompt)), turn("assistant", F.col(answer))))


def quality_gate(rows: DataFrame, extracted: Column, *, least: float = 0.5, confidence_col: str = "confidence", answer_col: str = "answer") -> DataFrame:
    """Converted rows that may stay: sure enough, and with the answer that was asked for.

    A conversion whose trace shows no answer stays.  Numbers may differ by 1e-4; other answers must be equal but for blanks around them.
    """
    answer = F.col(answer_col)
    x, y = number(stripped(extracted)), number(stripped(answer))
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 1e-4).otherwise(stripped(extracted) == stripped(answer))
    silent = F.coalesce(extracted, F.lit("")) == ""
    return rows.where((F.coalesce(confidence_col, F.lit(0.0)) >= least) & (silent | F.coalesce(same, F.lit(False))))


def split_report(rows: DataFrame, split_col: str = "split", source_col: str = "source") -> DataFrame:
    """The stats of a split data set: for each split, and for each source in it, its rows and mean compression (3 digits)."""
    saved = 1 - F.col("symbolic_tokens") / F.greatest("english_tokens", F.lit(1)).cast("double")
    sets = rows.select(split_col, source_col, saved.alias("_saved")).groupingSets([[split_col], [split_col, source_col]], split_col, source_col)
    return sets.agg(F.grouping(source_col).cast("boolean").alias("whole"), F.count(F.lit(1)).alias("n"), F.round(F.avg("_saved"), 3).alias("avg_compression"))

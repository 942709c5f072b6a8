"""Train and benchmark contamination: exact texts, shared word runs, clean splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, normal_words

#: Up to so many distinct benchmark runs are broadcast to the corpus; beyond that both sides are joined by run.
BROADCAST_GRAMS = 500_000


def _marks(words: Column, n: int) -> Column:
    """128-bit hashes of the whole text (kind T) and of each run of ``n`` words (kind G); a shorter text is one run.

    Each word is hashed once; runs are told by the hashes of their words.  Repeated runs stay.
    """
    mark = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

    def of(h: Column) -> Column:
        run = lambda i: mark("G", *[F.coalesce(F.get(h, i + k), F.lit(0).cast("long")) for k in range(n)])
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), run)
        return F.concat(F.array(mark("T", h)), F.when(F.size(h) == 0, F.slice(runs, 1, 0)).otherwise(runs))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def contamination_status(train: DataFrame, bench: DataFrame, *, text_col: str = "text", id_col: str = "item_id", n: int = 8, least: int = 2) -> DataFrame:
    """(id, status, shared): exact if the normalised text is in the corpus, overlap from ``least`` shared runs, else clean.

    The corpus is read once and turned into hashes of its texts and word runs; only those that the benchmark has
    as well get past the scan, so what is shuffled is at most the benchmark's own size per task.
    """
    items = bench.select(id_col, F.explode(_marks(normal_words(F.coalesce(F.col(text_col), F.lit(""))), n)).alias("m")).select(id_col, "m.*").distinct()
    wanted = items.select("kind", "h1", "h2").distinct()
    if wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    words = train.select(normal_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    seen = words.select(F.explode(_marks(F.col("w"), n)).alias("m")).select("m.*").join(wanted, ["kind", "h1", "h2"], "left_semi").distinct().withColumn("hit", F.lit(1))
    found = items.join(seen, ["kind", "h1", "h2"], "left").groupBy(id_col).agg(F.count_if((F.col("kind") == "T") & F.col("hit").isNotNull()).alias("exact"), F.count_if((F.col("kind") == "G") & F.col("hit").isNotNull()).alias("shared"))
    status = F.when(F.col("exact") > 0, "exact").when(F.col("shared") >= least, "overlap").otherwise("clean")
    return found.select(id_col, status.alias("status"), F.col("shared").cast("long").alias("shared"))


def partition_counts(status: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # three rows
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)

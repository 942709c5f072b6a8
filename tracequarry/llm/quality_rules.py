"""Quality rules: per-text rules, and host verdicts from failure rates shrunk by an empirical beta prior.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A host goes when its shrunk failure rate is above this share.
MOST_HOST_FAILURES = 0.5
#: Up to so many rejected hosts are broadcast; beyond that both sides are joined by host.
BROADCAST_HOSTS = 100_000
LEAST_WORDS, MOST_REPEATED = 50, 50
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def text_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", keep: list[str] | None = None) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every whole text.

    All measures are array expressions within one row: nothing is exploded or shuffled.  Repeated windows
    are found by sorting 64-bit hashes of the windows with their places.  With ``keep`` the result has those columns of
    ``docs`` and the measures as a struct ``_m``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    body = F.btrim(text, F.lit(BLANKS))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    row = F.struct(*(keep or [id_col])).alias("_row")
    t = docs.select(row, host.alias("_host"), text.alias("_text"), words.alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    n = F.size("_words")
    windows = F.arrays_zip(F.slice("_words", F.lit(1), n - 2).alias("a"), F.slice("_words", F.lit(2), n - 2).alias("b"), F.slice("_words", F.lit(3), n - 2).alias("c"))
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(windows, lambda w: F.xxhash64(w.getField("a"), w.getField("b"), w.getField("c"))))
    t = t.select(
        "_row", "_host", n.cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), hashes.alias("_hashes"),
    )
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    t = t.select(
        "_row", "_host", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, placed).alias("_placed"),
    )
    m = F.size("_placed") - 1
    both = F.zip_with(F.slice("_placed", F.lit(1), m), F.slice("_placed", F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    t = t.withColumn("n_repeat_words", F.when(F.col("_placed").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    measures = [F.col("_host").alias("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed")]
    return t.select("_row.*", F.struct(*measures).alias("_m")) if keep else t.select("_row.*", *measures)


def host_rates(measures: DataFrame) -> DataFrame:
    """(host, n, failed, shrunk): failure rate of each host, drawn to a beta prior fitted to all hosts by moments.

    The prior's mean is the rate of all rows; its strength follows from the spread between hosts beyond what chance gives
    (at least 1, so a lone host keeps nearly its own rate).  Rows without a host form no host.
    """
    hosts = measures.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("sq"), F.count(F.lit(1)).alias("hosts"))
    mean = F.col("all_failed") / F.col("all_n")
    chance = mean * (1 - mean)
    spread = F.col("sq") / F.col("all_n") - mean * mean - chance * F.col("hosts") / F.col("all_n")
    strength = F.greatest(F.lit(1.0), F.when(spread > chance / 1e6, chance / spread - 1).otherwise(F.lit(1e6)))
    prior = total.select(mean.alias("mean"), strength.alias("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", ((F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunk"))


def _rejected_hosts(measures: DataFrame, most_failures: float) -> DataFrame:
    bad = cut(host_rates(measures).where(F.col("shrunk") > most_failures).select(F.col("host").alias("_h")))
    return F.broadcast(bad) if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else bad


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", most_failures: float = MOST_HOST_FAILURES) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    ``kept`` is false if the text fails a base rule or its host's shrunk failure rate is above ``most_failures``.
    Null text counts as empty (no words: fails); a null host is no host and only the base rules decide;
    repeated rows count as often as they occur; other columns are not read.  The measures are written once,
    then aggregated by host (partial sums); the rejected hosts are joined back, broadcast when they are few
    enough, else by host with large hosts split by the skew join.
    """
    measures = cut(text_measures(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    bad = _rejected_hosts(measures, most_failures).withColumn("_bad", F.lit(True))
    return measures.join(bad, F.col("host") == F.col("_h"), "left").select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept")
    )


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", most_failures: float = MOST_HOST_FAILURES) -> DataFrame:
    """The rows that pass, with all their columns, whatever their names.

    Base failures follow from the row alone, so texts are not moved: the measures are written beside the rows' own columns.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*inner.values())
    host = inner[host_col] if host_col else None
    measured = cut(text_measures(own, id_col=inner[id_col], text_col=inner[text_col], host_col=host, keep=own.columns))
    bad = _rejected_hosts(measured.select("_m.*"), most_failures)
    good = measured.where(~F.col("_m.base_failed")).join(bad, F.col("_m.host") == F.col("_h"), "left_anti")
    return good.select(*own.columns).toDF(*docs.columns)

"""Source divergence audit: how the word use of each source differs from its peers' and from its language's, in exact integers.

Terms are counted once, added up within a task before anything is shuffled.  A language's kept terms are dealt into shards by hash, and its
sources into seats; a task holds one shard of a block of seats.  Within a task the groups stay in their seats and compressed peer vectors
(term, share) rotate past them by the circle method, one tournament round at a time; a meeting is evaluated once for both
directions, as the measure is symmetric.  Only the terms that either side has are touched: what two groups owe each other for a term that
neither has is the same number for all such terms and is added in the end.  The tasks' best terms come from local heaps.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Documents of its language that a term must be in.
LEAST_DOCS = 10
SCALE, TOP = 1_000_000_000, 10
#: Terms of a shard, seats of a block.
SHARD_TERMS, BLOCK_SEATS = 4096, 32
#: Distinct terms that a counting task gathers before it hands them on; bytes of a long text split at once.
MOST_GATHERED, PIECE = 300_000, 1 << 20
#: A-Z lower-cased; letters and all bytes of non-ASCII characters stay, all others part terms.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of a bounded size."""
    begin, plain = 0, raw.translate(_SPLIT)
    while begin < len(plain):
        end = plain.find(b" ", begin + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end + 1


def term_counts(docs: DataFrame, *, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): partial counts, several rows a term; each group that occurs has a row without a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, Counter] = defaultdict(Counter)
        within: dict[tuple, Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in totals.items():
                n, docs_with = len(own), within[lang, source]
                terms = pa.array(own.keys(), pa.binary()).cast(pa.string())
                ones = pa.array(own.values(), pa.int64()), pa.array([docs_with[t] for t in own], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, *ones], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], schema=schema)
            totals.clear()
            within.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].cast(pa.large_binary())):
                own, docs_with, seen = totals[lang, source], within[lang, source], set()
                before = len(own)
                for words in terms_of(text.as_py()):
                    own.update(words)
                    seen.update(words)
                docs_with.update(seen)
                held += len(own) - before
                if held > MOST_GATHERED:
                    yield from handed_on()
                    held = 0
        yield from handed_on()
        release()

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)))
    return plain.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for counts up to the square of what a long holds."""
    above = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(11,0)")
    rest = above % (total + 2 * kept).cast("decimal(20,0)")
    return (1 + (above - rest) / (total + 2 * kept).cast("decimal(20,0)")).cast("long")


def gap(p, q):
    """floor((p - q) ** 2 / (p + q)) of integers of up to about 10 ** 9."""
    return (p - q) * (p - q) // (p + q)


def rounds(seats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rounds of a round-robin tournament by the circle method: (homes, peers), each pair of seats in one round."""
    ring = np.arange(seats + seats % 2)
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        homes, peers = ring[:half], ring[: half - 1 : -1]
        both = (homes < seats) & (peers < seats)
        yield homes[both], peers[both]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def rotations(left: int, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rounds in which each of ``left`` seats meets each of ``right`` others once, in as many rounds as the larger side has seats."""
    most = max(left, right)
    for turn in range(most):
        homes = np.arange(most)
        peers = (homes + turn) % most
        both = (homes < left) & (peers < right)
        yield homes[both], left + peers[both]


def meet(schedule: Iterator[tuple[np.ndarray, np.ndarray]], none: np.ndarray, seat: np.ndarray, term: np.ndarray, share_: np.ndarray, terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each round (homes, peers, value of each meeting over what is told apart by a term that either has).

    ``none`` is each seat's share of a term it lacks; rows (seat, term, share) are sorted by seat.  The value leaves out
    ``terms`` times the value of a term that neither has: it is what the present terms add to that.
    """
    seats = len(none)
    resident = np.repeat(none[:, None], terms, axis=1)
    resident[seat, term] = share_
    begin = np.searchsorted(seat, np.arange(seats + 1))
    for homes, peers in schedule:
        flat = gap(none[homes], none[peers])
        sizes = begin[homes + 1] - begin[homes]
        rows = np.repeat(begin[homes] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        match = np.repeat(np.arange(len(homes)), sizes)
        value = np.zeros(len(homes), np.int64)
        # What the home's own terms add against a peer that has none of them ..
        np.add.at(value, match, gap(share_[rows], none[peers][match]) - flat[match])
        # .. and what the terms of the peer that comes past change at the home's seat.
        sizes = begin[peers + 1] - begin[peers]
        rows = np.repeat(begin[peers] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        match = np.repeat(np.arange(len(peers)), sizes)
        own = resident[homes[match], term[rows]]
        np.add.at(value, match, gap(own, share_[rows]) - gap(own, none[peers][match]))
        yield homes, peers, value


def _tournament(top: int):
    schema = pa.schema([("lang", pa.string()), ("seat", pa.int64()), ("peer", pa.int64()), ("term", pa.string()), ("value", pa.int64())])

    def held(table: pa.Table) -> pa.Table:
        lang, low, high = table["lang"][0], table["low"][0].as_py(), table["high"][0].as_py()
        marks, rows = table.filter(table["term"].is_null()), table.filter(table["term"].is_valid())
        number = np.sort(marks["seat"].to_numpy())
        order = np.argsort(marks["seat"].to_numpy())
        none = marks["share"].to_numpy()[order]
        coded = rows["term"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        seat = np.searchsorted(number, rows["seat"].to_numpy())
        by = np.argsort(seat, kind="stable")
        seat, term, share_ = seat[by], coded.indices.to_numpy(zero_copy_only=False)[by], rows["share"].to_numpy()[by]
        cut_at = int((marks["block"].to_numpy()[order] == low).sum())
        schedule = rounds(len(number)) if low == high else rotations(cut_at, len(number) - cut_at)
        out = []
        for homes, peers, value in meet(schedule, none, seat, term, share_, len(coded.dictionary)):
            out.append((number[homes], number[peers], value))
        n = sum(len(x[0]) for x in out)
        a, b, v = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        parts = [pa.table([pa.array([lang.as_py()] * n, pa.string()), pa.array(a), pa.array(b), pa.nulls(n, pa.string()), pa.array(v)], schema=schema)]
        if low == high and len(seat):
            over = rows["whole"].to_numpy()[by]
            name = [x.encode() for x in coded.dictionary.to_pylist()]
            value = np.where(share_ > over, gap(share_, over), -1)
            edges = np.searchsorted(seat, np.arange(len(number) + 1))
            for s, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                least = max(0, np.partition(value[i:j], -top)[-top] if j - i > top else 0)
                best = heapq.nsmallest(top, ((-int(value[k]), name[term[k]]) for k in i + np.flatnonzero(value[i:j] >= least)))
                parts.append(pa.table([pa.array([lang.as_py()] * len(best), pa.string()), pa.array([number[s]] * len(best), pa.int64()), pa.nulls(len(best), pa.int64()), pa.array([t.decode() for _, t in best], pa.string()), pa.array([-x for x, _ in best], pa.int64())], schema=schema))
        return pa.concat_tables(parts)

    return held


def diverging_sources(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, block_seats: int = BLOCK_SEATS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language all others, most different first, and its ``top`` telling terms.

    Nulls count as empty; an empty language or source is one like any other.  A language without kept terms has value 0 for all
    pairs.  Ties rank by the item's UTF-8 bytes.  Repeated rows count each time; other columns are not read; an empty table gives no rows.
    One source of a language gives no pairs.  All sums are exact.
    """
    counts = term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col).repartition("lang", "term")
    counts = cut(counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counts.where("term is null").select("lang", "source")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("whole_n"), F.sum("docs").alias("docs"))
    terms = cut(terms.where(F.col("docs") >= least_docs).drop("docs"))
    cells = cut(counts.where("term is not null").drop("docs").join(terms, ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole_n").alias("whole_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    seats = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    seats = seats.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole_total", F.lit(0)).alias("whole_total"))
    seats = seats.withColumn("seat", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    seats = seats.withColumn("block", F.expr(f"seat div {block_seats}")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    seats = seats.withColumn("shards", F.ceil(F.col("kept") / shard_terms))
    seats = cut(seats.withColumn("none", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))))

    own = cells.join(seats, ["lang", "source"])
    own = own.select(
        "lang", "seat", "block", "blocks", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "term",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("share"), share(F.col("whole_n"), F.col("whole_total"), F.col("kept")).alias("whole"),
    )
    nulls = [F.lit(None).cast("string").alias("term"), F.col("none").alias("share"), F.lit(None).cast("long").alias("whole")]
    marks = seats.where("kept > 0").select("lang", "seat", "block", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), *nulls)
    # A block plays at home with itself and meets each other block once.
    dealt = own.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "seat", "block", "term", "share", "whole")
    found = cut(dealt.groupBy("lang", "shard", "low", "high").applyInArrow(_tournament(top), "lang string, seat bigint, peer bigint, term string, value bigint"))

    told = found.where("peer is not null").groupBy("lang", "seat", "peer").agg(F.sum("value").alias("told"))
    told = told.unionByName(told.select("lang", F.col("peer").alias("seat"), F.col("seat").alias("peer"), "told"))
    one = seats.select("lang", "seat", "source", "kept", F.col("none").alias("p"))
    other = seats.select("lang", F.col("seat").alias("peer"), F.col("source").alias("item"), F.col("none").alias("q"))
    flat = F.expr("((p - q) * (p - q)) div (p + q)") * F.col("kept")
    met = told.join(one, ["lang", "seat"]).join(other, ["lang", "peer"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("told") + flat).alias("value"))
    # Languages without kept terms have no meetings: their sources differ by nothing.
    same = one.where("kept = 0").join(other, "lang").where("seat <> peer").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    best = found.where("term is not null").join(one, ["lang", "seat"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs, best = met.unionByName(same).withColumn("rank", rank), best.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(best)

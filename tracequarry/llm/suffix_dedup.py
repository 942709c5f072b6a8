"""Suffix-array dedup: find every byte covered by a string of fixed length that also starts anywhere else.

A full suffix array of a large corpus would have to be moved as a whole.  So the candidates are found first:
in each window of ``length`` bytes the ``GRAM``-byte string of smallest hash is an anchor, and equal windows
have equal anchors at the same place.  Anchors are dealt out once, with places and hashes but no text.  What surrounds an
anchor (all its windows) is told by a hash of 64 bits, which is trusted: where it occurs twice, all is repeated.  Of the others
those go further that share the anchor with one half of its windows' common bytes; only their surroundings are read, into shards.
Each shard gets sparse suffix arrays (Larsson-Sadakane doubling over the anchors' suffixes, of rows not yet told apart
only) and the common prefixes of neighbours, and the shards of one very frequent anchor are merged pair by pair by binary search.
Nothing is sampled: every window has an anchor, and every anchor that occurs twice is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, release, text_slices

LENGTH, GRAM = 200, 32
#: Contexts that a bucket holds; an anchor with more than the second number is dealt over several shards.
BUCKET_CONTEXTS, SHARD_CONTEXTS = 4096, 8192
#: Anchors found so often (the most frequent, so many at most) are pre-aggregated instead of gathered.
HOT, HOT_ANCHORS = 1000, 200_000
#: Documents whose text is wanted are broadcast as two numbers each while there are no more.
BROADCAST_DOCS = 500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


# -- anchors ------------------------------------------------------------------------------------------------
def eights(raw: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), order, buffer=padded, strides=(1,)).astype(np.uint64)


def sliding(values: np.ndarray, width: int, op: np.ufunc, fill) -> np.ndarray:
    """``op`` over each run of ``width`` values, by running values within blocks from either side."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, fill, values.dtype)]).reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - width + 1], ahead[width - 1 : n])


def find_anchors(offsets: np.ndarray, raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in raw, hash) of the anchors of all windows that lie within one text."""
    n, width = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    v = eights(raw)
    grams = n - GRAM + 1
    g = v[:grams] * _MIX[0]
    for k in range(1, GRAM // 8):
        g += v[8 * k : 8 * k + grams] * _MIX[k]
    g ^= g >> np.uint64(29)
    g *= _MIX[4]
    g ^= g >> np.uint64(32)
    g = np.maximum(g, np.uint64(1))  # 0 stands for no window
    low = sliding(g, width, np.minimum, np.uint64(2**64 - 1))
    ends = np.zeros(len(low) + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - length + 1
    fit = last > first
    np.add.at(ends, first[fit], 1)
    np.add.at(ends, last[fit], -1)
    low[np.cumsum(ends[:-1]) == 0] = 0
    pad = np.zeros(width - 1, np.uint64)
    reach = sliding(np.concatenate([pad, low, pad]), width, np.maximum, np.uint64(0))
    place = np.flatnonzero((reach == g) & (g > 0))
    row = np.searchsorted(offsets, place, side="right") - 1
    return row, place, g[place].view(np.int64)


_TABLE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)


class Spans:
    """Hashes of 32 bits of any strings of ``raw``, from prefix sums of a polynomial."""

    def __init__(self, raw: np.ndarray):
        self.back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(raw), pow(int(_MIX[0]), -1, 1 << 64), np.uint64)]))
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(raw), _MIX[0])]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[raw] * powers[:-1])])

    def hashes(self, begin: np.ndarray, end: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Of raw[begin:end]; 0 where not ``valid``, else not 0."""
        out = np.zeros(len(begin), np.int32)
        a, b = begin[valid], end[valid]
        h = (self.sums[b] - self.sums[a]) * self.back[a]
        h ^= h >> np.uint64(29)
        out[valid] = ((h * _MIX[4]) >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
        return out


# -- suffix arrays ------------------------------------------------------------------------------------------
def suffix_order(words: np.ndarray) -> np.ndarray:
    """Rows of a matrix of words in lexicographic order, by Larsson-Sadakane doubling.

    Places of a row are ranked by one word, then by two, four and so on: the rank of twice as many words is that of
    the pair of ranks of both halves.  Only every second place is needed in each round, and only rows that still
    share their rank with another: those form groups whose place in the order is known, and are refined within them.
    """
    n = len(words)
    place, rows = np.zeros(n, np.int64), np.arange(n)  # of each row how many come before its group
    rank = np.unique(words, return_inverse=True)[1].reshape(words.shape) + 1 if words.size else words.astype(np.int64)
    while n and rank.shape[1]:
        group, inner, size = np.unique(place[rows] * (int(rank.max(initial=0)) + 1) + rank[:, 0], return_inverse=True, return_counts=True)
        old = np.searchsorted(np.sort(place[rows]), place[rows])  # rows of earlier groups that are still here
        place[rows] += (np.cumsum(size) - size)[inner] - old
        if rank.shape[1] == 1:
            break
        open_ = size[inner] > 1
        rows, rank = rows[open_], rank[open_]
        if not len(rows):
            break
        if rank.shape[1] % 2:
            rank = np.concatenate([rank, np.zeros((len(rank), 1), rank.dtype)], axis=1)
        pair = rank[:, ::2] * (int(rank.max(initial=0)) + 1) + rank[:, 1::2]
        rank = np.unique(pair, return_inverse=True)[1].reshape(pair.shape) + 1
    return np.argsort(place, kind="stable")


def merge_orders(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One order of the rows in two sorted lists of rows: each row of the first is put in place by binary search."""
    if not len(first) or not len(second):
        return np.concatenate([first, second])
    keys = np.ascontiguousarray(words.astype(">u8")).view(f"S{words.shape[1] * 8}").ravel()
    at = np.searchsorted(keys[second], keys[first], side="right") + np.arange(len(first))
    out = np.empty(len(first) + len(second), np.int64)
    mine = np.zeros(len(out), bool)
    mine[at] = True
    out[at], out[~mine] = first, second
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in ``order`` shares with the row before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    diff = words[order[1:]] ^ words[order[:-1]]
    at = (diff != 0).argmax(axis=1)
    word = diff[np.arange(len(diff)), at]
    zeros = np.zeros(len(word), np.int64)
    for k in range(1, 8):
        zeros += word < (np.uint64(1) << np.uint64(64 - 8 * k))
    out[1:] = np.where(word == 0, words.shape[1] * 8, at * 8 + zeros)
    return out


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


class Shard:
    """Contexts of anchors with the suffix arrays of what follows each anchor's start and, read backwards, of what precedes it.

    A window is ``o`` bytes before the anchor and ``length - o`` from it on.  Two windows are equal when the anchors'
    rows stand in one class of both arrays, cut where neighbours share less than that.  ``halves`` tells
    which of two blocks a context is from; their arrays are built apart and merged by binary search.
    """

    def __init__(self, contexts: list[bytes], lefts: np.ndarray, halves: np.ndarray, length: int):
        self.length, self.left = length, lefts
        self.right = np.array([len(c) for c in contexts], np.int64) - lefts
        width = -(-length // 8) * 8
        self.sides = []
        for side in ([c[n:] for c, n in zip(contexts, lefts.tolist())], [c[:n][::-1] for c, n in zip(contexts, lefts.tolist())]):
            words = _matrix(side, width)
            orders = [np.flatnonzero(halves == h) for h in (0, 1)]
            orders = [rows[suffix_order(words[rows])] for rows in orders]
            order = merge_orders(words, *orders)
            self.sides.append((order, common_prefixes(words, order)))

    def _classes(self, side: int, depth: int) -> np.ndarray:
        order, shared = self.sides[side]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < depth)
        return out

    def extents(self) -> tuple[np.ndarray, np.ndarray]:
        """Per context the smallest and largest ``o`` whose window occurs at another anchor (-1: none)."""
        n = len(self.left)
        least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for o in range(self.length - GRAM + 1):
            fit = np.flatnonzero((self.left >= o) & (self.right >= self.length - o))
            if len(fit) < 2:
                continue
            key = self._classes(0, self.length - o)[fit] * (n + 1) + self._classes(1, o)[fit]
            order = np.argsort(key)
            key = key[order]
            same = np.r_[False, key[1:] == key[:-1]]
            hit = fit[order[same | np.r_[same[1:], False]]]
            most[hit] = o
            least[hit[least[hit] < 0]] = o
        return least, most


def _compare(length: int):
    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["context"].notna()]
        shard = Shard(list(rows["context"]), np.minimum(rows["place"].to_numpy(np.int64), length - GRAM), rows["half"].to_numpy(), length)
        least, most = shard.extents()
        place = rows["place"].to_numpy(np.int64)
        release()
        return rows[["_digest", "_who"]].assign(a=place - most, b=place - least + length)[(most >= 0) & rows["alone"].to_numpy()]

    return compared


# -- the operator -------------------------------------------------------------------------------------------
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_digest, _who, _text): a text and the row it is of, as two numbers of 64 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("_digest"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("_who"), F.col(text_col).alias("_text"))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(anchor, around, hl, hr, _digest, _who, place): hashes of all windows' bytes and of the bytes that windows of either half share."""
    side, half = length - GRAM, (length - GRAM) // 2

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, raw in text_slices(batch.column(2), 1 << 19):
                row, place, anchor = find_anchors(offsets, raw, length)
                if not len(row):
                    continue
                data, spans = raw.tobytes(), Spans(raw)
                begin, end = offsets[row], offsets[row + 1]
                left, right = np.maximum(begin, place - side), np.minimum(end, place + GRAM + side)
                hashed = hashlib.blake2b
                around = b"".join(hashed(data[a:b], digest_size=8, salt=c.to_bytes(2, "little")).digest() for a, b, c in zip(left.tolist(), right.tolist(), (place - left).tolist()))
                hl = spans.hashes(place - half, place + GRAM, place - half >= begin)
                hr = spans.hashes(place, place + length - half, place + length - half <= end)
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.frombuffer(around, np.int64)), pa.array(hl), pa.array(hr), batch.column(0).take(at), batch.column(1).take(at), pa.array((place - begin).astype(np.int32))],
                    names=["anchor", "around", "hl", "hr", "_digest", "_who", "place"],
                )
            release()

    return keyed.mapInArrow(found, "anchor bigint, around bigint, hl int, hr int, _digest bigint, _who bigint, place int")


_SHARED = "((hl <> 0 and nl > n) or (hr <> 0 and nr > n))"


def _judged(anchors: DataFrame) -> DataFrame:
    """(anchor, _digest, _who, place, whole, asked, kinds): rows whose surroundings occur twice (``whole``), and rows of which one
    half occurs at other surroundings (``asked``, one row of equal ones)."""
    counts = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS)
    hot = cut(counts.select("anchor"))
    over = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    cold = anchors.join(F.broadcast(hot), "anchor", "left_anti").withColumn("rows", over("anchor")).where("rows > 1")
    cold = cold.select("*", over("anchor", "around").alias("n"), over("anchor", "hl").alias("nl"), over("anchor", "hr").alias("nr"), F.row_number().over(Window.partitionBy("anchor", "around").orderBy("_digest", "_who", "place")).alias("k"))
    cold = cold.select("anchor", "_digest", "_who", "place", F.expr("n > 1").alias("whole"), F.expr(f"k = 1 and {_SHARED}").alias("asked"), F.col("rows").alias("kinds"))
    often = anchors.join(F.broadcast(hot), "anchor")
    classes = often.groupBy("anchor", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_digest", "_who", "place")).alias("one"), F.first("hl").alias("hl"), F.first("hr").alias("hr"))
    classes = cut(classes)
    if classes.isEmpty():
        return cold.where("whole or asked")
    total = lambda side, name: classes.groupBy("anchor", side).agg(F.sum("n").alias(name))
    kinds = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    asked = classes.join(total("hl", "nl"), ["anchor", "hl"]).join(total("hr", "nr"), ["anchor", "hr"]).where(_SHARED).join(F.broadcast(kinds), "anchor")
    several = often.join(classes.where("n > 1").select("anchor", "around"), ["anchor", "around"])
    no, yes = F.lit(False), F.lit(True)
    whole = several.select("anchor", "_digest", "_who", "place", yes.alias("whole"), no.alias("asked"), F.lit(0).cast("long").alias("kinds"))
    asked = asked.select("anchor", "one.*", F.expr("n > 1").alias("whole"), yes.alias("asked"), "kinds")
    return cold.where("whole or asked").unionByName(whole).unionByName(asked)


def _contexts(keyed: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The rows ``asked`` with ``context``, the bytes of all windows of the anchor; only texts that are asked for are moved."""
    side = length - GRAM
    lists = cut(asked.groupBy("_digest", "_who").agg(F.collect_list(F.struct("anchor", "place", "alone", "kinds")).alias("_asked")))
    wanted = lists.select("_digest", "_who")
    few = wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = keyed.join(F.broadcast(wanted), ["_digest", "_who"], "left_semi") if few else keyed
    joined = lists.join(texts, ["_digest", "_who"]).dropDuplicates(["_digest", "_who"]).select("_digest", "_who", "_text", "_asked")
    names = ["_digest", "_who", "anchor", "place", "alone", "kinds", "context"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                digest, who, text, asked = (batch.column(k)[i].as_py() for k in range(4))
                data = (text or "").encode()
                for x in asked:
                    at = x["place"]
                    rows.append((digest, who, x["anchor"], at, x["alone"], x["kinds"], data[max(0, at - side) : at + GRAM + side]))
                    if len(rows) >= 4096:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return joined.mapInArrow(read, "_digest bigint, _who bigint, anchor bigint, place int, alone boolean, kinds bigint, context binary")


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_digest, _who, spans): for texts with repeats, the merged byte ranges that strings occurring elsewhere cover."""
    keyed = _keyed(docs, id_col, text_col)
    anchors = cut(_anchor_rows(keyed, length))
    judged = cut(_judged(anchors))
    drop_cut(anchors)
    asked = judged.where("asked").select("_digest", "_who", "anchor", "place", (~F.col("whole")).alias("alone"), "kinds")
    contexts = _contexts(keyed, asked, length)
    # An anchor with many contexts is dealt into blocks; every two blocks meet in one bucket, so no pair is missed.
    n_buckets = max(1, asked.count() // BUCKET_CONTEXTS)
    blocks = F.when(F.col("kinds") <= SHARD_CONTEXTS, 1).otherwise(F.ceil(F.col("kinds") / SHARD_CONTEXTS)).cast("int")
    dealt = contexts.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("_digest", "_who", "place"), blocks).cast("int").alias("own"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    b0 = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("anchor"), F.lit(n_buckets))).otherwise(F.xxhash64("anchor"))
    dealt = dealt.select("_digest", "_who", "place", "alone", "context", b0.alias("b0"), F.when(F.col("blocks") > 1, F.least("own", "other")).otherwise(-1).alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).cast("int").alias("half"))
    found = dealt.groupBy("b0", "b1", "b2").applyInPandas(_compare(length), "_digest bigint, _who bigint, a int, b int")
    side = length - GRAM
    whole = judged.where("whole").select("_digest", "_who", F.greatest(F.col("place") - side, F.lit(0)).alias("a"), (F.col("place") + length).alias("b"))
    spans = found.union(whole).groupBy("_digest", "_who").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[{"a": a, "b": b} for a, b in merge_spans(x)] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["_digest", "_who", "spans"])

    return cut(spans.mapInArrow(merged, "_digest bigint, _who bigint, spans array<struct<a int, b int>>"))


def merge_spans(spans, size: int = 2**31 - 1) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], min(s["b"], size)) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept_parts(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """All columns, and the spans of the row as the last one."""
    spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    digest, who, name = fresh(docs, "digest", "who", "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select("*", F.xxhash64(text).alias(digest), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias(who))
    return full.join(spans.toDF(digest, who, name), [digest, who], "left").select(*docs.columns, name)


def removal_digest(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    A byte goes if a string of ``length`` bytes that covers it also starts at another place of any text.
    Null text counts as empty; texts shorter than ``length`` keep all bytes; repeated rows (even of one id)
    count as other places, so all of them lose what they share; other columns are not read.
    """
    joined = _with_spans(docs.select(id_col, text_col), length, id_col, text_col)
    kind = joined.schema[id_col].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, sha = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                merged = merge_spans(spans, len(data))
                n.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                count.append(len(merged))
                sha.append(hashlib.sha256(_kept_parts(data, merged)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digested, f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with the repeated bytes taken out of their texts (letters cut in half go too); all columns stay.

    Null texts stay null.  ``chars_col``, where the table has it, is counted anew.
    """
    joined = _with_spans(docs, length, id_col, text_col)
    at, names = joined.columns.index(text_col), docs.columns

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text is not None and spans:
                    data = text.encode()
                    text = _kept_parts(data, merge_spans(spans, len(data))).decode("utf-8", errors="ignore")
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(rewritten, docs.schema)
    if chars_col in names:
        out = out.withColumn(chars_col, F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema[chars_col].dataType))
    return out

"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, shard bytes come out near equal."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Groups in a bucket (or buckets in a larger one) that one task differences, the most buckets that the driver combines, rows of a slot cell.
GROUPS_A_BUCKET, MOST_BUCKETS, ROWS_A_CELL = 512, 4096, 256
#: Parts that the buckets are cut into, all together, where that is more than one for each shard and bucket.
PARTS = 4096


def difference(parts: list[tuple[list[int], list[list]]], k: int) -> list[list]:
    """Combine partial partitions into one of ``k`` lists of members.

    A partial partition is (k sums, k member lists).  The two of largest spread are combined again and
    again, the largest sum of one with the smallest of the other.  Ties go by order of arrival.
    """
    if not parts:
        return [[] for _ in range(k)]
    heap = []
    for n, (sums, members) in enumerate(parts):
        order = sorted(range(k), key=sums.__getitem__)
        s = [sums[i] for i in order]
        heap.append((s[0] - s[-1], n, s, [members[i] for i in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s, a = heapq.heappop(heap)
        _, _, t, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(s, reversed(t))]
        lists = []
        for x, y in zip(a, reversed(b)):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            lists.append(x)
        order = sorted(range(k), key=sums.__getitem__)
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[0] - sums[-1], n, sums, [lists[i] for i in order]))
        n += 1
    return heap[0][3]


def _single(size: int, member, k: int) -> tuple[list[int], list[list]]:
    return [0] * (k - 1) + [size], [[] for _ in range(k - 1)] + [[member]]


def _bucket_labels(k: int):
    """Differences a bucket's groups into ``k`` parts; where there are no more groups than that, each is a part."""

    def labelled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group"], ascending=[False, True]).reset_index(drop=True)
        local = list(range(len(rows)))
        if len(rows) > k:
            for label, members in enumerate(difference([_single(int(b), i, k) for i, b in enumerate(rows["bytes"])], k)):
                for i in members:
                    local[i] = label
        return rows.assign(local=local)[["group", "bucket", "bytes", "rows", "local"]]

    return labelled


def _bucket_places(k: int):
    """Differences the partial partitions of the buckets of a larger one: where each bucket's parts go."""

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "local"]).reset_index(drop=True)
        parts = []
        for _, own in rows.groupby("bucket", sort=True):
            sums, members = [0] * k, [[] for _ in range(k)]
            for i, local, size in zip(own.index, own["local"], own["bytes"]):
                sums[local], members[local] = int(size), [i]
            parts.append((sums, members))
        place = [0] * len(rows)
        for label, members in enumerate(difference(parts, k)):
            for i in members:
                place[i] = label
        return rows.assign(place=place)[["bucket", "local", "bytes", "rows", "up", "place"]]

    return placed


def shard_groups(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row; law ``bytes``: shard sizes near equal.

    Size is the UTF-8 length plus 1.  Null text counts as empty and belongs to the group of empty texts.
    Rows of equal texts are one indivisible group, so one huge group bounds how even the shards can be;
    it only raises its own shard.  Repeated rows and rows with equal or null ids are rows of their own, with slots of their own; an empty table gives an
    empty result.  Other columns are not read.

    Groups are dealt into buckets of a bounded number by hash, and each bucket is differenced in one task into parts.  While there are more buckets than
    ``MOST_BUCKETS``, theirs are differenced into those of larger buckets, level by level.  The driver differences what is left: the parts (some
    ten thousand numbers, whatever the input) and the groups too large for a bucket (fewer than shards x ``MOST_BUCKETS``).
    Slots are running numbers within (shard, cell) plus the cell's start.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = cut(docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest")))
    key = F.concat(F.col("digest"), F.encode(F.col("size").cast("string"), "UTF-8"))
    digest = digest.withColumn("group", key).drop("digest")
    groups = digest.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = cut(groups)
    n_groups, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, math.ceil(n_groups / GROUPS_A_BUCKET))
    bar = max(1, total // (shards * min(buckets, MOST_BUCKETS)))
    large = groups.where(F.col("bytes") > bar).orderBy(F.desc("bytes"), "group").collect()  # fewer than shards x MOST_BUCKETS
    parts = max(shards, min(GROUPS_A_BUCKET, PARTS // buckets))
    dealt = groups.where(F.col("bytes") <= bar).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    local = cut(dealt.groupBy("bucket").applyInPandas(_bucket_labels(parts), "group binary, bucket bigint, bytes bigint, rows bigint, local int"))
    part = local.groupBy("bucket", "local").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    of_group = local.select("group", "bucket", "local")
    while buckets > MOST_BUCKETS:
        buckets = max(MOST_BUCKETS, math.ceil(buckets / GROUPS_A_BUCKET))
        up = part.withColumn("up", F.pmod("bucket", F.lit(buckets)))
        moved = cut(up.groupBy("up").applyInPandas(_bucket_places(shards), "bucket bigint, local int, bytes bigint, rows bigint, up bigint, place int"))
        of_group = of_group.join(moved.select("bucket", "local", "up", "place"), ["bucket", "local"]).select("group", F.col("up").alias("bucket"), F.col("place").alias("local"))
        part = moved.groupBy(F.col("up").alias("bucket"), F.col("place").alias("local")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    sums = sorted(part.collect(), key=lambda r: (-r["bytes"], r["bucket"], r["local"]))
    found = difference([_single(r["bytes"], r, shards) for r in (*large, *sums)], shards)
    rows_in = [sum(r["rows"] for r in own) for own in found]
    spark = docs.sparkSession
    lookup = spark.createDataFrame([(r["bucket"], r["local"], s) for s, own in enumerate(found) for r in own if "bucket" in r], "bucket long, local int, shard int")
    of_group = of_group.join(F.broadcast(lookup), ["bucket", "local"]).select("group", "shard")
    put_large = spark.createDataFrame([(bytearray(r["group"]), s) for s, own in enumerate(found) for r in own if "group" in r], "group binary, shard int")
    cells = F.array(*[F.lit(max(1, math.ceil(n / ROWS_A_CELL))) for n in rows_in])
    put = digest.join(of_group.union(put_large), "group").drop("group")
    put = cut(put.withColumn("cell", F.pmod(F.xxhash64(id_col, "text_crc32"), F.element_at(cells, F.col("shard") + 1)).cast("int")))
    counts = put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = put.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(id_col, "text_crc32", "size")))
    return placed.join(starts, ["shard", "cell"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

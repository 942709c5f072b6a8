"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: the space is cut into two halves, each half has a random
codebook, and every pair of code words is a direction.  Each vector is list-decoded to all directions whose cap it
exceeds (sorted half products make that a short list), vectors are joined on filters, and pairs are verified in
double precision.  A vector's cap height is that of its ``CAPS``-th best direction, so every vector has as many caps
whatever the size of the table.  Codebooks are as large as drawn pairs at the threshold allow: see ``words_for``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

THRESHOLD = 0.98
#: Caps of a vector; directions wanted per vector of the largest label, and bounds of a half's codebook.
CAPS, DIRECTIONS, LEAST_WORDS, MOST_WORDS = 30, 8, 48, 8192
#: Pairs drawn at the threshold for a codebook, and how many of them may have no common cap.
PAIRS, MISSED = 4096, 1
#: Vectors of one filter that one task compares at once; rows of small filters that one task takes.
BLOCK, ROWS_A_TASK = 512, 2048


def codebooks(dim: int, words: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two random half codebooks in rotated coordinates: (dim x words) each, so a product is one multiplication.

    The rotation is random, so the chance of a common cap depends on the cosine of a pair only, not on its coordinates.
    """
    rng = np.random.default_rng([seed, dim, words])
    turn, begin, halves = np.linalg.qr(rng.standard_normal((dim, dim)))[0], 0, []
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((words, size))
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        halves.append(turn[:, begin : begin + size] @ (c / np.where(norm > 0, norm, 1)).T)
        begin += size
    return halves[0], halves[1]


def _best(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` largest numbers of each row, largest first."""
    at = np.argpartition(-x, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(x, at, axis=1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(value, order, axis=1)


def decode(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray], caps: int) -> np.ndarray:
    """For each unit vector the sorted numbers of its ``caps`` best directions (all, if there are fewer).

    The direction of the i-th best word of one half and the j-th best of the other has i * j - 1 better ones at least.
    """
    words = books[0].shape[1]
    most = min(words, caps)
    (at_a, a), (at_b, b) = _best(unit @ books[0], most), _best(unit @ books[1], most)
    i, j = np.array([(i, j) for i in range(most) for j in range(most) if (i + 1) * (j + 1) <= caps]).T
    top, _ = _best(a[:, i] + b[:, j], min(caps, len(i)))
    return np.sort(np.take_along_axis(at_a, i[top], axis=1).astype(np.int64) * words + np.take_along_axis(at_b, j[top], axis=1), axis=1)


def missed(dim: int, words: int, cosine: float, pairs: int = PAIRS, caps: int = CAPS) -> int:
    """How many of ``pairs`` random pairs at ``cosine`` have no cap in common."""
    rng, books, out = np.random.default_rng([5, dim, words]), codebooks(dim, words), 0
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, pairs, 256):
        u = norm(rng.standard_normal((min(256, pairs - k), dim)))
        w = rng.standard_normal(u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * norm(w) if dim > 1 else u
        out += int((~(decode(u, books, caps)[:, :, None] == decode(v, books, caps)[:, None, :]).any(axis=(1, 2))).sum())
    return out


def words_for(dim: int, largest: int, threshold: float) -> int:
    """Words of a half for labels of up to ``largest`` vectors: as many as keep the chance of a common cap at ``threshold``."""
    words = min(MOST_WORDS, max(LEAST_WORDS, math.ceil(math.sqrt(DIRECTIONS * largest))))
    while words * words > CAPS and missed(dim, words, threshold) > MISSED:
        words = words * 3 // 4
    return words


def _clean(vec_col: str):
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v, fine


def _filter_rows(classes: DataFrame, words: dict[int, int]) -> DataFrame:
    """(label, dim, filter, node, copies, vector, filters): a row for each cap of each class; ``words`` of each dimension."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[int, tuple] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256).to_pandas()
                rows["dim"] = rows["vector"].map(len)
                for dim, own in rows.groupby("dim"):
                    if dim not in books:
                        books[dim] = codebooks(dim, words[dim])
                    x = np.stack(own["vector"].to_list())
                    unit = x / np.abs(x).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    lists = list(decode(unit, books[dim], CAPS))
                    own = own.assign(filters=lists, filter=lists, vector=list(unit)).explode("filter")
                    yield pa.RecordBatch.from_pandas(own[["label", "dim", "filter", "node", "copies", "vector", "filters"]].astype({"dim": "int32", "filter": "int64"}), schema=schema, preserve_index=False)

    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("filter", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())), ("filters", pa.list_(pa.int64()))])
    return classes.mapInArrow(decoded, "label string, dim int, filter bigint, node bigint, copies bigint, vector array<double>, filters array<bigint>")


def _first_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair of sorted lists their smallest common number."""
    width = max(map(len, a)), max(map(len, b))
    pad = lambda rows, w, fill: np.array([np.concatenate([r, np.full(w - len(r), fill)]) for r in rows])
    x, y = pad(a, width[0], -1), pad(b, width[1], -2)
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 2048):
        both = (x[k : k + 2048, :, None] == y[k : k + 2048, None, :]).any(axis=2)
        out[k : k + 2048] = np.where(both, x[k : k + 2048], np.iinfo(np.int64).max).min(axis=1)
    return out


def _verify(threshold: float):
    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within the filters of one bucket.  A pair counts at its first common filter only."""
        rows = rows.sort_values(["label", "dim", "filter"], kind="stable").reset_index(drop=True)
        key = rows[["label", "dim", "filter"]]
        edge = np.flatnonzero(np.r_[True, (key.values[1:] != key.values[:-1]).any(axis=1), True]) if len(rows) else np.zeros(1, int)
        out = []
        for begin, end in zip(edge[:-1], edge[1:]):
            if end - begin < 2:
                continue
            x = np.stack(rows["vector"].iloc[begin:end].to_list())
            near = x @ x.T >= threshold
            half = rows["half"].to_numpy()[begin:end]
            if rows["cross"].iloc[begin]:
                near &= half[:, None] != half[None, :]
            i, j = np.nonzero(np.triu(near, 1))
            if not len(i):
                continue
            node, copies = rows["node"].to_numpy()[begin:end], rows["copies"].to_numpy()[begin:end]
            lists, number = rows["filters"].iloc[begin:end].to_list(), rows["filter"].iloc[begin]
            counts = _first_common([lists[k] for k in i], [lists[k] for k in j]) == number
            links = np.zeros(end - begin, np.int64)
            np.add.at(links, i[counts], copies[j[counts]])
            np.add.at(links, j[counts], copies[i[counts]])
            root = node.copy()  # smallest class reachable within this bucket
            while True:
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                if (low == root).all():
                    break
                root = low
            out.append(pd.DataFrame({"node": node, "links": links, "root": root})[(links > 0) | (root != node)])
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")

    return verified


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two rows link when their labels are equal and not null and their cosine in double precision is at least
    ``threshold``; the search is by filters, so a link may be missed (measured recall: see the tests), none is
    added.  Null, zero, empty and non-finite vectors link with nothing; vectors of different sizes do not link.  Equal vectors
    of one label are one class, so copies cost one row; classes have numbers of their own.  Ids are of any type with an order; repeated ids count as
    other vectors.  A null id is never a component's id: a component's id is null only if all its rows' ids are, and a row without an id is not kept.
    Other columns are not read.
    Filters with many vectors are dealt into blocks of which every two meet.
    """
    v, fine = _clean(vec_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.col(label_col).cast("string")).alias("label"), v.alias("vector"), F.xxhash64(vec_col).alias("k1"), F.xxhash64(F.lit(1), vec_col).alias("k2"))
    classes = rows.where("label is not null").groupBy("label", "k1", "k2").agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    sized = classes.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    words = {r["dim"]: words_for(r["dim"], r["n"], threshold) if r["n"] > 1 else 1 for r in sized}
    caps = cut(_filter_rows(classes.select("label", "node", "copies", "vector"), words))
    sizes = caps.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = caps.join(sizes, ["label", "dim", "filter"])
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, total // ROWS_A_TASK)
    plain = shared.where(F.col("n") <= BLOCK).select("*", F.pmod(F.xxhash64("label", "dim", "filter"), F.lit(tasks)).alias("b0"), F.lit(-1).alias("b1"), F.lit(-1).alias("b2"), F.lit(0).alias("half"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = shared.where(F.col("n") > BLOCK).select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    hot = dealt.select(*shared.columns, F.xxhash64("label", "dim", "filter").alias("b0"), F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).cast("int").alias("half"))
    buckets = plain.union(hot).drop("n").withColumn("cross", F.col("b1") != F.col("b2"))
    found = cut(buckets.groupBy("b0", "b1", "b2").applyInPandas(_verify(threshold), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    members = classes.select("label", "k1", "k2", "node", "one", "copies").join(links, "node", "left").join(reached, "node", "left")
    smallest = members.where("component is not null").groupBy("component").agg(F.min("one").alias("least"))
    named = members.join(smallest, "component", "left")
    named = named.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("one")).otherwise(F.col("least")).alias("component_id"))
    out = rows.drop("vector").join(named, ["label", "k1", "k2"], "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

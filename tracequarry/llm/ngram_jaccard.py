"""N-gram Jaccard components: an exact metric-space join by pivots, Voronoi regions and triangle-inequality windows.

In a corpus nearly all pairs of texts are at Jaccard distance exactly 1, where no pivot tells them apart.  So the first
regions are drawn around what can be near at all: two texts within the threshold share a shingle among the first few of
each in a common order (rarest first); texts that share such a shingle belong to the region of the first of them, one
for each band of sizes (a set also visits the bands that its smaller partners may be of).

Inside a region the metric is that of sketches.  A sketch is a histogram of a set's shingles over their leading bits;
the weighted Jaccard distance of two histograms of equal resolution is a metric, and it never exceeds the Jaccard
distance of the sets.  A region beyond ``LEAF`` members (or ``WEIGHT`` shingles) is split again: some members are
pivots, each member is at home in the region of its nearest pivot (Voronoi), and it is replicated into every region
whose pivot is no more than two thresholds farther than its own (triangle inequality), so the home of either end of a near pair
holds the other end.  Regions are split recursively.  A region that does not shrink, as windows of a dense group hold everybody, is
dealt into blocks of which every two meet.

In a leaf the sketches leave a few pairs open.  The texts of each group tied by open pairs are fetched, all
intersections within the group are counted exactly, and only a spanning forest of the links leaves the task.  No pair within the
threshold is missed.  Components come out, not all links or their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, release, text_slices
from .graph import connected_components

WORDS, PERCENT = 4, 85
#: Members and shingles that one task compares at once.
LEAF, WEIGHT = 2048, 4_000_000
#: Pivots of a split region at most, levels of splitting, and the share of pairs that a split has to save.
PIVOTS, LEVELS, SAVED = 16, 6, 0.25
#: Bytes of text that are hashed at once (a longer text alone).
PASS = 1 << 19
#: Hashes that frequent shingles are counted over at a time.
COUNTED = 1_000_000
#: Shingles that a place of a text's sketch holds on average, at most, and the least places (powers of two).
DENSITY, PLACES = 4, 16
#: Frequent shingles that are ordered last, and how often one has been counted whose cells are pre-aggregated instead of gathered.
HOT_SHINGLES, HOT_CELL = 200_000, 256
#: Rows of a cell whose pairs are tested by sizes at once.
SMALL_CELL = 16
#: Up to so many classes whose texts are wanted are broadcast to the corpus (three numbers each); beyond that both sides are joined.
BROADCAST_CLASSES = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, words: int = WORDS, seed: int = 0) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles (the whole sequence if it is shorter)."""
    n_rows = len(offsets) - 1
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    head = ~blank
    head[1:] &= blank[:-1]
    edge = offsets[:-1][(offsets[:-1] < len(raw))]
    head[edge] = ~blank[edge]
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return [np.zeros(0, np.uint64)] * n_rows
    starts = np.flatnonzero(head)
    first = np.flatnonzero(head[solid])
    within = solid - np.repeat(starts, np.diff(np.r_[first, len(solid)]))
    powers = np.multiply.accumulate(np.full(int(within.max()) + 1, _A | np.uint64(1)))
    word = _mix(np.add.reduceat((low[solid].astype(np.uint64) + np.uint64(1 + seed)) * powers[within], first) + np.uint64(seed))
    row = np.searchsorted(offsets, starts, side="right") - 1
    number = np.bincount(row, minlength=n_rows)
    begin = np.cumsum(number) - number
    full = len(word) - words + 1
    if full > 0:
        h = word[:full].copy()
        for k in range(1, words):
            h = h * _A + word[k : k + full]
        h = _mix(h)
    out = []
    for i in range(n_rows):
        c, b = int(number[i]), int(begin[i])
        if c >= words:
            out.append(np.unique(h[b : b + c - words + 1]))
        elif c:
            x = np.array([c], np.uint64)
            for w in word[b : b + c]:
                x = _mix(x * _A + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_of(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def sketch(u: np.ndarray) -> bytes:
    """Histogram of a set over its leading bits; empty if a place holds too many to be told, which bounds nothing."""
    bits = PLACES.bit_length() - 1
    while (DENSITY << bits) < len(u):
        bits += 1
    counts = np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of numbers at the coarsest resolution among them; without places if one is unknown."""
    places = min(map(len, sketches))
    if not places:
        return np.zeros((len(sketches), 0), np.int32)
    return np.stack([np.frombuffer(x, np.uint8).reshape(places, -1).sum(axis=1, dtype=np.int32) for x in sketches])


def apart(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Lower bounds of the symmetric difference of sets of sizes ``na`` and ``nb`` with sketches ``a`` and ``b``."""
    return np.maximum(np.abs(a - b).sum(axis=-1, dtype=np.int64), np.abs(na - nb))


def _sets(batch: pa.RecordBatch, column: int, words: int, seed: int):
    for first, offsets, raw in text_slices(batch.column(column), PASS):
        yield first, shingle_sets(offsets, raw, words, seed)


def _measure(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """Rows of texts (id, digest, n, class, check, sketch) and, with null ``n``, counts of shingles frequent within a batch."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sketches, seen, distinct = [], [], [], set(), []
            for _, sets in _sets(batch, 2, words, seed):
                for u in sets:
                    sizes.append(len(u))
                    keys.append(_class_of(u))
                    new = keys[-1] not in seen and len(u) > 0
                    sketches.append(sketch(u) if new else None)
                    if new:
                        seen.add(keys[-1])
                        distinct.append(u)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sketches, pa.binary())], names=names)
            yield from frequent(distinct, batch.schema.field(0).type)
            del distinct
            release()

    def frequent(distinct: list[np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Shingles that several of about COUNTED hashes' texts hold; runs keep memory small."""
        run: list[np.ndarray] = []
        total = 0
        for k, u in enumerate(distinct):
            run.append(u)
            total += len(u)
            if total < COUNTED and k + 1 < len(distinct):
                continue
            hashes, counts = np.unique(np.concatenate(run), return_counts=True)
            often = counts >= 4
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(hashes[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.nulls(n, pa.binary())], names=names)
            run, total = [], 0

    names = ["id", "digest", "n", "klass", "check", "sketch"]
    return docs.mapInArrow(measured, f"id {docs.schema['id'].dataType.simpleString()}, digest bigint, n bigint, klass bigint, check bigint, sketch binary")


def _prefixes(docs: DataFrame, words: int, percent: int, seed: int, hot) -> DataFrame:
    """(shingle, klass, n, cap, hot): of each class within a batch the first shingles, of which any near partner shares one.

    If a shingle is the first that two texts share, what they share is no more than what either has from its place on:
    that caps the size of a partner.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, rank, many = hot.value
        marked = np.zeros(1 << 20, bool)
        marked[(ordered >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            seen = set()
            for _, sets in _sets(batch, 2, words, seed):
                shingles, klasses, sizes, caps, frequent = [], [], [], [], []
                for u in sets:
                    n = len(u)
                    key = _class_of(u)
                    if not n or key in seen:
                        continue
                    seen.add(key)
                    keep = n - (percent * n + 99) // 100 + 1
                    maybe, heavy = marked[(u >> np.uint64(44)).astype(np.int64)], np.zeros(n, bool)
                    if maybe.any():
                        at = np.minimum(np.searchsorted(ordered, u), len(ordered) - 1)
                        known = ordered[at] == u
                        order = np.lexsort((u, np.where(known, rank[at], 0)))
                        u, heavy = u[order], (known & many[at])[order]
                    shingles.append(u[:keep])
                    klasses.append(np.full(min(keep, n), np.frombuffer(key, np.int64)[0]))
                    sizes.append(np.full(min(keep, n), n, np.int32))
                    caps.append(((n - np.arange(min(keep, n))) * (100 + percent) // percent - n).astype(np.int32))
                    frequent.append(heavy[:keep])
                if shingles:
                    columns = [np.concatenate(shingles).view(np.int64), *map(np.concatenate, (klasses, sizes, caps, frequent))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "klass", "n", "cap", "hot"])
            release()

    return docs.mapInArrow(found, "shingle bigint, klass bigint, n int, cap int, hot boolean")


def _members(firsts: DataFrame, percent: int) -> DataFrame:
    """(region, klass, home): texts that share a leading shingle, by the first of them and by bands of sizes, where caps allow near pairs.

    Pairs of a small cell are tested; from a larger one a text is left out if nobody's cap admits it or its own admits nobody.
    Cells of very frequent shingles are told by partial sums and by a join with their at most ``HOT_SHINGLES`` rows.
    Near sets are of one band of sizes, or the larger one visits the smaller one's.
    """
    told = {"rows": F.count(F.lit(1)), "region": F.min("klass"), "last": F.max("klass"), "most": F.max("cap"), "least": F.min("n")}
    partner = "region <> last and n <= most and least <= cap"
    hot = firsts.where("hot")
    large = hot.join(F.broadcast(hot.groupBy("shingle").agg(*[c.alias(name) for name, c in told.items()])), "shingle").where(partner).select("region", "klass", "n")
    cell = Window.partitionBy("shingle")
    cold = cut(firsts.where("not hot").drop("hot").select("*", *[c.over(cell).alias(name) for name, c in told.items()]).where(partner).drop("last", "most", "least"))
    large = large.union(cold.where(F.col("rows") > SMALL_CELL).select("region", "klass", "n"))
    small = cold.where(F.col("rows") <= SMALL_CELL).groupBy("shingle").agg(F.collect_set(F.struct("klass", "n", "cap")).alias("s"))
    near = F.expr("flatten(transform(s, x -> transform(filter(s, y -> y.klass < x.klass and x.n <= y.cap and y.n <= x.cap), y -> struct(x, y))))")
    pairs = small.select(F.explode(near).alias("pair")).select(F.col("pair.y.klass").alias("region"), F.explode(F.array("pair.x", "pair.y")).alias("end")).select("region", "end.klass", "end.n")
    band = F.floor(F.log2("n"))
    rows = pairs.union(large).distinct().select("region", "klass", band.alias("own"), F.explode(F.sequence(F.floor(F.log2(F.expr(f"(n * {percent}L + 99) div 100"))), band)).alias("band"))
    rows = cut(rows.select(F.xxhash64("region", "band").alias("region"), "klass", (F.col("own") == F.col("band")).alias("home")))
    alive = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("home").cast("int")).alias("lived")).where("rows > 1 and lived = 1").select("region")
    return rows.join(alive, "region")


# -- regions ------------------------------------------------------------------------------------------------
def _sizes(rows: DataFrame) -> DataFrame:
    """(region, size, rows, weight, places) of regions in which something is to be compared; ``size`` counts loads of a leaf in members."""
    load = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * LEAF / F.lit(WEIGHT)))
    return rows.groupBy("region").agg(load.cast("long").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"), F.max(F.col("home").cast("int")).alias("lived"), F.min(F.length("sketch")).alias("places")).where("lived = 1 and rows > 1").drop("lived")


def _split(rows: DataFrame, level: int, percent: int) -> DataFrame:
    """Members of large regions (with ``size`` and ``places``) in the Voronoi regions of some members, with windows: ``parent`` added."""
    wide = 2 * (1 - percent / 100) + 1e-9
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("size") / LEAF) * 2)
    drawn = rows.where(F.pmod(F.xxhash64("klass", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("size") / (2 * wanted)))) == 0)
    pivots = drawn.groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct("klass", "n", "sketch"))), 1, PIVOTS).alias("pivots"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for region, own in frame.groupby("region", sort=False):
                pivot, places = own["pivots"].iloc[0], int(own["places"].iloc[0])
                mine = folded([*own["sketch"], *[p["sketch"] for p in pivot], b"\0" * places])[:-1]
                mine, theirs = mine[: len(own)], mine[len(own) :]
                n, far = own["n"].to_numpy(), np.empty((len(own), len(pivot)))
                for k, p in enumerate(pivot):
                    gap = np.abs(mine - theirs[k]).sum(axis=1, dtype=np.int64)
                    total = mine.sum(axis=1) + theirs[k].sum()
                    far[:, k] = np.where(total > 0, 2 * gap / np.maximum(1, total + gap), 0.0)
                nearest = far.argmin(axis=1)
                row, k = np.nonzero(far <= far.min(axis=1, keepdims=True) + wide)
                codes = np.array([np.frombuffer(hashlib.blake2b(f"{region} {j}".encode(), digest_size=8).digest(), np.int64)[0] for j in range(len(pivot))])
                out = own.iloc[row].assign(parent=region, region=codes[k], home=own["home"].to_numpy()[row] & (nearest[row] == k))
                yield pa.RecordBatch.from_pandas(out[["parent", "region", "klass", "n", "sketch", "home"]], schema=schema, preserve_index=False)

    schema = pa.schema([("parent", pa.int64()), ("region", pa.int64()), ("klass", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("home", pa.bool_())])
    return rows.join(pivots, "region").mapInArrow(placed, "parent bigint, region bigint, klass bigint, n bigint, sketch binary, home boolean")


def _leaves(members: DataFrame, percent: int) -> DataFrame:
    """(b0, b1, b2, region, klass, n, sketch, home, half): regions split until they are leaves; blocks b1, b2 of those that do not shrink."""
    done, dense, rows, total = [], [], cut(members), [0, 0]
    for level in range(LEVELS + 1):
        sizes = cut(_sizes(rows))
        leaf, large = sizes.where(F.col("size") <= LEAF), sizes.where(F.col("size") > LEAF)
        ended = large.isEmpty()
        done.append(rows if ended else rows.join(leaf.select("region"), "region"))
        total = [a + b for a, b in zip(total, leaf.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "weight")]).first())]
        if ended:
            break
        live = rows.join(large.drop("rows", "weight"), "region")
        if level == LEVELS:
            dense.append(live)
            break
        parts = cut(_split(live, level, percent))
        pairs = parts.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("home").cast("int")).alias("lived")).groupBy("parent").agg(F.sum(F.col("c").cast("double") * F.col("c") * F.col("lived")).alias("pairs"))
        before = live.groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("m"), F.first("size").alias("size")).withColumnRenamed("region", "parent")
        shrunk = cut(before.join(pairs, "parent", "left").select("parent", F.coalesce(F.col("pairs") <= (1 - SAVED) * F.col("m") * F.col("m"), F.lit(False)).alias("ok")))
        dense.append(live.join(shrunk.where("not ok").select(F.col("parent").alias("region")), "region"))
        rows = cut(parts.join(shrunk.where("ok").select("parent"), "parent").drop("parent"))
    small = done[0]
    for d in done[1:]:
        small = small.unionByName(d)
    buckets = max(1, total[0] // LEAF, 4 * total[1] // WEIGHT)
    none = F.lit(-1)
    out = small.select("region", "klass", "n", "sketch", "home", F.pmod(F.xxhash64("region"), F.lit(buckets)).alias("b0"), none.alias("b1"), none.alias("b2"), F.lit(False).alias("half"))
    for d in dense:
        blocks = F.ceil(2 * F.col("size") / LEAF).cast("int")
        dealt = d.select("region", "klass", "n", "sketch", "home", blocks.alias("blocks"), F.pmod(F.xxhash64("klass"), blocks).cast("int").alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        out = out.unionByName(dealt.select("region", "klass", "n", "sketch", "home", F.col("region").alias("b0"), F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).alias("half")))
    return out


def _regions(rows: pd.DataFrame):
    """Runs of rows of one region, and which pairs of them count: one end at home, and ends of two blocks if there are two."""
    rows = rows.sort_values(["region", "klass"], kind="stable").reset_index(drop=True)
    region = rows["region"].to_numpy()
    edge = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True]) if len(rows) else np.zeros(1, int)
    for begin, end in zip(edge[:-1], edge[1:]):
        if end - begin > 1:
            own = rows.iloc[begin:end]
            home = own["home"].to_numpy()
            meets = home[:, None] | home[None, :]
            if own["b1"].iloc[0] != own["b2"].iloc[0]:
                half = own["half"].to_numpy()
                meets &= half[:, None] != half[None, :]
            np.fill_diagonal(meets, False)
            yield own, meets


def _open_groups(percent: int):
    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        """(group, klass, n): members of leaves tied by pairs that sizes and sketches leave open; equal groups have equal numbers."""
        out = []
        for own, meets in _regions(rows):
            n, h, klass = own["n"].to_numpy(), folded(list(own["sketch"])), own["klass"].to_numpy()
            near = np.zeros(meets.shape, bool)
            step = max(1, 2_000_000 // max(1, h.size))
            for k in range(0, len(own), step):
                gap = apart(h[k : k + step, None, :], n[k : k + step, None], h[None, :, :], n[None, :])
                total = n[k : k + step, None] + n[None, :]
                near[k : k + step] = 100 * (total - gap) >= percent * (total + gap)
            near &= meets
            if not near.any():
                continue
            root = roots(near)
            for r in np.flatnonzero(np.bincount(root) > 1):
                mine = np.flatnonzero(root == r)
                number = hashlib.blake2b(np.sort(klass[mine]).tobytes(), digest_size=8).digest()
                out.append(pd.DataFrame({"group": np.frombuffer(number, np.int64)[0], "klass": klass[mine], "n": n[mine]}))
        return pd.concat(out) if out else pd.DataFrame({"group": [], "klass": [], "n": []}).astype("int64")

    return groups


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, from the elements that several of them hold."""
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(u) for u in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    element = np.cumsum(new) - 1
    held = np.bincount(element)
    keep = held[element] > 1
    element, owner = np.unique(element[keep], return_inverse=True)[1], owner[keep]
    columns, work = int(element.max(initial=-1)) + 1, float((held[held > 1].astype(float) ** 2).sum())
    if columns and m * m * columns / 1e10 < work / 1e8 + 0.01:
        both = np.zeros((m, m), np.float32)
        for k in range(0, columns, 4096):  # elements are in order, so a slice of them is a run of rows
            a, b = np.searchsorted(element, (k, k + 4096))
            held_by = np.zeros((m, min(4096, columns - k)), np.float32)
            held_by[owner[a:b], element[a:b] - k] = 1
            both += held_by @ held_by.T
        return both.astype(np.int64)
    both, begin = np.zeros((m, m), np.int64), np.searchsorted(element, np.arange(columns + 1))
    by_owner = np.argsort(owner, kind="stable")
    edge = np.searchsorted(owner[by_owner], np.arange(m + 1))
    for i in range(m):
        mine = element[by_owner[edge[i] : edge[i + 1]]]
        length = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum())) if len(mine) else np.zeros(0, np.int64)
        both[i] = np.bincount(owner[at], minlength=m)
    return both


def roots(near: np.ndarray) -> np.ndarray:
    """For each member the smallest one reachable, by a symmetric matrix of links."""
    out = np.arange(len(near))
    i, j = np.nonzero(near)
    while True:
        low = out.copy()
        np.minimum.at(low, i, out[j])
        low = low[low]
        if (low == out).all():
            return out
        out = low


def _linked(words: int, percent: int, seed: int):
    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links among the members of each group."""
        out = []
        for _, own in rows.groupby("group", sort=False):
            sets: list[np.ndarray] = []
            for _, part in _sets(pa.RecordBatch.from_arrays([pa.array(own["text"], pa.large_string())], names=["text"]), 0, words, seed):
                sets += part
            n, both = np.array([len(u) for u in sets]), intersections(sets)
            root, klass = roots(100 * both >= percent * (n[:, None] + n[None, :] - both)), own["klass"].to_numpy()
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                out.append(pd.DataFrame({"x": klass[tied], "y": klass[root[tied]]}))
        release()
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": []}).astype("int64")

    return linked


def _texts(own: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(klass, text) of one row of each wanted class; the corpus itself is not shuffled while the classes are few."""
    wanted = cut(nodes.distinct().join(classes, "klass").select("klass", F.col("one.digest").alias("digest"), F.xxhash64("one.id").alias("key")))
    few = wanted.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES
    w, t = (F.broadcast(wanted) if few else wanted).alias("w"), own.alias("t")
    return cut(t.join(w, (F.col("t.digest") == F.col("w.digest")) & (F.xxhash64("t.id") == F.col("w.key"))).select("klass", "text").dropDuplicates(["klass"]))


def _placed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the text, n, first) for every row; ``first`` is the first row (none, id, digest) of its component."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    for seed in range(16):  # classes go by 64 bits; the other 64 tell whether two classes share them
        measured = cut(_measure(own, words, seed))
        rows = measured.where("n is not null")
        row = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
        classes = cut(rows.where("n > 0").groupBy("klass").agg(F.min(row).alias("one"), F.first("n").alias("n"), F.max("sketch").alias("sketch"), F.min("check").alias("a"), F.max("check").alias("b")))
        if classes.where("a <> b").isEmpty():
            break
    frequent = measured.where("n is null").groupBy(F.col("klass").alias("shingle")).agg(F.sum("check").alias("n")).orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES)
    listed = frequent.toPandas()  # bounded by HOT_SHINGLES; only an order, no decision depends on it
    values = np.append(listed["shingle"].to_numpy(np.int64).view(np.uint64), np.uint64(2**64 - 1))
    ranks = np.append(np.arange(len(listed), 0, -1), 0)
    order = np.argsort(values)
    hot = spark.sparkContext.broadcast((values[order], ranks[order], np.append(listed["n"].to_numpy(np.int64) >= HOT_CELL, False)[order]))

    firsts = cut(_prefixes(own, words, percent, seed, hot))
    members = _members(firsts, percent).join(classes.select("klass", "n", "sketch"), "klass")
    leaves = _leaves(members.select("region", "klass", "n", "sketch", "home"), percent)
    groups = cut(leaves.groupBy("b0", "b1", "b2").applyInPandas(_open_groups(percent), "group bigint, klass bigint, n bigint").distinct())
    texts = _texts(own, classes, groups.select("klass"))
    total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bucket = F.pmod(F.xxhash64("group"), F.lit(max(1, total[0] // LEAF, 4 * total[1] // WEIGHT)))
    links = cut(groups.select("group", "klass").join(texts, "klass").groupBy(bucket.alias("bucket")).applyInPandas(_linked(words, percent, seed), "x bigint, y bigint"))
    node = lambda side: classes.select(F.col("klass").alias(side), F.struct("one.*", "klass").alias("end_" + side))
    edges = links.distinct().join(node("x"), "x").join(node("y"), "y").select(F.col("end_x").alias("src"), F.col("end_y").alias("dst"))
    labels = connected_components(edges).select(F.col("node.klass").alias("klass"), F.struct("component.none", "component.id", "component.digest").alias("first"))
    named = cut(classes.join(labels, "klass", "left").select("klass", F.coalesce("first", "one").alias("first")))
    return rows.join(named, "klass", "left").select("id", "digest", "n", "first")


def near_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable by links, itself included.

    Two rows link when ``100 * |intersection| >= percent * |union|`` of their sets of distinct word shingles.
    Null and empty texts and texts without words have no shingles and link with nothing (their component is
    their own id).  Equal sets are one class from the start, so copies cost one row each.  Repeated rows stay;
    other columns are not read, whatever their names.
    """
    placed = _placed(docs, words, percent, id_col, text_col)
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near-duplicates: of each component one row of smallest id (then digest of its text) stays.

    So one of repeated rows stays (which one, where their other columns differ, is left open), and of different texts that
    share an id only those go that are copies.  Rows without shingles all stay.  All columns stay as they are.
    """
    placed = cut(_placed(docs, words, percent, id_col, text_col).where("n > 0").select(F.struct(F.col("id").isNull().alias("none"), "id", "digest").alias("row"), "first"))
    key = F.xxhash64(F.col("row.none"), F.col("row.id"))
    gone = cut(placed.where("row <> first").select(key.alias("key"), F.col("row.digest").alias("digest")).distinct())
    digest, mine = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), F.xxhash64(docs[id_col].isNull(), docs[id_col])
    few = lambda rows: F.broadcast(rows) if rows.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else rows
    same = lambda rows: (mine == rows["key"]) & (digest == rows["digest"])
    kept = docs.join(few(gone), same(gone), "left_anti")
    again = cut(placed.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key.alias("key"), F.col("row.digest").alias("digest")).distinct())
    if again.isEmpty():
        return kept
    (name,) = fresh(docs, "digest")
    one = kept.join(again, same(again), "left_semi").withColumn(name, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, name]).drop(name)
    return kept.join(again, same(again), "left_anti").union(one)

"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages, and only the bag has a label.

Every passage of the whole text is encoded (one tanh layer over byte-class transitions and word measures), gated attention weighs the
encodings, and the weighted mean is scored.  Weights are learned from document labels alone, on a bounded sample of labelled rows.  Long texts are
read section by section; the attention's softmax is kept as a running sum, so memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, text_slices

PASSAGE, SECTION, CHUNK = 1 << 10, 1 << 16, 1 << 19
#: Labelled documents of each class that the fit may use, the longest text among them, and their bytes in all.
FIT_ROWS, FIT_LONGEST, FIT_BYTES = 2048, 1 << 18, 24 << 20
#: Features are cut at so many standard deviations.
CLIP = 3
#: A document is predicted good from this score on.
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2

_KINDS = [b" ", b"\t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-", b"#*$%&|<>"]
#: Classes of bytes: those of ``_KINDS``, other ASCII, non-ASCII.
N_KINDS = len(_KINDS) + 2
_CLASS = np.full(256, len(_KINDS), np.uint8)
_CLASS[128:] = len(_KINDS) + 1
for _k, _own in enumerate(_KINDS):
    _CLASS[list(_own)] = _k
_BLANK, _LINE = 0, 2
_draw = np.random.default_rng(17)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = _draw.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MIX = _draw.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
#: Transitions between classes, then: log size, words a byte, mean and spread of word sizes, distinct words, windows seen twice.
N_FEATURES = N_KINDS * N_KINDS + 6


def cut_bags(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of each passage of texts that lie end to end at ``offsets``; an empty text has one empty passage."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    doc = np.repeat(np.arange(len(sizes)), n)
    begin = offsets[:-1][doc] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PASSAGE
    return doc, begin, np.minimum(begin + PASSAGE, offsets[1:][doc])


def features(raw: np.ndarray, sizes: np.ndarray, section: np.ndarray) -> np.ndarray:
    """A row for each passage of ``raw``, which they fill end to end; ``section`` numbers the stretch of text that a passage is part of."""
    n_passages = len(sizes)
    passage = np.repeat(np.arange(n_passages), sizes)
    kind = _CLASS[raw].astype(np.int64)
    before = np.r_[_BLANK, kind[:-1]] if len(kind) else kind
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = _BLANK
    moves = np.bincount(passage * N_KINDS**2 + before * N_KINDS + kind, minlength=n_passages * N_KINDS**2).reshape(n_passages, -1)
    out = np.zeros((n_passages, N_FEATURES), np.float32)
    out[:, : N_KINDS**2] = moves / np.maximum(1, sizes)[:, None]
    out[:, -6] = np.log1p(sizes)
    inside = kind > _LINE
    first = np.flatnonzero(inside & (before <= _LINE))
    if not len(first):
        return out
    place = np.arange(len(raw)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(raw)]))
    word = np.add.reduceat(np.where(inside, _BYTE[raw] * _POWER[place & 63], np.uint64(0)), first)
    length = np.add.reduceat(inside.astype(np.int64), first).astype(np.float64)
    own = passage[first]
    words = np.bincount(own, minlength=n_passages)
    per = np.maximum(1, words)
    mean = np.bincount(own, length, n_passages) / per
    spread = np.sqrt(np.maximum(0, np.bincount(own, length**2, n_passages) / per - mean**2))
    distinct = np.unique(word * _MIX[0] + own.astype(np.uint64) * _MIX[3], return_index=True)[1]
    out[:, -5], out[:, -4], out[:, -3] = words / np.maximum(1, sizes), np.minimum(mean, 64) / 8, np.minimum(spread, 64) / 8
    out[:, -2] = np.bincount(own[distinct], minlength=n_passages) / per
    if len(word) > 2:
        part = section[own]
        same = part[2:] == part[:-2]
        window = (word[:-2] * _MIX[0] + word[1:-1] * _MIX[1] + word[2:] * _MIX[2] + part[2:].astype(np.uint64) * _MIX[3])[same]
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        where = own[:-2][same]
        out[:, -1] = np.bincount(where, times[which] > 1, n_passages) / np.maximum(1, np.bincount(where, minlength=n_passages))
    return out


def bags(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document of each passage, features), in stretches of about ``CHUNK`` bytes that end with a section."""
    doc, begin, end = cut_bags(offsets)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | ((begin[1:] - offsets[:-1][doc[1:]]) % SECTION == 0)]
    section = np.cumsum(fresh)
    at = 0
    while at < len(doc):
        to = int(np.searchsorted(begin, begin[at] + CHUNK, side="right"))
        while to < len(doc) and not fresh[to]:
            to += 1
        yield doc[at:to], features(raw[begin[at] : end[to - 1]], (end - begin)[at:to], section[at:to])
        at = to


@dataclass
class Attention:
    """Weights of the encoder, of the gated attention and of the score, and the scale of the features."""

    middle: np.ndarray
    spread: np.ndarray
    params: dict[str, np.ndarray]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -CLIP, CLIP)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoding and attention of each (scaled) passage."""
        p = self.params
        h = np.tanh(x @ p["enc"] + p["enc0"])
        return h, (np.tanh(h @ p["gate_v"]) * _sigmoid(h @ p["gate_u"])) @ p["gate_w"]

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; the softmax over its passages is kept as (largest, sum, weighted sum)."""
        n, width = len(offsets) - 1, len(self.params["out"])
        top, total, mean = np.full(n, -np.inf), np.zeros(n), np.zeros((n, width))
        for doc, x in bags(raw, offsets):
            h, a = self.encode(self.scaled(x.astype(np.float64)))
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            own = doc[first]
            high = np.maximum(top[own], np.maximum.reduceat(a, first))
            keep = np.exp(top[own] - high)
            weight = np.exp(a - np.repeat(high, np.diff(np.r_[first, len(doc)])))
            total[own] = total[own] * keep + np.add.reduceat(weight, first)
            mean[own] = mean[own] * keep[:, None] + np.add.reduceat(weight[:, None] * h, first, axis=0)
            top[own] = high
        return _sigmoid((mean / total[:, None]) @ self.params["out"] + self.params["out0"][0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def start(n_features: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    return {"enc": draw(n_features, hidden), "enc0": np.zeros(hidden), "gate_v": draw(hidden, hidden), "gate_u": draw(hidden, hidden), "gate_w": draw(hidden, 1)[:, 0], "out": draw(hidden, 1)[:, 0], "out0": np.zeros(1)}


def loss_and_slopes(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted log loss of bags (passages of bag i begin at ``first[i]``) with its derivatives."""
    bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
    h = np.tanh(x @ p["enc"] + p["enc0"])
    v, u = np.tanh(h @ p["gate_v"]), _sigmoid(h @ p["gate_u"])
    e = (v * u) @ p["gate_w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    s = _sigmoid(z @ p["out"] + p["out0"][0])
    share = weight / weight.sum()
    loss = -(share * np.where(label > 0, np.log(s + 1e-12), np.log(1 - s + 1e-12))).sum() + decay * sum((p[k] ** 2).sum() for k in ("enc", "gate_v", "gate_u", "out"))
    d = share * (s - label)
    dz = d[:, None] * p["out"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    dv, du = de[:, None] * p["gate_w"] * u * (1 - v * v), de[:, None] * p["gate_w"] * v * u * (1 - u)
    dh = (a[:, None] * dz[bag] + dv @ p["gate_v"].T + du @ p["gate_u"].T) * (1 - h * h)
    slopes = {"enc": x.T @ dh, "enc0": dh.sum(axis=0), "gate_v": h.T @ dv, "gate_u": h.T @ du, "gate_w": (v * u).T @ de, "out": z.T @ d, "out0": np.array([d.sum()])}
    for k in ("enc", "gate_v", "gate_u", "out"):
        slopes[k] = slopes[k] + 2 * decay * p[k]
    return float(loss), slopes


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, *, hidden: int = 16, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 5e-4, seed: int = 3) -> Attention:
    """Adam over shuffled batches of bags; always the same for the same input."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Attention(middle, spread, start(x.shape[1], hidden, seed))
    x, sizes, rng = model.scaled(x), np.diff(np.r_[first, len(x)]), np.random.default_rng(seed)
    p, at = model.params, 0
    p["out0"][:] = np.log((weight[label > 0].sum() + 0.5) / (weight[label <= 0].sum() + 0.5))
    moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in p.items()}
    for _ in range(epochs):
        order = rng.permutation(len(first))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            begins = np.r_[0, np.cumsum(sizes[own])[:-1]]
            rows = np.repeat(first[own] - begins, sizes[own]) + np.arange(sizes[own].sum())
            _, slopes = loss_and_slopes(p, x[rows], begins, label[own], weight[own], decay)
            at += 1
            for name, g in slopes.items():
                one, two = moment[name] = (0.9 * moment[name][0] + 0.1 * g, 0.999 * moment[name][1] + 0.001 * g * g)
                p[name] -= rate * (one / (1 - 0.9**at)) / (np.sqrt(two / (1 - 0.999**at)) + 1e-8)
    return model


def held_out(id_col: str):
    """Whether a row is of the fold that the fit never sees; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention | None:
    """Weights from up to ``FIT_ROWS`` labelled documents of each class outside the held-out fold; None if there is none.

    Rows are taken by a hash of the id and weighed by how many labelled rows their class has.  Ids with both labels, ids without a text row
    and texts beyond ``FIT_LONGEST`` bytes are left out; of rows with equal ids the least text counts.  All this bounds the fit, not the scores.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most").select("id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS) for k in sorted(sizes)]
    if not taken:
        return None
    rows = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(rows), "id")
    sample = cut(texts.groupBy("id", "label").agg(F.min("text").alias("text")).where(F.octet_length("text") <= FIT_LONGEST))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, raw in text_slices(batch["text"]):
                parts = list(bags(raw, offsets))
                doc, x = np.concatenate([d for d, _ in parts]), np.concatenate([f for _, f in parts])
                edge = np.searchsorted(doc, np.arange(len(offsets)))
                own = [x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.string()).slice(row, len(own)), batch["label"].slice(row, len(own)), pa.array(own, pa.binary())], schema=schema)

    schema = pa.schema([("id", pa.string()), ("label", pa.int32()), ("x", pa.binary())])
    order = sample.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").collect()
    within = [r["id"] for r, so_far in zip(order, np.cumsum([r["size"] for r in order])) if so_far <= FIT_BYTES]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in within], sample.select("id").schema) if within else sample.select("id").limit(0)
    found = sample.join(F.broadcast(wanted), "id").mapInArrow(encoded, "id string, label int, x binary").toPandas().sort_values("id")
    if not len(found):
        return None
    blocks = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found["x"]]
    first = np.cumsum([0] + [len(b) for b in blocks[:-1]])
    label = found["label"].to_numpy()
    weight = np.array([sizes[k] / (label == k).sum() for k in label], float)
    return train(np.concatenate(blocks).astype(np.float64), first, label.astype(float), weight)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """(id, held_out, score, predicted) of every row from its whole text.

    Null and empty texts are a bag of one empty passage and get a score like any other.  Equal texts get equal scores; rows with equal or
    null ids are scored each.  Without any usable label all scores are 0.5.  Other columns are not read.  Scores are rounded to 6 digits.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, offsets, raw in text_slices(batch["text"]):
                parts.append(model.score(raw, offsets) if model else np.full(len(offsets) - 1, 0.5))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(np.round(np.concatenate(parts), 6))], names=["id", "held_out", "score"])
        release()

    plain = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = plain.mapInArrow(scored, f"id {plain.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))

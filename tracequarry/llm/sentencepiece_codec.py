"""SentencePiece encoding and decoding by a streaming Viterbi pass over the piece lattice.

The pass keeps backpointers for one window as long as the longest piece.  Whenever the paths that survive
in the window share a boundary, the ids before it are committed and forgotten, so memory does not grow
with the text.

For a ``unigram`` model a path's worth is the sum of its piece scores.  A ``bpe`` model does not maximise a
sum: it merges the neighbours whose joint piece scores best.  A sequence is what those merges give exactly
when each two neighbouring pieces are, so for such a model an arc is admitted only if its piece is stable
beside the piece its predecessor ends with; then each boundary has at most one surviving path.
Such a model's segments that one window holds make their passes side by side, as arrays.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

SPACE = "▁"
#: Segments (in each of two generations, about 200 bytes each) and piece pairs that a worker remembers, and the longest remembered segment.
MEMO_ENTRIES, PAIR_ENTRIES, MEMO_CHARS = 50_000, 100_000, 48
#: Letters of the texts encoded together (a longer text goes alone), segments whose passes run side by side, bits of the slots for their pairs.
PASS_CHARS, SIDE_BY_SIDE, PAIR_BITS = 1 << 18, 2048, 19
#: Bits of a letter in a key, and what stands behind a segment's last letter.
LETTER_BITS, NO_LETTER = 21, (1 << 21) - 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceModel:
    """Pieces, scores and flags of a sentencepiece model file, in plain Python so that it can be broadcast."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: str, add_prefix: bool):
        self.kind, self.add_prefix = kind, add_prefix
        self.key = hashlib.sha256(repr((pieces, kind, add_prefix)).encode()).hexdigest()
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.score = [s for _, s, _ in pieces]
        self.text = [p for p, _, _ in pieces]
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.score, default=0.0) - 10.0
        self.look = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids
        if kind == "bpe":
            self._undo()
        raw = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([raw[i]]) if i in raw else (p.encode() if t in (NORMAL, USER) else b" \xe2\x81\x87 " if t == UNKNOWN else b"") for i, (p, _, t) in enumerate(pieces)]

    def merge(self, text: str) -> list[tuple[str, tuple[str, str] | None]]:
        """(piece, the two pieces last merged into it) after repeated merges of the best scored, leftmost neighbours."""
        ids, score = self.ids, self.score
        parts: list = [(c, None) for c in text]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i][0] + parts[i + 1][0])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                return parts
            a, b = parts[at][0], parts[at + 1][0]
            parts[at : at + 2] = [(a + b, (a, b))]

    def _undo(self) -> None:
        """For each piece the two pieces its last merge joined (-1: a letter, -2: unknown), and whether it comes out whole."""
        order = sorted(range(len(self.score)), key=lambda i: (-self.score[i], i))
        self.rank = [0] * len(order)
        for r, i in enumerate(order):
            self.rank[i] = r
        shared: dict[float, int] = {}
        for i in self.ids.values():
            if len(self.text[i]) > 1:
                shared[self.score[i]] = shared.get(self.score[i], 0) + 1
        self.left, self.right, self.whole, self.tied = ([-1] * len(order) for _ in range(4))
        self.whole, self.tied = [False] * len(order), [False] * len(order)
        for p, i in self.ids.items():
            parts = self.merge(p)
            self.whole[i] = len(parts) == 1
            self.tied[i] = len(p) > 1 and shared[self.score[i]] > 1
            if len(p) > 1:
                a, b = parts[0][1] if self.whole[i] else ("", "")
                self.left[i], self.right[i] = self.ids.get(a, -2), self.ids.get(b, -2)
                if self.right[i] == -2:
                    self.left[i] = -2

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if len(n.precompiled_charsmap) or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        kind = {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type]
        return cls([(p.piece, p.score, p.type) for p in m.pieces], kind, n.add_dummy_prefix)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """Values of nonnegative keys, all different, asked for by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            put = self.keys[slot] == keys
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put] + 1 & len(self.keys) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for a key that is not there."""
        slot = _slots(keys, self.bits)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot[rest] = slot[rest] + 1 & len(self.keys) - 1
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Codec:
    def __init__(self, model: PieceModel):
        self.m = model
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        inner = sorted({c for p in model.ids if len(p) > 1 for c in p} - {SPACE})
        spaced = any(SPACE in p.lstrip(SPACE) for p in model.ids)
        letters = "[" + "".join(map(re.escape, inner)) + (re.escape(SPACE) if spaced else "") + "]" if inner else "(?!)"
        # No piece reaches across the ends of these segments, so all paths converge there.
        self.segments = re.compile(f"{SPACE}*{letters}+|{SPACE}+|.", re.DOTALL)
        self.raw = pa.array(model.raw, pa.large_binary())
        if model.kind == "bpe":
            node = {p: i for i, p in enumerate(["", *model.look])}
            #: From a beginning of pieces and a letter to the longer beginning, and the piece that a beginning is.
            self.longer = Lookup(np.array([node[p[:-1]] << LETTER_BITS | ord(p[-1]) for p in model.look], np.int64), np.arange(1, len(node)))
            self.piece, self.whole = np.array([-1, *model.look.values()], np.int64), np.array(model.whole)
            self.known = np.full(1 << PAIR_BITS, -1, np.int64)

    # -- encoding -------------------------------------------------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """The pieces that repeated best merges leave."""
        return [p for p, _ in self.m.merge(text)]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the texts of pieces ``a`` and ``b`` together gives just these two.

        Undoes the merges of both, latest first.  If on the way the two pieces at the seam could have
        merged before the undone merge took place, the seam would not have stayed.
        """
        m = self.m
        ids, text, rank, left, right = m.ids, m.text, m.rank, m.left, m.right
        if left[a] == -2 or left[b] == -2 or m.tied[a] or m.tied[b]:
            return self.merged(text[a] + text[b]) == [text[a], text[b]]
        limit = len(rank)
        while True:
            k = ids.get(text[a] + text[b])
            if k is not None and rank[k] < limit:
                return False
            ra, rb = (rank[a] if left[a] >= 0 else -1), (rank[b] if left[b] >= 0 else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, right[a]
            else:
                limit, b = rb + 1, left[b]

    def paths(self, segment: str) -> list[int]:
        """Streaming Viterbi: ids of pieces, or of -1 - code point for a letter that is no piece.

        ``last``, ``back`` and ``worth`` cover the window from ``base`` on; arcs leave each reached boundary in order, so a
        boundary is final once the pass stands on it.
        """
        m, n, out = self.m, len(segment), []
        look, score, longest, floor, bpe, pairs = m.look.get, m.score, m.longest, m.floor, m.kind == "bpe", self.pairs
        base, window = 0, 4 * longest
        last: list = [None] * (n + 1 if n <= window else window + longest + 1)
        back, worth = [0] * len(last), [0.0] * len(last)
        at = 0
        while at < n:
            before = last[at - base] if at else None
            if at and before is None:
                at += 1
                continue
            if at - base >= window:  # commit what all surviving paths share
                live = {e for e in range(at, min(n, at + longest) + 1) if e - base < len(last) and last[e - base] is not None}
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    live.add(back[far - base])
                meet = live.pop()
                self._commit(out, last, back, base, meet)
                drop = meet - base
                last, back, worth = last[drop:], back[drop:], worth[drop:]
                base = meet
            need = at - base + longest + 1 - len(last)
            if need > 0:
                last += [None] * need
                back += [0] * need
                worth += [0.0] * need
            for end in range(at + 1, min(n, at + longest) + 1):
                k = look(segment[at:end])
                if k is None:
                    if end > at + 1:
                        break
                    k = -1 - ord(segment[at])
                elif k < 0:  # only the beginning of pieces
                    if end > at + 1:
                        continue
                    k = -1 - ord(segment[at])
                if bpe:
                    if last[end - base] is None:
                        if before is None:
                            ok = k < 0 or m.whole[k]
                        elif k < 0 or before < 0:
                            ok = self.merged(self._text(before) + self._text(k)) == [self._text(before), self._text(k)]
                        else:
                            key = before << 20 | k
                            ok = pairs.get(key)
                            if ok is None:
                                if len(pairs) >= PAIR_ENTRIES:
                                    pairs.clear()
                                ok = pairs[key] = self.stable(before, k)
                        if ok:
                            last[end - base], back[end - base] = k, at
                else:
                    w = worth[at - base] + (floor if k < 0 else score[k])
                    if last[end - base] is None or w > worth[end - base]:
                        last[end - base], back[end - base], worth[end - base] = k, at, w
            at += 1
        self._commit(out, last, back, base, n)
        return out

    def windows(self, segments: list[str]) -> list[bytes]:
        """Ids of a merge model's segments that one window holds: the passes of all side by side, nothing is committed before the ends.

        A place of the arrays is the boundary before a letter; each segment has one more, behind its last letter.
        Arcs are tried in the order of the boundaries that they leave, counted within their segments.
        """
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        ends = np.cumsum(sizes) - 1
        codes = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[ends] = NO_LETTER
        inside = (np.arange(len(codes)) - np.repeat(ends + 1 - sizes, sizes)).astype(np.int16)
        start, node, arcs = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for n in range(self.m.longest):
            node = self.longer(node << LETTER_BITS | codes[start + n])
            start, node = start[node >= 0], node[node >= 0]
            k = self.piece[node]
            arcs.append((start[k >= 0], k[k >= 0], start[k >= 0] + n + 1))
        start, piece, end = (np.concatenate(x) for x in zip(*arcs))
        order = np.argsort(inside[start], kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        last, back, done = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64), 0
        for count in np.bincount(inside[start]).tolist():
            a, k, b = (x[done : done + count] for x in (start, piece, end))
            if done:
                live = (last[a] >= 0) & (last[b] < 0)
                a, k, b = a[live], k[live], b[live]
                ok = self._stable(last[a], k)
            else:
                ok = self.whole[k]
            last[b[ok]], back[b[ok]] = k[ok], a[ok]
            done += count
        passed, at = np.zeros(len(codes), bool), ends[last[ends] >= 0]
        while len(at):
            passed[at] = True
            at = back[at]
            at = at[inside[at] > 0]
        ids, stop = last[passed].astype(np.int32).tobytes(), 4 * np.cumsum(passed)[ends]
        # A segment with a letter that is no piece may have no path here.
        return [ids[i:j] or self.segment_ids(s) for s, i, j in zip(segments, [0, *stop.tolist()], stop.tolist())]

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` of pairs; a slot remembers twice the key of the last pair that met it, and one more if it was stable."""
        key = a << 20 | b
        found = self.known[_slots(key, PAIR_BITS)]
        ok, new = found & 1 == 1, np.flatnonzero(found >> 1 != key)
        if len(new):
            pairs, which = np.unique(key[new], return_inverse=True)
            got = np.array([self.stable(k >> 20, k & 0xFFFFF) for k in pairs.tolist()])
            ok[new] = got[which]
            self.known[_slots(pairs, PAIR_BITS)] = pairs << 1 | got
        return ok

    def _text(self, k: int) -> str:
        return self.m.text[k] if k >= 0 else chr(-1 - k)

    @staticmethod
    def _commit(out: list[int], last: list, back: list[int], base: int, end: int) -> None:
        got = []
        while end > base:
            got.append(last[end - base])
            end = back[end - base]
        out.extend(reversed(got))

    def segment_ids(self, segment: str) -> bytes:
        m, out = self.m, []
        for k in self.paths(segment):
            if k >= 0:
                out.append(k)
            elif m.byte:
                out.extend(m.byte[b] for b in chr(-1 - k).encode())
            elif not out or out[-1] != m.unknown:
                out.append(m.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; empty text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text) > PASS_CHARS:
                out += self._encode(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        m, prefix = self.m, SPACE if self.m.add_prefix else ""
        words = [self.segments.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        memo, older, long, aside = self.memo, self.older.get, {}, []
        for w in {w for some in words for w in some if w not in memo}:
            ids = older(w)
            if ids is not None:
                memo[w] = ids
            elif m.kind == "bpe" and len(w) <= 2 * m.longest:
                aside.append(w)
            else:
                (memo if len(w) <= MEMO_CHARS else long)[w] = self.segment_ids(w)
        for k in range(0, len(aside), SIDE_BY_SIDE):
            some = aside[k : k + SIDE_BY_SIDE]
            for w, ids in zip(some, self.windows(some)):
                (memo if len(w) <= MEMO_CHARS else long)[w] = ids
        known = (lambda w: memo[w] if w in memo else long[w]) if long else memo.__getitem__
        return [np.frombuffer(b"".join(map(known, some)), np.int32) if some else np.zeros(0, np.int32) for some in words]

    # -- decoding -------------------------------------------------------------------------------------------
    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_all([np.asarray(ids, np.int32)])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of lists of ids."""
        stops = np.cumsum([0, *map(len, ids)])
        if not stops[-1]:
            return [""] * len(ids)
        _, offsets, data = self.raw.take(pa.array(np.concatenate(ids))).buffers()
        ends, data, out = np.frombuffer(offsets, np.int64)[stops].tolist(), memoryview(data or b""), []
        for a, b in zip(ends, ends[1:]):
            text = str(data[a:b], "utf-8", "replace").replace(SPACE, " ")
            out.append(text[1:] if self.m.add_prefix and text.startswith(" ") else text)
        return out


_worker_codec: Codec | None = None


def _codec(model: PieceModel) -> Codec:
    """A worker keeps its codec, and so what it remembers, from one task to the next."""
    global _worker_codec
    if _worker_codec is None or _worker_codec.m.key != model.key:
        _worker_codec = Codec(model)
        release()
    return _worker_codec


def encode_pieces(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", rows_a_pass: int = 128) -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text; null and empty texts have no ids and decode to ''.

    Repeated rows give repeated rows; other columns are not read.  A literal U+2581 in a text stands for a
    space, as the model defines it, so it decodes to a space.
    """
    src, run = _source(docs, model_path, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(run.value)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_a_pass):
                part = batch.slice(k, rows_a_pass)
                ids = codec.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(codec.decode_all(ids), pa.string())], names=[id_col, "ids", "decoded"])
            batch = part = ids = None
            release()

    return src.mapInArrow(encoded, f"{id_col} {kind}, ids array<int>, decoded string")


def encoding_digest(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", rows_a_pass: int = 128) -> DataFrame:
    """(id, n_bytes, n_ids, ids_sha256, round_trip): the same encoding with the ids as a digest of little-endian int32.

    ``round_trip`` tells that decoding gives the text back (with U+2581 read as a space).
    """
    src, run = _source(docs, model_path, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(run.value)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_a_pass):
                part = batch.slice(k, rows_a_pass)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec.encode_all(texts)
                same = [x == t.replace(SPACE, " ") for x, t in zip(codec.decode_all(ids), texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array(same)],
                    names=[id_col, "n_bytes", "n_ids", "ids_sha256", "round_trip"],
                )
            batch = part = texts = ids = same = None
            release()

    return src.mapInArrow(digested, f"{id_col} {kind}, n_bytes bigint, n_ids bigint, ids_sha256 string, round_trip boolean")


def _source(docs: DataFrame, model_path: str, id_col: str, text_col: str):
    return docs.select(id_col, text_col), docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

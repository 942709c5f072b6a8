"""Token counts: rank-synchronous merging of byte pairs over ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte-level split pattern (fixed value of the vocabulary's pre-tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a worker, and the longest that is remembered; others are merged anew.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64
NO_RANK = np.int32(2**31 - 1)
#: A longer pre-token is merged alone: then only the neighbours of merged places are looked up again.
LONG_WORD = 2048


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable bytes are themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs as sorted numpy keys; small enough to broadcast whatever the data's size."""

    def __init__(self, vocab: dict[str, int], merges: list, specials: list[str]):
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.specials = sorted(specials, key=len, reverse=True)

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        return cls(model["model"]["vocab"], model["model"]["merges"], [t["content"] for t in model.get("added_tokens", [])])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word.  In each pass all words together merge their pair of lowest rank.

        Of overlapping equal pairs (as in ``aaa``) the leftmost are taken, as a left-to-right merge does.
        A merged symbol only takes part in pairs of a higher rank, so a pass is never undone by a later one.
        """
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        left = lengths.copy()
        alive = np.flatnonzero((lengths > 1) & (lengths <= LONG_WORD))
        for i in np.flatnonzero(lengths > LONG_WORD):
            left[i] = self.count_long(words[i])
        symbols = self.first[np.frombuffer(b"".join(words[i] for i in alive), dtype=np.uint8)]
        word = np.repeat(np.arange(len(alive)), lengths[alive])
        while len(alive):
            inner = word[:-1] == word[1:]
            rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
            at = np.flatnonzero(inner)
            rank[at] = self.rank(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inner])
            lowest = np.minimum.reduceat(rank, starts)
            pick = (rank == lowest[word]) & (rank < NO_RANK)
            begun = pick & ~np.r_[False, pick[:-1]]
            place = np.arange(len(symbols))
            since = place - np.maximum.accumulate(np.where(begun, place, 0))
            take = np.flatnonzero(pick & (since % 2 == 0))
            symbols[take] = self.made[rank[take]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[take + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)
            done = (lowest == NO_RANK) | (sizes == 1)
            left[alive[done]] = sizes[done]
            keep &= ~done[word]
            symbols, word = symbols[keep], word[keep]
            renumber = np.cumsum(~done) - 1
            alive, word = alive[~done], renumber[word]
        return left


    def count_long(self, word: bytes) -> int:
        """Symbols left of one long word: all its pairs of the lowest rank are merged at once, rank by rank.

        Places wait in lists by their pair's rank; a merge looks only at the two pairs beside it, so a place costs its own merges and no passes.
        """
        n = len(word)
        symbols = np.append(self.first[np.frombuffer(word, dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n is the end
        rank = np.full(n + 1, NO_RANK, dtype=np.int32)
        rank[: n - 1] = self.rank(symbols[: n - 1], symbols[1:n])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < NO_RANK]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            own = rank[places]
            edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(own) else np.zeros(1, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                r = int(own[i])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places[i:j])

        wait(np.arange(n))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]  # others have been merged since
            if not len(places):
                continue
            chained = np.r_[False, after[places[:-1]] == places[1:]]  # of a run of overlapping pairs every second is taken
            at = np.arange(len(places))
            since = at - np.maximum.accumulate(np.where(chained, 0, at))
            take = places[since % 2 == 0]
            gone = after[take]
            beyond = after[gone]
            symbols[take], after[take] = self.made[r], beyond
            before[beyond] = take
            rank[gone] = NO_RANK
            left -= len(take)
            touched = np.unique(np.r_[take, before[take][before[take] >= 0]])
            follows = after[touched]
            inside = follows < n
            rank[touched] = NO_RANK
            rank[touched[inside]] = self.rank(symbols[touched[inside]], symbols[follows[inside]])
            wait(touched)
        return left


class TokenCounter:
    """Counts tokens of whole texts; remembers the counts of short pre-tokens."""

    def __init__(self, merges: MergeTable):
        self.merges, self.memo = merges, {}
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.split.findall(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        found = [self.pieces(t) for t in texts]
        memo = self.memo
        new = list(set().union(*(words for words, _ in found)).difference(memo))
        counts = self.merges.count([w.encode() for w in new]).tolist() if new else []
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(set().union(*(words for words, _ in found)))
            counts = self.merges.count([w.encode() for w in new]).tolist()
        memo.update(zip(new, counts))
        totals = [sum(map(memo.__getitem__, words)) + extra for words, extra in found]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return totals


def count_tokens(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, rows_a_pass: int = 256) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text under a byte-level pair-merge vocabulary file.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated rows;
    other columns are not read.  A special string inside a text counts as one token.  The vocabulary is
    read on the driver and broadcast (a fixed-size table); texts are worked through in small passes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable.load(vocab_path))
    src = docs.select(id_col, text_col)
    schema = f"{id_col} {src.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_a_pass):
                part = batch.slice(k, rows_a_pass)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return src.mapInArrow(counted, schema)

"""Token counts (operator 6): heap-and-linked-list byte-pair merging that emits no identifiers."""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text
from .piece_table import PieceTable, joined, mark_starts
from .pretokens import load_vocabulary, pre_tokenizer


class Counter:
    """Counts tokens of a vocabulary with word ends, whose pre-tokens are the library's and hold no white space."""

    def __init__(self, path: str, suffix: str = "</w>"):
        v = load_vocabulary(path)
        vocab, self.suffix = v["vocab"], suffix
        self.symbol = {s: i for s, i in vocab.items() if len(s.removesuffix(suffix)) <= 1}
        self.merges = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(v["merges"])}
        self.cut = pre_tokenizer(path)
        self.specials = sorted(v["specials"])
        self.split = re.compile("|".join(map(re.escape, self.specials))).split
        self.words, self.pieces = PieceTable(self._words, 1 << 19), PieceTable(self._pieces)

    def word(self, word: str) -> int:
        """Initial symbols less merges: pops the lowest rank, leftmost first, until no pair is left."""
        shown = list(word)
        shown[-1] += self.suffix
        ids = [self.symbol[c] for c in shown if c in self.symbol]
        n = left = len(ids)
        if n < 2:
            return n
        merges, before, after = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue
            ids[i], ids[j], left = made, -1, left - 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left

    def _words(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter((self.word(w.decode()) for w in new), np.uint32, len(new)), np.ones(len(new), np.int64)

    def _pieces(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of pieces that begin at white space or at a mark after a letter, from those of their words."""
        found = [self.cut(p.decode()) for p in new]
        counts, _ = self.words(*joined([w.encode() for ws in found for w in ws]))
        before = np.r_[0, np.cumsum(counts, dtype=np.int64)][np.cumsum([0, *map(len, found)])]
        return np.diff(before).astype(np.uint32), np.ones(len(new), np.int64)

    def __call__(self, texts: list[str]) -> list[int]:
        # special strings count one each, and part what is around them as white space does
        cut = [self.split(t) if any(s in t for s in self.specials) else [t] for t in texts]
        raw = [" ".join(ps).encode() for ps in cut]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.cumsum(sizes) - sizes
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        marks = np.r_[(buffer == 32) | (buffer == 10) | mark_starts(buffer), False]
        marks[bounds] = True
        starts = np.flatnonzero(marks[:-1])
        counts, _ = self.pieces(buffer, starts, np.r_[starts[1:], len(buffer)][: len(starts)])
        before = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        at = before[np.searchsorted(starts, np.r_[bounds, len(buffer)])]
        return [int(n) + len(ps) - 1 for n, ps in zip(np.diff(at), cut)]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, keep: list[str], text: str = "text", limit: int = 2048) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each whole text, without a shuffle.

    Null or empty texts count 0. Rows with null or repeated ids are counted each; an empty table gives an empty
    one; other columns are dropped. A special string inside a text counts as one token, as is the library's default.
    """

    def make():
        if path not in _counters:
            _counters[path] = Counter(path)
        count = _counters[path]

        def of(texts):
            n = count(texts)
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return of

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_text(docs, keep, fields, make, text)

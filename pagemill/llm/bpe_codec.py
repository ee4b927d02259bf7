"""BPE encoding and decoding (operator 4): batched numpy merge rounds over the symbols of many words at once."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text
from .piece_table import ByteEncoder, of_parts
from .pretokens import byte_letters, load_vocabulary, pre_tokenizer

NONE = np.int64(1 << 40)


class Merger:
    """Merges words of one flat symbol array in rounds.

    In each round, every word merges its lowest-rank adjacent pair: all its non-overlapping places from the left,
    or only the first where the new symbol could be part of a pair of still lower rank. Pairs are found by binary
    search over sorted pair keys (left * size + right). Finished words leave the working arrays.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values(), default=0) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int64), pairs[:, 2]
        lowest = np.full(self.size, NONE)
        ranks = np.arange(len(pairs))
        np.minimum.at(lowest, pairs[:, 0], ranks)
        np.minimum.at(lowest, pairs[:, 1], ranks)
        self.one_by_one = lowest[self.made] < ranks if len(pairs) else np.zeros(0, bool)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def __call__(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word) after all merges; word numbers ascend in both."""
        done_s, done_w = [], []
        s, w = symbols.astype(np.int64), word
        pair = np.full(len(s), NONE)  # rank of each symbol with the next of its word
        if len(s) > 1:
            same = np.flatnonzero(w[:-1] == w[1:])
            pair[same] = self.ranks(s[same], s[same + 1])
        while len(s):
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            low = np.minimum.reduceat(pair, starts)
            sizes = np.diff(np.r_[starts, len(s)])
            alive = np.repeat(low < NONE, sizes)
            if not alive.all():
                done_s.append(s[~alive])
                done_w.append(w[~alive])
                s, w, pair = s[alive], w[alive], pair[alive]
                keep = low < NONE
                low, sizes = low[keep], sizes[keep]
                if not len(s):
                    break
            lows = np.repeat(low, sizes)
            hit = np.flatnonzero(pair == lows)
            # overlapping places (a symbol paired with itself): every other one of a run, from the left
            run = np.r_[True, np.diff(hit) != 1]
            first = np.flatnonzero(run)
            odd = (np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))) % 2
            lead = np.r_[True, w[hit[1:]] != w[hit[:-1]]]
            hit = hit[(odd == 0) & (lead | ~self.one_by_one[lows[hit]])]
            s[hit] = self.made[lows[hit]]
            stay = np.ones(len(s), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            s, w, pair = s[stay], w[stay], pair[stay]
            at = moved[hit]
            for left in (at - 1, at):
                left = left[(left >= 0) & (left < len(s) - 1)]
                within = w[left] == w[left + 1]
                pair[left[within]] = self.ranks(s[left[within]], s[left[within] + 1])
            last = at[(at == len(s) - 1) | (w[np.minimum(at + 1, len(s) - 1)] != w[at])]
            pair[last] = NONE
        if not done_s:
            return s, w
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(w, kind="stable")
        return s[order], w[order]


class Codec:
    """encode(texts) -> arrays of ids; decode(ids) -> text. Equal to the public library's defaults on any text."""

    def __init__(self, path: str):
        v = load_vocabulary(path)
        letters = byte_letters()
        self.merger = Merger(v["vocab"], v["merges"])
        self.byte_id = np.array([v["vocab"][c] for c in letters], dtype=np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        top = max([*v["vocab"].values(), *v["specials"].values()]) + 1
        self.bytes_of = [b""] * top
        for token, i in [*v["vocab"].items(), *v["specials"].items()]:
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.cut, self.byte_of = pre_tokenizer(path), byte_of
        self.encode = ByteEncoder(self.of_pieces, v["specials"])

    def of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, how many each has), from those of their pre-tokens, each distinct one merged once."""
        return of_parts([[bytes(map(self.byte_of.__getitem__, w)) for w in self.cut(p.decode())] for p in pieces], self.words)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, how many each has)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ids, word = self.merger(symbols, np.repeat(np.arange(len(words)), lens))
        return ids.astype(np.uint32), np.bincount(word, minlength=len(words))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec, and so one cache of words, for each Python worker and vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and the ids of each whole text as array<int>.

    Null or empty texts: an empty array. Rows with null or repeated ids, and ties, are encoded each; an empty
    table gives an empty one; other columns of docs are dropped. No shuffle.
    """

    def make():
        c = codec(path)
        return lambda texts: [[x.astype(np.int32) for x in c.encode(texts)]]

    return map_text(docs, keep, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, text)


def round_trip(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of the decoded text."""

    def make():
        c = codec(path)
        names = [str(i) for i in range(len(c.bytes_of))]

        def of(texts):
            n, ids_sha, text_sha = [], [], []
            for x in c.encode(texts):
                ids = x.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return [n, ids_sha, text_sha]

        return of

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_text(docs, keep, fields, make, text)

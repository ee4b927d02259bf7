"""A table of short byte strings and what they encode to, looked up for whole batches in numpy.

Cutting texts into pieces, finding the pieces and laying out their values are array operations over one buffer of all
texts of a batch; only pieces that the table doesn't hold are made into Python objects. A piece of up to SHORT bytes is its
own key, as two numbers and its length; a longer one is kept as bytes. So equal entries are equal pieces whatever the
texts hold. A full table forgets its later half: frequent pieces come early.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Entries that a table holds; bytes of a piece that is its own key; the longest piece a table keeps; how many of over SHORT bytes.
ENTRIES, SHORT, LONGEST, LONG_ENTRIES = 1 << 20, 16, 48, 1 << 17
#: White space outside ASCII begins with these pairs of UTF-8 bytes (others begin with them too, which costs a cut only).
ODD_PAIRS = np.zeros(1 << 16, bool)
ODD_PAIRS[[0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = True
#: Bytes of ASCII letters, and of ASCII marks.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Bits of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def packed(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first SHORT bytes of each piece as two numbers, zero past its end."""
    padded = np.concatenate([buffer, np.zeros(SHORT, np.uint8)])
    at = np.ndarray((len(buffer) + 8,), "<u8", padded, 0, (1,))  # the number at every byte
    low = at[starts] & FIRST[np.minimum(sizes, 8)]
    return low, at[np.minimum(starts + 8, len(buffer))] & FIRST[np.clip(sizes - 8, 0, 8)]


class PieceTable:
    """fill(pieces) -> (values as one array, length of each piece's values); the table gives whole batches of them."""

    def __init__(self, fill: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES):
        self.fill, self.entries = fill, entries
        self.mask = (1 << (2 * entries - 1).bit_length()) - 1
        self.low, self.high, self.bytes = np.zeros(entries, np.uint64), np.zeros(entries, np.uint64), np.zeros(entries, np.uint8)
        self.long: dict[bytes, int] = {}
        self.entry = np.full(self.mask + 1, -1, np.int32)
        self.start, self.length = np.zeros(entries, np.int64), np.zeros(entries, np.int32)
        self.values, self.size, self.used = np.zeros(1 << 16, np.uint32), 0, 0

    def _halve(self) -> None:
        kept = self.used // 2
        self.size, self.used = int(self.start[kept]), kept
        self.long = {p: e for p, e in self.long.items() if e < kept}
        self.entry.fill(-1)
        self._put(np.flatnonzero(self.bytes[:kept] <= SHORT).astype(np.int32))

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (high >> np.uint64(31))) + size.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each short piece, or -1: linear probing, all open pieces a step at a time."""
        out = np.full(len(low), -1, np.int32)
        slot, open_ = self._slot(low, high, size), np.arange(len(low))
        while len(open_):
            e = self.entry[slot]
            same = (e >= 0) & (self.low[e] == low[open_]) & (self.high[e] == high[open_]) & (self.bytes[e] == size[open_])
            out[open_[same]] = e[same]
            more = (e >= 0) & ~same
            open_, slot = open_[more], (slot[more] + 1) & self.mask
        return out

    def _put(self, entries: np.ndarray) -> None:
        slot, open_ = self._slot(self.low[entries], self.high[entries], self.bytes[entries]), np.arange(len(entries))
        while len(open_):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entries[open_[free]]  # of several for one slot, the last stays
            won = self.entry[slot] == entries[open_]
            open_, slot = open_[~won], (slot[~won] + 1) & self.mask

    def __call__(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pieces in turn, how many each has)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes, raw = ends - starts, buffer.tobytes()
        low, high = packed(buffer, starts, sizes)
        found = np.full(len(starts), -1, np.int32)
        short = sizes <= SHORT
        found[short] = self._find(low[short], high[short], sizes[short])
        for i in np.flatnonzero(~short & (sizes <= LONGEST)).tolist():
            found[i] = self.long.get(raw[starts[i] : ends[i]], -1)
        lost = np.flatnonzero(found < 0)
        fresh: dict[bytes, int] = {}
        which = np.fromiter((fresh.setdefault(raw[a:b], len(fresh)) for a, b in zip(starts[lost].tolist(), ends[lost].tolist())), np.int64, len(lost))
        base = np.where(found >= 0, self.start[found], 0)
        length = np.where(found >= 0, self.length[found], 0).astype(np.int64)
        pool = self.values
        if fresh:
            values, lengths = self.fill(list(fresh))
            values, lengths = values.astype(np.uint32), lengths.astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            base[lost], length[lost] = self.size + begins[which], lengths[which]
            if self.size + len(values) <= len(pool):
                pool[self.size : self.size + len(values)] = values  # room that no entry uses yet
            else:
                pool = np.concatenate([pool[: self.size], values])
        total = np.cumsum(length)
        at = np.repeat(base - (total - length), length)
        at += np.arange(len(at))
        out = pool[at]
        if fresh:
            first = np.empty(len(fresh), np.int64)
            first[which[::-1]] = lost[::-1]
            self._add(list(fresh), low[first], high[first], values, begins, lengths)
        return out, length

    def _add(self, pieces: list[bytes], low, high, values, begins, lengths) -> None:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keep = np.flatnonzero(sizes <= LONGEST)
        over = keep[sizes[keep] > SHORT]
        if self.used + len(keep) > self.entries or len(self.long) + len(over) > LONG_ENTRIES:
            self._halve()
        over = over[max(0, LONG_ENTRIES - len(self.long)) :]
        keep = np.setdiff1d(keep, over, assume_unique=True)[: self.entries - self.used] if len(over) else keep[: self.entries - self.used]
        entries = np.arange(self.used, self.used + len(keep), dtype=np.int32)
        begins, lengths, sizes = begins[keep], lengths[keep], sizes[keep]
        total = int(lengths.sum())
        if self.size + total > len(self.values):
            self.values = np.concatenate([self.values[: self.size], np.zeros(2 * total + len(self.values) // 2, np.uint32)])
        ends = np.cumsum(lengths)
        self.values[self.size : self.size + total] = values[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)]
        self.start[entries], self.length[entries] = self.size + ends - lengths, lengths
        self.low[entries], self.high[entries], self.bytes[entries] = low[keep], high[keep], sizes
        self.size, self.used = self.size + total, self.used + len(keep)
        self.long.update((pieces[k], e) for k, e, n in zip(keep.tolist(), entries.tolist(), sizes.tolist()) if n > SHORT)
        self._put(entries[sizes <= SHORT])


def mark_starts(buffer: np.ndarray) -> np.ndarray:
    """Whether each byte is an ASCII mark after an ASCII letter: there a pre-token ends, in any pattern that keeps letters apart."""
    out = MARK[buffer]
    out[1:] &= LETTER[buffer[:-1]]
    out[:1] = False
    return out


def cuts(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of pieces in a buffer of UTF-8 texts that begin at bounds: the bounds, every single space between visible
    characters, and every mark after a letter. No pre-token of a byte-level pattern spans such a space, which begins the
    one after it, nor such a mark."""
    n = len(buffer)
    space = np.flatnonzero(buffer == 32)
    space = space[(space > 0) & (space < n - 1)]
    fine = (buffer[space - 1] > 32) & (buffer[space + 1] > 32)
    wide = np.flatnonzero(fine & ((buffer[space - 1] > 127) | (buffer[space + 1] > 127)))
    if len(wide):
        at = space[wide]
        pair = lambda i: ODD_PAIRS[(buffer[np.clip(i, 0, n - 1)].astype(np.uint16) << 8) | buffer[np.clip(i + 1, 0, n - 1)]]
        fine[wide] = ~(pair(at - 2) | pair(at - 3) | pair(at + 1))
    marks = np.r_[mark_starts(buffer), False]
    marks[space[fine]] = True
    marks[bounds] = True
    return np.flatnonzero(marks[:n])


class ByteEncoder:
    """Ids of whole texts under a byte-level vocabulary, by a table of pieces.

    encode(pieces as UTF-8) -> (ids of all, how many each has). Special strings become their own id.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], specials: dict[str, int], entries: int = ENTRIES):
        self.pieces, self.specials = PieceTable(encode, entries), specials
        self.split = re.compile("(" + "|".join(map(re.escape, specials)) + ")").split if specials else None

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.cumsum(sizes) - sizes
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        starts = cuts(buffer, bounds)
        ids, length = self.pieces(buffer, starts, np.r_[starts[1:], len(buffer)])
        before = np.r_[0, np.cumsum(length)]
        at = before[np.searchsorted(starts, np.r_[bounds, len(buffer)])]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        out = self._plain(["" if i in odd else t for i, t in enumerate(texts)])
        for i in odd:
            parts = [p for p in self.split(texts[i]) if p]
            plain = iter(self._plain([p for p in parts if p not in self.specials]))
            out[i] = np.concatenate([np.array([self.specials[p]], np.uint32) if p in self.specials else next(plain) for p in parts])
        return out


def of_parts(parts: list[list[bytes]], fill: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists of parts in turn, how many each list has), each distinct part being filled once."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(w, len(number)) for ws in parts for w in ws], np.int64)
    values, length = fill(list(number))
    own = length[which]
    ends = np.cumsum(own)
    at = np.repeat((np.cumsum(length) - length)[which] - (ends - own), own) + np.arange(own.sum())
    before = np.r_[0, ends][np.cumsum([0, *map(len, parts)])]
    return values[at], np.diff(before)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends) of byte strings laid end to end."""
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, ends][: len(ends)], ends

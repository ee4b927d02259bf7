"""Vocabulary files, their normal forms and pre-tokens, and a bounded cache of the words seen by a Python worker."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import islice

#: Pieces a worker remembers at most, and the longest that it does.
CACHE_PIECES, CACHE_CHARS = 400_000, 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """vocab (token to id), merges (pairs in rank order), specials (content to id) of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
    return {"vocab": j["model"]["vocab"], "merges": merges, "specials": {t["content"]: t["id"] for t in j["added_tokens"]}}


def pre_tokenizer(path: str) -> Callable[[str], list[str]]:
    """The pre-tokens of a text in the letters of a vocabulary file, after its normal form. Both are the public library's own,
    so that its Unicode tables hold whatever those of Python are."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    normal, cut = t.normalizer, t.pre_tokenizer
    if normal is None:
        return lambda text: [w for w, _ in cut.pre_tokenize_str(text)]
    return lambda text: [w for w, _ in cut.pre_tokenize_str(normal.normalize_str(text))]


class Cache:
    """A dict that forgets its later half when full: frequent pieces come early. ``fill(missing)`` gives values in order.

    A piece longer than CACHE_CHARS is computed and forgotten again, so memory stays bounded whatever the texts.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], limit: int = CACHE_PIECES):
        self.fill, self.limit, self.of = fill, limit, {}

    def __call__(self, pieces: Iterable[str]) -> dict:
        """A dict with the value of each of these pieces, and maybe others."""
        if len(self.of) > self.limit:
            self.of = dict(islice(self.of.items(), self.limit // 2))
        missing = [p for p in set(pieces) if p not in self.of]
        self.of.update(zip(missing, self.fill(missing)))
        return self.of

    def trim(self, pieces: Iterable[str]) -> None:
        for p in pieces:
            if len(p) > CACHE_CHARS:
                self.of.pop(p, None)

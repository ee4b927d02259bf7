"""Secret scans (operator 10): base patterns, and a linear-chain conditional random field that tags tokens as secret
begin, inside or outside, decoded by Viterbi."""

from __future__ import annotations

import pickle
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, removed, session, written
from .pretokens import Cache

#: Kinds in their order with pattern, the group whose length counts, and the least length.
BASE = (
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a run of fewer never grows into one of more
)
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "api", "key", "auth", "bearer", "credential", "private")
#: Whole tokens that stand before passwords, and before what looks like a key but is public.
TOLD = frozenset("pass pwd pw login ssh-rsa ssh-ed25519 ssh-dss base64 integrity watch checksum digest http https".split())
#: A run of what keys are made of, a run of other letters, or a single mark.
TOKEN = re.compile(r"[A-Za-z0-9+/_\-]+|[^\x00-\x7f]+|[^\sA-Za-z0-9+/_\-]")
#: Tags; hashed feature space; labelled documents that a model is fitted on at most, with and without a base match each.
O, B, I = 0, 1, 2
FEATURES, SAMPLE = 1 << 12, 500
#: Documents that base matches to fit on are looked for in, about; words whose bounds a worker remembers.
LOOKED, KNOWN = 20_000, 800_000
#: Bytes that weigh in the file's features.
CODE = "={};()"
#: Places whose tokens a token's features look at besides itself.
NEAR = (-3, -2, -1, 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by start and then kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind != "access" or "AKIA" in text:
            for m in pattern.finditer(text):
                if len(m.group(group)) >= least:
                    found.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{chr(97 + i): "a" for i in range(26)}, **{chr(65 + i): "A" for i in range(26)}, "/": "-", "+": "-", "_": "-"})
HEX, PREFIX = "0123456789abcdefABCDEF", re.compile(r"[A-Za-z]{2,6}[_-](?:[a-z]{2,6}[_-])?[A-Za-z0-9]{12}")
DIGEST = re.compile(r"(?i)sha(?:1|256|384|512)[-_]").match
NO_VOWELS = {ord(c): None for c in "aeiouAEIOU"}


def size_of(n: int) -> str:
    return "1" if n == 1 else "s" if n < 8 else "m" if n < 12 else "M" if n < 16 else "l" if n < 24 else "x" if n < 40 else "X"


def vowel_share(token: str, letters: int) -> str:
    if letters < 6:
        return "0"
    vowels = len(token) - len(token.translate(NO_VOWELS))
    return "l" if 8 * vowels < letters else "m" if 4 * vowels < letters else "h"


def variety(token: str, n: int) -> str:
    return "l" if 2 * len(set(token)) < min(n, 24) else "h"


def shape(token: str) -> list[str]:
    """What a token looks like: its character classes, length, changes between classes, and, unless it is a plain word, its
    variety and share of vowels."""
    n = len(token)
    if ord(token[0]) > 127:
        return ["other letters"]
    kinds = token.translate(SHAPES)
    digits, letters = kinds.count("d"), n - kinds.count("d") - kinds.count("-")
    size = size_of(n)
    vowels, many = ("0", "h") if letters == n and (n == 1 or token[1:].islower()) else (vowel_share(token, letters), variety(token, n))
    turns = sum(map(str.__ne__, kinds, kinds[1:]))
    classes = "".join(sorted(set(kinds)))
    mixed = "0" if not digits or digits == n else "l" if 8 * digits < n else "h"
    turny = "0" if not turns else "1" if turns < 3 else "2" if 4 * turns < n else "3"
    hexa = bool(letters and digits and not token.strip(HEX) and "-" not in kinds)
    out = [f"c{classes}", f"n{size}", f"m{mixed}{size}", f"t{turny}{size}", f"h{int(hexa)}{size}{mixed}", f"c{classes}{size}", f"v{vowels}{size}", f"u{many}{turny}{size}"]
    return out + ["prefix"] * bool(PREFIX.match(token)) + ["digest"] * bool(n > 20 and DIGEST(token)) + ["blob"] * token.startswith("AAAA")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & (FEATURES - 1)


def own_features(token: str) -> list[int]:
    return [_hash(f"own {s}") for s in shape(token)]


def neighbour_features(token: str, at: int) -> list[int]:
    """Of a token ``at`` places before (negative) or after the tagged one: a word that a secret often follows, a mark, or
    that it looks like a part of a key."""
    word = said(token)
    mark = token if len(token) == 1 and not token.isalnum() and ord(token) < 128 else ""
    big = abs(at) == 1 and BIG(token) is not None
    return [_hash(f"{at} {word}")] * bool(word) + [_hash(f"{at} {mark}")] * bool(mark) + [_hash(f"{at} big")] * big


BIG = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_\-]{16,}").match


def said(token: str) -> str:
    """The first of the words that a secret often follows, or the token itself where it tells as a whole."""
    low = token.lower()
    return next((w for w in WORDS if w in low), low if low in TOLD else "")


KEYED = re.compile("|".join(WORDS) + r"|(?<![a-z0-9+/_\-])(?:" + "|".join(sorted(TOLD)) + r")(?![a-z0-9+/_\-])", re.I).search


def file_feature(text: str) -> int:
    """Whether the file looks like code or settings rather than prose."""
    n = sum(map(text.count, CODE))
    return _hash(f"file {0 if 200 * n < len(text) else 1 if 50 * n < len(text) else 2}")


def sequence_features(tokens: list[str], file: int) -> list[list[int]]:
    return [
        [file, *own_features(t), *(f for d in NEAR if 0 <= i + d < len(tokens) for f in neighbour_features(tokens[i + d], d))] for i, t in enumerate(tokens)
    ]


@dataclass
class Model:
    """emit[feature, tag] and step[tag, next tag]."""

    emit: np.ndarray
    step: np.ndarray

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a sequence that lies between outside tokens."""
        best, back = scores[0] + self.step[O], []
        for s in scores[1:]:
            to = best[:, None] + self.step
            back.append(to.argmax(axis=0))
            best = to.max(axis=0) + s
        tag = int((best + self.step[:, O]).argmax())
        tags = [tag]
        for b in reversed(back):
            tags.append(tag := int(b[tag]))
        return tags[::-1]


class Scanner:
    """spans(texts): what Viterbi tags in whole texts.

    A tagged run of the best path gains over leaving all of it outside. What a token can gain has a bound: its own, file and
    neighbour scores and the best transition within a run. Bounds are remembered by word (a run of visible characters). A
    word through which no run's bounds sum to a gain is outside on the best path: such words are found over the whole text
    by running sums, and the dynamic programme runs on all stretches between them, which gives the best path of the
    whole text.
    """

    def __init__(self, model: Model, known: int = KNOWN):
        self.model, step = model, model.step
        self.over = model.emit[:, [B, I]].max(axis=1) - model.emit[:, O]
        self.inner = float(step[1:, 1:].max() - step[O, O])
        self.least = -float(step[O, 1:].max() + step[1:, O].max() - 2 * step[O, O] - self.inner) - 1e-6
        self.marks = {}
        self.shapes: dict = {}
        self.bounds = Cache(lambda new: [self._word(w) for w in new], known)

    def _token(self, t: str) -> float:
        """The most that a token gains by itself."""
        rest, n = t[1:], len(t)
        if n == 1:
            key = t
        elif rest.isascii() and rest.isalpha() and rest.islower() and t.isascii() and t.isalpha():  # all that shape() looks at
            key = t[0].islower(), size_of(n)
        else:
            key = None
        if (v := self.shapes.get(key)) is None:
            e = self.model.emit[own_features(t)].sum(axis=0)
            v = float(max(e[B], e[I]) - e[O]) + self.inner
            if key is not None:
                self.shapes[key] = v
        return v

    def _word(self, word: str) -> complex:
        """The most that a run of the word's tokens gains by itself, and the most that they add to what is near them."""
        best = run = -1e9
        lent, plain = 0.0, not KEYED(word)
        for t in TOKEN.findall(word):
            run = max(run, 0.0) + self._token(t)
            best = max(best, run)
            if not (plain and t.isalpha()):
                lent += self._lends(t)
        return complex(best, lent)

    def _lends(self, token: str) -> float:
        key = token if len(token) == 1 else (said(token), BIG(token) is not None)
        if key not in self.marks:
            self.marks[key] = sum(max(0.0, float(self.over[neighbour_features(token, d)].clip(0).sum())) for d in NEAR)
        return self.marks[key]

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        every = {w for ws in split for w in ws}
        bounds = self.bounds(every).__getitem__
        out = [self._text(t, ws, np.fromiter(map(bounds, ws), complex, len(ws))) for t, ws in zip(texts, split)]
        self.bounds.trim(every)
        return out

    def _text(self, text: str, words: list[str], bounds: np.ndarray) -> list[tuple[int, int]]:
        full = np.flatnonzero(bounds.real > -1e8)
        if not len(full):
            return []
        file = file_feature(text)
        near = bounds.imag[full]
        gain = bounds.real[full] + np.convolve(near, np.ones(5))[1 : 1 + len(near)] + max(0.0, float(self.over[file]))  # itself, 3 before, 1 after
        sums = np.cumsum(gain)
        before, after = sums - np.minimum.accumulate(np.r_[0.0, sums[:-1]]), np.maximum.accumulate(sums[::-1])[::-1] - sums + gain
        live = np.flatnonzero(before + after - gain > self.least)  # the best sum of a run through each word
        if not len(live):
            return []
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        out = []
        cut = np.flatnonzero(np.diff(live) > 1)
        for lo, hi in zip(live[np.r_[0, cut + 1]].tolist(), live[np.r_[cut, len(live) - 1]].tolist()):
            at = lambda k: int(starts[full[k]])
            end = int(starts[full[hi] + 1]) - 1
            got = list(TOKEN.finditer(text, at(lo), end))
            back = TOKEN.findall(text, at(max(0, lo - 3)), at(lo))[-3:]
            more = TOKEN.findall(text, end, int(starts[full[hi + 1] + 1]) - 1)[:1] if hi + 1 < len(full) else []
            fs = sequence_features([*back, *(m.group() for m in got), *more], file)[len(back) :]
            span = None
            for m, tag in zip(got, self.model.viterbi(np.array([self.model.emit[f].sum(axis=0) for f in fs[: len(got)]]))):
                if tag == I and span:
                    span = (span[0], m.end())
                    continue
                if span:
                    out.append(span)
                span = m.span() if tag != O else None
            if span:
                out.append(span)
        return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"
B62 = LETTERS + LETTERS.upper() + "0123456789"


def made_up(rng: random.Random, words: list[str]) -> tuple[list[tuple[str, bool]], ...]:
    """Three short passages of (text, whether secret): a key of a common form where the base patterns miss it, something that
    looks a little like one but isn't, from words of the document, and a key, number or digest that is public where it stands."""
    of = lambda letters, lo, hi=None: "".join(rng.choices(letters, k=rng.randint(lo, hi or lo)))
    said = rng.choice(["client_secret", "secret", "the token", "auth", "access_token", "password", "private key", "credentials", "api key", "bearer"])
    pick = lambda: rng.choice(words)
    link = rng.choice([" ", " is ", " to be ", ": ", " = ", ' "', " -> ", " of ", "\n"])
    forms = [
        [(f"{said}{link}", False), (of(B62, 10, 44), True)],
        [(f"{said}{link}", False), (of(B62 + "+/", 36, 64), True)],
        [(f"aws_secret_access_key{rng.choice([' = ', '=', ': '])}", False), (of(B62 + "+/", 40), True)],
        [(rng.choice(["Authorization: Bearer ", "bearer ", "", "jwt "]), False), (f"eyJ{of(B62 + '_-', 15, 40)}.eyJ{of(B62 + '_-', 20, 90)}.{of(B62 + '_-', 27, 60)}", True)],
        [("", False), (f"{of(LETTERS, 2, 4)}{rng.choice('_-')}{rng.choice(['', 'live_', 'test_', 'proj-', 'pat_'])}{of(B62, 20, 40)}", True)],
        [(rng.choice(["", f"{said}{link}"]), False), (of("0123456789ABCDEF", rng.choice([32, 40, 64])), True)],
        [(rng.choice(["-----BEGIN PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE KEY-----\n"]), False), ("\n".join(of(B62 + "+/", 64) for _ in range(rng.randint(1, 4))), True), ("\n-----END", False)],
        [("", False), (of(B62, 32, 64), True)],
        [(f"{pick()}://{pick()}:", False), (of(B62, 8, 20), True), (f"@{pick()}.{rng.choice(['example.com', 'internal', 'local'])}{rng.choice(['', ':5432'])}/{pick()}", False)],
        [(f"{rng.choice(['', pick() + ' '])}{rng.choice(['pass', 'pwd', 'pw', 'login'])}{rng.choice([': ', '=', ' = ', ' is '])}", False), (of(B62, 8, 16), True)],
    ]
    plain = [
        f"{of('0123456789abcdef', 8)}-{of('0123456789abcdef', 4)}-4{of('0123456789abcdef', 3)}-a{of('0123456789abcdef', 3)}-{of('0123456789abcdef', 12)}",
        "_".join(pick() for _ in range(rng.randint(2, 5))), "-".join(pick() for _ in range(rng.randint(2, 5))), "/".join(pick() for _ in range(rng.randint(2, 5))) + of("0123456789", 0, 4),
        *(first + "".join(pick().capitalize() for _ in range(rng.randint(2, 5))) + of("0123456789", 0, 2) for first in ("", pick().lower())), of("0123456789", 3, 20), "".join(pick() for _ in range(rng.randint(2, 4))),
        f"20{of('0123456789', 2)}-0{of('123456789', 1)}-1{of('0123456789', 1)}{rng.choice('T ')}{of('01', 1)}{of('0123456789', 1)}:{of('012345', 1)}{of('0123456789', 1)}:{of('012345', 1)}{of('0123456789', 1)}{rng.choice(['', 'Z', '+01:00', '.123Z'])}",
        f"{rng.choice([pick(), 'localhost'])}:{of('0123456789', 2, 5)}", f"{pick()}: {pick()}{of('0123456789', 1, 3)}", f"{pick()}{of('0123456789', 1, 4)}@{pick()}.example.com", ".".join(of("123456789", 1, 3) for _ in range(4)),
        f"http://{pick()}.example.org/{pick()}/{of('0123456789', 1, 6)}?{pick()}={pick()}", pick().upper() * 2, f"/{pick()}/{pick()}{of('0123456789', 1)}.{of('0123456789', 2)}/{pick()}-{pick()}/{pick()}", f"v{of('0123456789', 1)}.{of('0123456789', 1, 2)}.{of('0123456789', 1)}{rng.choice(['', '-', '-' + pick() + '2'])}", f"the {said} of {pick()}.",
    ]
    marks = [rng.choice("!$%#&*?.:") * rng.randint(1, 3) for _ in range(4)]
    loud = f"{pick().capitalize()}{marks[0]} {pick()}{marks[1]} {pick().upper()}{marks[2]}{rng.choice([' ', ''])}{pick()}{marks[3]}"
    public = [
        f"http{rng.choice(['', 's'])}://{rng.choice(['www.', ''])}{pick()}.com/{rng.choice(['watch', pick()])}?{rng.choice(['v', 'id', pick()])}={of(B62 + '_-', 8, 14)}&{rng.choice(['list', pick()])}={of(B62 + '_-', 12, 34)}",
        f"https://{pick()}.com/{pick()}/{of(B62, 10, 22)}/{pick()}", f"{rng.choice(['ssh-rsa', 'ssh-ed25519'])} AAAA{of(B62 + '+/', 60, 200)}{rng.choice(['', '=='])} {pick()}@{pick()}",
        f'{rng.choice(["integrity=", ""])}"sha{rng.choice([256, 384, 512])}-{of(B62 + "+/", 43, 86)}{rng.choice(["", "="])}"', f"data:image/{rng.choice(['png', 'gif', 'svg+xml'])};base64,{of(B62 + '+/', 40, 300)}{rng.choice(['', '=='])}",
        f"{pick()}-{of('0123456789', 1, 3)}.{of('0123456789', 1)}.{of('0123456789', 1)}-{pick()}-{rng.choice(['x86_64', 'arm64', 'amd64'])}-{of('0123456789', 8)}-{of('0123456789abcdef', 7, 8)}.tar.gz", f"{pick()}.{of('0123456789abcdef', 8)}.min.js",
        f"{pick()}-{pick()}-{of('0123456789abcdef', 8, 10)}-{of(LETTERS + '0123456789', 5)}",
    ]
    return rng.choice(forms), [(rng.choice([*plain, loud, loud]), False)], [(rng.choice(public), False)]


def _examples(text: str, context: int = 12, spread: int = 3, odd: int = 5, most: int = 20, made: int = 2) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Feature sequences and tags around ``most`` base matches, labelled by the base; around ``spread`` places and ``odd`` words
    that aren't prose; and of made-up keys of other forms among words of the text, each with two counterparts that are none."""
    file, tokens = file_feature(text), list(TOKEN.finditer(text))
    tags = np.zeros(len(tokens), int)
    starts = np.array([m.start() for m in tokens])
    spans = [m.span(group) for _, pattern, group, least in BASE for m in pattern.finditer(text) if len(m.group(group)) >= least]
    rng = random.Random(zlib.crc32(text.encode()))
    hits = []
    for a, b in sorted(spans):
        lo, hi = np.searchsorted(starts, [a, b])
        if hi > lo and not tags[lo:hi].any():
            tags[lo:hi] = I
            tags[lo] = B
            hits.append(int(lo))
    strange = [i for i, m in enumerate(tokens) if len(m.group()) > 3 and not m.group()[1:].islower() and not tags[i] and not BIG(m.group())]
    some = lambda xs, k: sorted(rng.sample(xs, min(k, len(xs))))
    centres = some(range(len(tokens)), spread) + some(hits, most) + some(strange, odd)
    xs, ys = [], []
    for c in centres:
        lo, hi = max(0, c - context), min(len(tokens), c + context + 4)
        cut = max(0, lo - 3)
        xs.append(sequence_features([m.group() for m in tokens[cut : hi + 1]], file)[lo - cut : hi - cut])
        ys.append(tags[lo:hi].tolist())
    words = [w for w in re.findall("[A-Za-z]{2,12}", text[:20_000])] or ["word"]
    for passage in [x for _ in range(made) for x in made_up(rng, words)]:
        ts, marked = [], []
        for part, secret in [(" ".join(rng.choices(words, k=8)) + " ", False), *passage, (" " + " ".join(rng.choices(words, k=4)), False)]:
            found = TOKEN.findall(part)
            marked += [B, *[I] * (len(found) - 1)] if secret else [O] * len(found)
            ts += found
        xs.append(sequence_features(ts, file))
        ys.append(marked)
    return xs, ys


def fit(xs: list[list[list[int]]], ys: list[list[int]], steps: int = 80, rate: float = 0.15, l2: float = 1e-4) -> Model:
    """Gradient steps (Adam) on the conditional likelihood; forward and backward sums run over all sequences at once."""
    emit, step = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    if not xs:
        return Model(emit - np.array([0, 3.0, 3.0]) / 8, step)
    n, length, width = len(xs), max(map(len, xs)), max(len(f) for x in xs for f in x)
    on = np.arange(length) < np.array([len(x) for x in xs])[:, None]
    f = np.full((int(on.sum()), width), FEATURES)  # a row for each token of the sequences, in turn
    for k, fs in enumerate(fs for x in xs for fs in x):
        f[k, : len(fs)] = fs
    y = np.zeros((n, length), int)
    y[on] = [t for ts in ys for t in ts]
    f, kind = np.unique(f, axis=0, return_inverse=True)  # tokens alike in all features are scored once
    kind = kind.ravel()
    used, f = np.unique(f, return_inverse=True)
    f = f.reshape(-1, width)
    pad = len(used) - 1 if used[-1] == FEATURES else len(used)
    v, tags = np.zeros((len(used) + 1, 3)), np.eye(3)[y] * on[..., None]
    flat, true = f.ravel(), (tags[:, :-1] * on[:, 1:, None]).reshape(-1, 3).T @ tags[:, 1:].reshape(-1, 3)
    whole = lambda x: (x[..., 0] + x[..., 1] + x[..., 2])[..., None]
    moments = [np.zeros_like(v), np.zeros_like(v), np.zeros((3, 3)), np.zeros((3, 3))]
    for t in range(1, steps + 1):
        v[pad] = 0
        s = np.zeros((n, length, 3))
        s[on] = v[f].sum(axis=1)[kind]
        es, e = np.exp(s - s.max(axis=2, keepdims=True)), np.exp(step - step.max())
        fwd, bwd = np.ones((n, length, 3)), np.ones((n, length, 3))  # up to a factor for each place
        fwd[:, 0] = es[:, 0]
        for i in range(1, length):
            z = (fwd[:, i - 1] @ e) * es[:, i]
            fwd[:, i] = np.where(on[:, i, None], z / whole(z), fwd[:, i - 1])
        for i in range(length - 2, -1, -1):
            z = (es[:, i + 1] * bwd[:, i + 1]) @ e.T
            bwd[:, i] = np.where(on[:, i + 1, None], z / whole(z), 1.0)
        p = fwd * bwd
        p *= on[..., None] / whole(p)
        left, right = fwd[:, :-1], (es * bwd)[:, 1:]
        left = left * (on[:, 1:, None] / whole((left @ e) * right))
        both = e * (left.reshape(-1, 3).T @ right.reshape(-1, 3))
        off = [np.bincount(kind, weights=(p - tags)[on][:, c], minlength=len(f)) for c in range(3)]
        dv = np.stack([np.bincount(flat, weights=np.repeat(x, width), minlength=len(v)) for x in off], axis=1) / n + l2 * v
        ds = (both - true) / n + l2 * step
        for k, (w, g) in enumerate(((v, dv), (step, ds))):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    v[pad] = 0
    keep = used < FEATURES
    emit[used[keep]] = v[: len(used)][keep]
    return Model(emit, step)


def train(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits a model on at most ``sample`` documents with a base match and as many without, the first by a hash of id and text, out
    of about LOOKED documents (all of a smaller table) that the hash picks.

    The base matches of the whole texts are labels, and so are made-up keys of other common forms in words of the texts,
    so that shape and neighbours must tell. Stretches of tokens around them and a few other places of each text are all that
    comes to the driver. Null texts are empty, rows of equal id and text count once, null ids are rows like any other; an
    empty table gives a model that tags nothing much: its scores are fixed.
    """
    spark = session(docs)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    order = F.xxhash64(F.col(f"`{doc_id}`"), F.xxhash64(t))
    like = r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"
    cells = 1 << 20
    share = int(cells * min(1.0, LOOKED / max(1, docs.count())))
    looked = docs.select(order.alias("h"), t.alias("text")).where(F.pmod("h", F.lit(cells)) <= share)
    seen = written(looked.groupBy("h").agg(F.first("text").alias("text")).withColumn("hit", F.col("text").rlike(like)))
    chosen = [r.h for hit in (True, False) for r in seen.where(F.col("hit") == hit).select("h").orderBy("h").limit(sample).collect()]
    if not chosen:
        return fit([], [])
    picked = F.broadcast(spark.createDataFrame([(h,) for h in chosen], "h long"))  # 2 * sample rows at most
    texts = seen.select("h", "text").join(picked, "h")

    def make():
        return lambda texts: [[pickle.dumps(_examples(t)) for t in texts]]

    xs, ys = [], []
    found = sorted(map_text(texts, ["h"], [T.StructField("x", T.BinaryType())], make).collect())
    removed(seen)
    for r in found:
        x, y = pickle.loads(r.x)
        xs += x
        ys += y
    return fit(xs, ys)


def outside(text: str, tagged: list[tuple[int, int]], found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of tagged runs that no base span covers, without white space at their ends, by a merge of the sorted lists."""
    out, base, k = [], sorted((x, y) for _, x, y in found), 0
    for a, b in sorted(tagged):
        while k < len(base) and base[k][1] <= a:
            k += 1
        j, parts = k, []
        while j < len(base) and base[j][0] < b:
            parts.append((a, base[j][0]))
            a, j = max(a, base[j][1]), j + 1
        for x, y in [*parts, (a, b)]:
            part = text[x:y]
            if part.strip():
                out.append((x + len(part) - len(part.lstrip()), y - len(part) + len(part.rstrip())))
    return out


def scan(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and spans array<struct<kind, start, end>> of each whole text, in one narrow stage: all base matches, and
    what the model tags beside them (kind crf, those parts of a run that no base match covers), by start.

    Positions are code points, the end exclusive. Null or empty texts have none. Repeated rows and null ids are scanned
    each; an empty table gives an empty one; other columns are dropped.
    """
    known = session(docs).sparkContext.broadcast(model)

    def make():
        scanner = Scanner(known.value)

        def of(texts):
            out = []
            for t, tagged in zip(texts, scanner(texts)):
                found = base_spans(t)
                more = [("crf", a, b) for a, b in outside(t, tagged, found)]
                spans = sorted(found + more, key=lambda s: (s[1], KINDS[s[0]]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            return [out]

        return of

    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return map_text(docs, keep, [T.StructField("spans", T.ArrayType(kind))], make, text)


KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end joined by commas) of scanned rows.
    A row without spans has counts of 0 and the digest of an empty string; rows are kept each, an empty table gives an empty one."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "crf")
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return scanned.select(*keep, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model: Model, keep: list[str], text: str = "text", mark: str = "[SECRET]", remember: int = KNOWN // 2) -> DataFrame:
    """``keep`` and redacted: each whole text with its spans, merged where they overlap, replaced by a mark.

    A null text is an empty one; texts without spans stay as they are; repeated rows and null ids are kept each; an empty table
    gives an empty one; other columns are dropped, and one named redacted can't be kept (ValueError). ``remember`` bounds the words a
    worker holds: half of scan()'s, as workers of a pipeline hold tables of its other stages too.
    """
    known = session(docs).sparkContext.broadcast(model)

    def make():
        scanner = Scanner(known.value, remember)

        def of(texts):
            out = []
            for t, tagged in zip(texts, scanner(texts)):
                spans = sorted([(a, b) for _, a, b in base_spans(t)] + tagged)
                got, at = [], 0
                for a, b in spans:
                    if a >= at:
                        got += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join(got) + t[at:] if spans else t)
            return [out]

        return of

    return map_text(docs, keep, [T.StructField("redacted", T.StringType())], make, text)

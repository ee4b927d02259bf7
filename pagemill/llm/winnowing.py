"""Document fingerprints (operator 9): winnowing of rolling k-gram hashes, with positions."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_ranges, map_text, session

#: Characters of a gram and grams of a window: texts that share K + WINDOW - 1 characters share a fingerprint hash.
K, WINDOW = 12, 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """A 64-bit polynomial hash, mixed at the end, of each run of k code points; one of the whole text if it is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.zeros(0, np.uint64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + codes[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the least hash of each window, the rightmost of equals; fewer grams: of all of them."""
    h = gram_hashes(text, k)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    window = min(window, len(h))
    least, at, width = h >> np.uint64(32), np.arange(len(h)), 1
    while width < window:  # windows of width and of width later make one of up to twice the width
        step = min(width, window - width)
        n = len(least) - step
        right = least[step:] <= least[:n]
        least, at = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n])
        width += step
    at = at[np.r_[True, np.diff(at) > 0]]
    return (h[at] >> np.uint64(32)).astype(np.uint32), at


def packed(hashes: np.ndarray, at: np.ndarray) -> str:
    """Base64 of the fingerprint: 5 bytes for each hash, its value (big-endian) and the distance from the position before."""
    out = np.empty((len(hashes), 5), np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(at, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a packed fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 5)
    return raw[:, :4].copy().view(">u4").ravel().astype(np.uint32), np.cumsum(raw[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's measure of two sorted arrays of distinct hashes; 1 where both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, keep: list[str], text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``keep``, hashes array<long> and positions array<int> of each whole text, in one narrow stage.

    Null or empty texts: empty arrays; texts shorter than a gram or a window: the hash of the whole, the least of
    all. Repeated rows and null ids are kept each, an empty table gives an empty one, other columns are dropped.
    """

    def make():
        def of(texts):
            got = [winnow(t, k, window) for t in texts]
            return [[h.astype(np.int64) for h, _ in got], [p.astype(np.int32) for _, p in got]]

        return of

    fields = [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]
    return map_text(docs, keep, fields, make, text)


def matches(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(hash, doc_a, at_a, doc_b, at_b): each place of a hash linked to the first document that has it, so a hash that
    very many share makes one row a place and not all pairs. Rows that repeat an id are one document, null ids one of their own
    that nothing links to; documents without hashes and empty tables give no rows; other columns are dropped."""
    at = prints.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc"), F.explode(F.arrays_zip("hashes", "positions")).alias("x")).select("doc", F.col("x.hashes").alias("hash"), F.col("x.positions").alias("at"))
    first = at.groupBy("hash").agg(F.min(F.struct("doc", "at")).alias("f"), F.count_distinct("doc").alias("n")).where("n > 1")
    return at.join(first, "hash").where("doc <> f.doc").select("hash", F.col("f.doc").alias("doc_a"), F.col("f.at").alias("at_a"), F.col("doc").alias("doc_b"), F.col("at").alias("at_b"))


def _compare(k: int, window: int):
    """Over rows in descending order of ids, the last being that of the next part (context): each with the next one's text."""

    def run(batches):
        held, first = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                if first is None:
                    first = row[1]
                if held is not None and held[2] == 0:
                    out.append(made(held[0], held[1], row[1]))
                if held is None or held[2] == 0:
                    held = row
            if out:
                yield table(out)
        if held is not None and held[2] == 0:
            yield table([made(held[0], held[1], first)])

    last: list = [None, None]

    def prints(text):
        if last[0] != text:
            h, at = winnow(text, k, window)
            last[:] = text, (packed(h, at), np.unique(h))
        return last[1]

    def made(doc_id, text, following):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, own_set = prints(text)
        _, next_set = prints(following)
        h, at = winnow(edited, k, window)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, len(text), sha, own, packed(h, at), likeness(own_set, np.unique(h)), likeness(own_set, next_set)

    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=NAMES)

    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """A row for each document: its fingerprint, that of its text with the latter half replaced by the start of the
    next document (descending ids, the first after the last), and how like the first is to the edited and the next one's.

    Documents go to ranges of ids in one shuffle of the texts. The bounds are ids that occur, so the document that
    a range needs from the next one is known before: it is sent to both. Null texts are empty; null ids are last;
    rows of one id follow each other by a hash of their texts. A table of one row is its own next. An empty
    table gives an empty one.
    """
    session(docs)
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    src = src.withColumn("g", F.bitwise_not(F.xxhash64("text")))
    parts, code = id_ranges(src, "doc_id", "g")
    sent = F.array(F.struct("part", F.lit(0).alias("context")))
    also = F.array(F.struct("part", F.lit(0).alias("context")), F.struct(((F.col("part") + 1) % parts).alias("part"), F.lit(1).alias("context")))
    rows = src.withColumn("range", code).withColumn("part", F.shiftright("range", 1))
    if parts > 1:
        rows = rows.withColumn("to", F.explode(F.when(F.col("range") % 2 == 1, also).otherwise(sent))).select("doc_id", "text", "g", F.col("to.context").alias("context"), F.col("to.part").alias("part"))
    else:
        rows = rows.withColumn("context", F.lit(0))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("context", F.col("doc_id").desc_nulls_last(), F.col("g").desc())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "context").mapInArrow(_compare(k, window), schema)

"""Token-ID files (operator 2): static range asymmetric numeral system with shared frequency tables.

A token file set is a folder with

- ``freqs``: Parquet of (token, freq): one table shared by all blocks, scaled to 2**SCALE;
- ``blocks``: Parquet of (part, part_start, n_tokens, blob): independent blocks of whole documents in ascending
  document order, ``part`` ascending with the documents and ``part_start`` the ids before the block in its part.

A blob is little-endian: HEAD (magic, documents, tokens, lanes, steps between checkpoints, checkpoints, words, CRC-32
of the ids, CRC-32 of the rest of the blob), document ids (int64, with a validity byte each), document lengths (int64),
the lanes' states of each checkpoint (uint64), the word offset of each checkpoint (uint32) and the words (uint32).
Symbol k of a block belongs to lane k % lanes. Checkpoint 0 is the start; a decoder may begin at any.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_ranges, removed, session, shared_dir, written
from .piece_table import ByteEncoder, cuts, joined
from .pretokens import load_vocabulary

SCALE, LOW = 20, 31
MASK = np.uint64((1 << SCALE) - 1)
LANES, STRIDE, BLOCK = 2048, 64, 1 << 19
#: Pieces that the library encodes as one text at most; pieces that a worker remembers.
RUN, ENTRIES = 2000, 1 << 21
HEAD, MAGIC = struct.Struct("<4sIQIIIIII"), b"PMR1"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, at least 1 for every token that occurs."""
    total, seen = int(counts.sum()), np.flatnonzero(counts)
    if len(seen) > 1 << scale:
        raise ValueError("more tokens than the frequency table has room for")
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    out[seen] = np.maximum(1, counts[seen].astype(object) * (1 << scale) // total)
    over = int(out.sum()) - (1 << scale)
    for i in seen[np.argsort(-out[seen], kind="stable")]:  # most frequent first
        if over <= 0:
            break
        cut = min(over, int(out[i]) - 1)
        out[i] -= cut
        over -= cut
    out[int(np.argmax(out))] -= min(over, 0)
    return out


class Coder:
    """Encodes and decodes blocks under one frequency table; all lanes of a step in one numpy operation."""

    def __init__(self, freqs: np.ndarray):
        self.freq = freqs.astype(np.uint64)
        self.start = np.r_[0, np.cumsum(freqs)[:-1]].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)

    def encode(self, ids: np.ndarray, lanes: int = LANES, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, offsets, words) of the checkpoints and the stream."""
        n, steps = len(ids), -(-len(ids) // lanes)
        f, c = self.freq[ids], self.start[ids]
        limit = f << np.uint64(LOW - SCALE + 32)
        x, words, states = np.full(lanes, 1 << LOW, np.uint64), [None] * steps, {}
        low32, shift, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            y = x[: b - a]
            out = np.flatnonzero(y >= limit[a:b])
            words[t] = (y[out] & low32).astype(np.uint32)
            y[out] >>= shift
            q = y // f[a:b]
            x[: b - a] = (q << scale) + (y - q * f[a:b]) + c[a:b]
            if t % stride == 0:
                states[t] = x.copy()
        if not steps:
            states[0] = x
        before = np.cumsum([0, *map(len, words)])
        marks = sorted(states)
        return np.stack([states[t] for t in marks]), before[marks].astype(np.uint32), np.concatenate([np.zeros(0, np.uint32), *words])

    def decode(self, n: int, states: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: int = 0, last: int | None = None, stride: int = STRIDE) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (or the end)."""
        lanes = states.shape[1]
        end = n if last is None or last >= len(states) else min(n, last * stride * lanes)
        begin, x, at = first * stride * lanes, states[first].copy(), int(offsets[first])
        out = np.empty(max(0, end - begin), np.uint32)
        wide, low, shift, scale = words.astype(np.uint64), np.uint64(1 << LOW), np.uint64(32), np.uint64(SCALE)
        for a in range(0, len(out), lanes):
            b = min(len(out), a + lanes)
            y = x[: b - a]
            slot = y & MASK
            s = self.symbol[slot.astype(np.int64)]
            out[a:b] = s
            y = self.freq[s] * (y >> scale) + slot - self.start[s]
            short = np.flatnonzero(y < low)
            y[short] = (y[short] << shift) | wide[at : at + len(short)]
            at += len(short)
            x[: b - a] = y
        return out


def pack(coder: Coder, doc_ids: list[int | None], ids: list[np.ndarray], lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """The blob of a block of whole documents."""
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    states, offsets, words = coder.encode(flat, lanes, stride)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join(
        x.tobytes() for x in (np.array([d or 0 for d in doc_ids], np.int64), known, np.array([len(x) for x in ids], np.int64), states, offsets, words)
    )
    return HEAD.pack(MAGIC, len(ids), len(flat), lanes, stride, len(states), len(words), zlib.crc32(flat.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpack(coder: Coder, blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a blob; ValueError where a checksum doesn't hold."""
    magic, docs, n, lanes, stride, marks, n_words, ids_crc, crc = HEAD.unpack_from(blob)
    if magic != MAGIC or zlib.crc32(blob[HEAD.size :]) != crc:
        raise ValueError("damaged token block")
    at, got = HEAD.size, []
    for kind, count in ((np.int64, docs), (np.uint8, docs), (np.int64, docs), (np.uint64, marks * lanes), (np.uint32, marks), (np.uint32, n_words)):
        got.append(np.frombuffer(blob, kind, count, at))
        at += got[-1].nbytes
    doc_ids, known, lengths, states, offsets, words = got
    ids = coder.decode(n, states.reshape(marks, lanes), offsets, words, stride=stride)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged token ids")
    return [d if k else None for d, k in zip(doc_ids.tolist(), known.tolist())], lengths, ids


def id_top(path: str) -> int:
    v = load_vocabulary(path)
    return max([*v["vocab"].values(), *v["specials"].values()])


def id_width(path: str):
    """The integer type that ids of a vocabulary fit."""
    return np.uint16 if id_top(path) < 1 << 16 else np.uint32


_encoders: dict[str, ByteEncoder] = {}


def library_encoder(path: str) -> ByteEncoder:
    """Ids of whole texts by the tokenizers library, which encodes each distinct piece of cuts() once while it is remembered: no
    pre-token of a byte-level vocabulary spans a cut, so the ids are those of the whole text."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        specials = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        t.encode_special_tokens = True  # special strings are cut out before

        size_of = np.zeros(id_top(path) + 1, np.int64)
        for token, i in t.get_vocab(with_added_tokens=False).items():
            size_of[i] = len(token)  # a letter for each byte

        def pieces(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # pieces whose edges are cuts in what they make together are encoded as one text, and told apart by the bytes of their ids
            buffer, starts, ends = joined(new)
            fine = np.zeros(len(buffer) + 1, bool)
            fine[cuts(buffer, starts[:1])] = True
            heads = np.flatnonzero(~fine[starts] | (np.arange(len(new)) % RUN == 0))
            texts = [b"".join(new[i:j]).decode() for i, j in zip(heads.tolist(), np.r_[heads[1:], len(new)].tolist())]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)])
            before = np.r_[0, np.cumsum(size_of[ids])]
            at = np.searchsorted(before, np.r_[starts, len(buffer)])
            if not np.array_equal(before[at], np.r_[starts, len(buffer)]):
                raise ValueError("the vocabulary isn't byte-level")
            return ids, np.diff(at)

        _encoders[path] = ByteEncoder(pieces, specials, ENTRIES)
    return _encoders[path]


def ordered_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(part, part_start, doc_id, ids) in ascending doc_id order (null first; ties by a hash of their texts): the ids of each
    whole text and the end id as little-endian unsigned integers, of 2 bytes where the vocabulary fits. Null text: empty.

    One shuffle, of the texts by ranges of ids. part is the range and part_start the ids before the document in it.
    """
    session(docs)
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    src = src.withColumn("g", F.xxhash64("text"))
    parts, code = id_ranges(src, "doc_id", "g")
    rows = src.withColumn("part", F.shiftright(code, 1)).repartitionById(parts, "part")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "g").select("part", "doc_id", "text")

    width = id_width(path)

    def run(batches):
        encode, at = library_encoder(path), 0
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in encode(b.column(2).to_pylist())]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = at + np.cumsum(lengths) - lengths
            at += int(lengths.sum())
            cells = [x.astype(width).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), b.column(1), pa.array(cells, pa.binary())], names=["part", "part_start", "doc_id", "ids"])

    return rows.mapInArrow(run, "part int, part_start long, doc_id long, ids binary")


def _counted(width):
    def run(batches: Iterator) -> Iterator:
        counts = np.zeros(1 << 16, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width), minlength=len(counts))
            got[: len(counts)] += counts
            counts = got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], names=["token", "n"])

    return run


def frequencies(ids: DataFrame, width=np.uint16) -> np.ndarray:
    """Counts of all ids of all documents: one array a task, summed by token. Only the vocabulary comes to the driver."""
    rows = ids.select("ids").mapInArrow(_counted(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.int64)
    counts[rows.token.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return counts


def _blocks(freqs: np.ndarray, block: int, width):
    def run(batches):
        coder = Coder(freqs)
        held: list[tuple] = []
        part, first, size = None, 0, 0

        def out():
            blob = pack(coder, [d for d, _ in held], [x for _, x in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "part_start", "n_tokens", "blob"],
            )

        for b in batches:
            for p, at, d, x in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and (size >= block or p != part or at != first + size):  # full, or rows from elsewhere begin
                    yield out()
                    held, size = [], 0
                if not held:
                    part, first = p, at
                held.append((d, np.frombuffer(x, width).astype(np.uint32)))
                size += len(held[-1][1])
        if held:
            yield out()

    return run


def write_token_files(ids: DataFrame, path: str, width=np.uint16, block: int = BLOCK) -> None:
    """Writes ordered_ids() rows, read from a table, as a token file set, without a shuffle.

    A block ends with the document that fills it, so a task holds one block, or one document if that is longer.
    """
    spark = session(ids)
    freqs = scaled(frequencies(ids, width))
    token = np.flatnonzero(freqs)
    spark.createDataFrame(list(zip(token.tolist(), freqs[token].tolist())), "token long, freq long").coalesce(1).write.parquet(f"{path}/freqs")
    made = ids.select("part", "part_start", "doc_id", "ids").mapInArrow(_blocks(freqs, block, width), "part int, part_start long, n_tokens long, blob binary")
    made.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _read(freqs: np.ndarray):
    def run(batches):
        coder = Coder(freqs)
        for b in batches:
            for part, start, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                docs, lengths, ids = unpack(coder, blob)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                begins = ends - lengths
                cut = [raw[4 * a : 4 * e] for a, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(start + begins), pa.array(lengths), pa.array(cut, pa.binary())],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: start is the number of ids of all documents before it.

    Blocks decode in parallel. Only the part totals, one for each written partition, come to the driver.
    """
    table = spark.read.schema("token long, freq long").parquet(f"{path}/freqs").toPandas()
    freqs = np.zeros(int(table.token.max()) + 1 if len(table) else 1, np.int64)
    freqs[table.token.to_numpy(np.int64)] = table.freq.to_numpy(np.int64)
    blocks = spark.read.schema("part int, part_start long, n_tokens long, blob binary").parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, at = [], 0
    for r in totals:
        base.append((r.part, at))
        at += r.n
    session(blocks)
    docs = blocks.select("part", "part_start", "blob").mapInArrow(_read(freqs), "doc_id long, part int, part_start long, n_tokens long, ids binary")
    known = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # a row for each written partition
    return docs.join(known, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Tokenizes, writes and reads back: (doc_id, start, n_tokens, ids) from the files.

    Null or empty texts hold the end id alone. Rows with null or repeated ids are kept each, in a fixed order; an
    empty table gives an empty one; other columns are dropped.
    """
    folder = folder or shared_dir(docs.sparkSession)
    ids = written(ordered_ids(docs, path), compression="zstd")
    write_token_files(ids, folder, id_width(path))
    removed(ids)
    return read_token_files(docs.sparkSession, folder)

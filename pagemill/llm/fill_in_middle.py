"""Fill-in-middle transformation (operator 12): cuts at line boundaries, looked up in an index of distinct texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, written

#: The seed, the chances in a hundred of a cut and of the suffix-first form, and what stands before prefix, suffix and middle.
SEED, RATE, SPM, MARKS = 7, 100, 50, ("<P>", "<S>", "<M>")
#: Bytes of texts that a partition of the index holds, about, and code points of a text that are looked through at a time.
PART_BYTES, STRETCH = 64 << 20, 1 << 20
ONES = np.array([bin(x).count("1") for x in range(256)], np.int64)


def line_ends(text: str) -> np.ndarray:
    """Code points up to the end of each line: a line ends after its line feed, the last one at the end of the text."""
    found = [np.flatnonzero(np.frombuffer(text[i : i + STRETCH].encode("utf-32-le"), np.uint32) == 10) + (i + 1) for i in range(0, len(text), STRETCH)]
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return ends if not len(text) or text[-1] == "\n" else np.append(ends, len(text))


def packed(ends: np.ndarray) -> bytes:
    """An ascending list in Elias and Fano's form: its length (8 bytes), the width of low parts (1), all low parts, and
    a bit set at high part + rank for each number, about two bits for each number above its low part."""
    n = len(ends)
    if not n:
        return bytes(9)
    ends = ends.astype(np.int64)
    width = max(0, int(ends[-1] // n).bit_length() - 1)
    low = np.packbits((ends[:, None] >> np.arange(width)) & 1 != 0, bitorder="little") if width else np.zeros(0, np.uint8)
    high = np.zeros((int(ends[-1] >> width) + n + 7) // 8 * 8, bool)
    high[(ends >> width) + np.arange(n)] = True
    return n.to_bytes(8, "little") + bytes([width]) + low.tobytes() + np.packbits(high, bitorder="little").tobytes()


def selected(raw: bytes, *ranks: int) -> list[int]:
    """The numbers of these ranks, from 1; 0 for rank 0. No other number of the list is rebuilt."""
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    lows = (n * width + 7) // 8
    low, high = np.frombuffer(raw, np.uint8, lows, 9), np.frombuffer(raw, np.uint8, -1, 9 + lows)
    before, out = np.cumsum(ONES[high]), []
    for rank in ranks:
        if not rank:
            out.append(0)
            continue
        at = int(np.searchsorted(before, rank))
        left = rank - (int(before[at - 1]) if at else 0)
        place = 8 * at + int(np.flatnonzero(np.unpackbits(high[at : at + 1], bitorder="little"))[left - 1])
        bit = (rank - 1) * width
        some = int.from_bytes(low[bit // 8 : (bit + width + 7) // 8].tobytes(), "little")
        out.append((place - (rank - 1)) << width | (some >> bit % 8) & ((1 << width) - 1))
    return out


def by_text(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Documents as (row, text, k), equal texts after each other: dealt to partitions by k, the text's hash, and sorted by it.

    A hash whose rows fill more than a quarter of a partition is dealt to as many parts as it needs. Such hashes are at most four
    a partition, so they can be broadcast.
    """
    session(docs)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    src = src.withColumn("k", F.xxhash64("text"))
    sizes = written(src.groupBy("k").agg(F.sum(F.octet_length("text") + 64).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES))
    quarter = max(1, total // (4 * parts))
    hot = sizes.where(F.col("size") > quarter).select("k", F.ceil(F.col("size") / quarter).alias("of"))
    dealt = src.join(F.broadcast(hot), "k", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("of", F.lit(1))))
    return dealt.repartition(parts, "k", "part").sortWithinPartitions("k").select("row", "text", "k")


def _cuts(batches):
    """Each row with the number of its text's lines and the ends it draws; a text is listed when it comes for the first time.

    The lists of one hash are kept by the texts themselves, so a text never gets the list of another one.
    """
    now, known = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        out = []
        for text, k, one, other in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            if k != now:
                now, known = k, {}
            if text not in known:
                ends = line_ends(text)
                known[text] = (len(ends), packed(ends))
            n, ends = known[text]
            cuts = (one % (n + 1), other % (n + 1))
            out.append((n, *selected(ends, min(cuts), max(cuts))))
        made = [pa.array(x, pa.int64()) for x in zip(*out)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["row", "text", "n", "a", "b"])


def fill_in_middle(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple = MARKS,
) -> DataFrame:
    """``keep`` with n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, a row for each document.

    Documents meet their text's list in one shuffle of the texts: equal ones come after each other, the first one's lines are
    listed (once in each part that a hot text is dealt to), and every one selects its own two ends from the list, by numbers
    drawn from seed and id. Outputs are columns of Spark's functions.

    Null texts are empty; empty texts and those that hold a mark are plain; a null id draws as an empty one; repeated rows are cut
    alike; an empty table gives an empty one. Columns of keep that clash with the new ones raise ValueError.
    """
    clash = {"n", "form", "prefix_chars", "middle_chars", "output"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the input already")
    dealt = by_text(docs, [*keep, *({doc_id} - set(keep))], text)
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.`{doc_id}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(seeded, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = dealt.select("row", "text", "k", h[0].alias("h1"), h[1].alias("h2"))
    kinds = [rows.schema["row"], rows.schema["text"], *(T.StructField(c, T.LongType()) for c in "nab")]
    found = rows.mapInArrow(_cuts, T.StructType(kinds))
    marked = [F.contains("text", F.lit(m)) for m in marks]
    plain = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    found = found.withColumn("form", form)
    prefix, middle, suffix = F.expr("substring(text, 1, cast(a AS int))"), F.expr("substring(text, cast(a + 1 AS int), cast(b - a AS int))"), F.expr("substring(text, cast(b + 1 AS int))")
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return found.select(
        *[F.col(f"row.`{c}`") for c in keep], "n", "form", cut(F.col("a")).alias("prefix_chars"), cut(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output")
    )


def restored(output: str = "output", form: str = "form", marks: tuple = MARKS) -> Column:
    """The text that an output of this form was made of: its three parts stand between marks, which the text doesn't hold."""
    head, middle = F.substring_index(output, marks[2], 1), F.substring_index(output, marks[2], -1)
    skip = lambda part, mark: F.substring(part, len(mark) + 1, (1 << 31) - 1)
    psm = F.concat(skip(F.substring_index(head, marks[1], 1), marks[0]), middle, F.substring_index(head, marks[1], -1))
    spm = F.concat(F.substring_index(head, marks[0], -1), middle, skip(F.substring_index(head, marks[0], 1), marks[1]))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


ORACLE = f"""WITH seeded AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines FROM documents),
  drawn AS (SELECT doc_id, text, lines, len(lines) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM seeded),
  cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{MARKS[0]}') OR contains(text, '{MARKS[1]}') OR contains(text, '{MARKS[2]}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
  parts AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{MARKS[0]}' || prefix || '{MARKS[1]}' || suffix || '{MARKS[2]}' || middle
    WHEN 'spm' THEN '{MARKS[1]}' || suffix || '{MARKS[0]}' || prefix || '{MARKS[2]}' || middle ELSE text END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM parts"""

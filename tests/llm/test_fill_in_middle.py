"""Cuts against a brute-force version, lists against numpy, and the awkward rows of every table."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import fill_in_middle as M

DOCS = "doc_id long, text string, source string, k int, row int, part int, a int, h1 int"


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    out = [None, "", "\n", "\n\n\n", "no end", "end\n", "a<P>b\nc", "<\nS>\n<S\n>", "é\U0001f600\n\r\n x\n\0\n" * 9, "x" * 70_000, "line\n" * 30_000, "y" * 3_000_000 + "\nz"]
    out += ["".join(rng.choice("ab\n<>SPM é\U0001f600") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    return out + ["a copied text\nof two lines"] * 900 + out[20:60]


def test_cuts_equal_brute_force(spark):
    rows = [(i, t, "s", 1, 2, 3, 4, 5) for i, t in enumerate(texts())]
    rows += [rows[3], rows[40], (5, "another\ntext", None, *[None] * 5), (None, "no\nid", None, *[None] * 5), (None, None, None, *[None] * 5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for rate, spm in ((100, 50), (60, 0)):
        out = M.fill_in_middle(docs, ["doc_id", "text", "k", "row"], rate=rate, spm=spm)
        got = out.withColumn("back", M.restored()).collect()
        key = lambda x: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)
        want = sorted(((r[0], *brute(r[0], r[1], rate, spm)) for r in rows), key=lambda x: key((x[0], x[5], x[1])))
        have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=lambda x: key((x[0], x[5], x[1])))
        assert have == want
        assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm"}


def test_lists_give_back_every_end():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 1 << 40), (7, 7), (300, 310), (1000, 1 << 33), (50, 50_000)):
        ends = np.sort(rng.choice(top, n, replace=False) + 1) if top < 1 << 20 else np.sort(rng.integers(1, top, n))
        raw = M.packed(ends)
        assert M.selected(raw, *range(n + 1)) == [0, *ends.tolist()]
        assert len(raw) <= 9 + n * (2 + max(0, top // max(1, n)).bit_length()) / 8 + 3
    text = "a\n" * (M.STRETCH // 2) + "é\nlast"
    assert M.line_ends(text)[-2:].tolist() == [M.STRETCH + 2, M.STRETCH + 6]


def test_unlike_texts_of_one_hash_keep_their_own_lists():
    batch = lambda texts: pa.RecordBatch.from_pydict({"row": [{"doc_id": i} for i in range(len(texts))], "text": texts, "k": [9] * len(texts), "h1": [1] * len(texts), "h2": [2] * len(texts)})
    out = pa.Table.from_batches(list(M._cuts(iter([batch(["a\nb\nc\n", "longer line\nb\nc\n", "a\nb\nc\n"]), batch([]), batch(["longer line\nb\nc\n"])])))).to_pydict()
    assert (out["n"], out["a"], out["b"]) == ([3] * 4, [2, 12, 2, 12], [4, 14, 4, 14])


def test_hot_texts_are_dealt_to_parts_and_listed_once_in_each(spark):
    docs = spark.createDataFrame([(i, "hot\ntext" if i % 3 else f"t{i}\n", "s", 1, 2, 3, 4, 5) for i in range(3000)], DOCS).repartition(4)
    dealt = M.by_text(docs, ["doc_id"]).withColumn("task", F.spark_partition_id())
    assert dealt.where("text = 'hot\ntext'").select("task").distinct().count() > 1


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([], DOCS)
    assert M.fill_in_middle(docs, ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        M.fill_in_middle(docs.withColumn("form", F.lit("x")), ["form"])

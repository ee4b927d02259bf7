"""Sharding held to its law: every row once, gapless slots, even sizes, groups of equal texts whole unless they fill ranges."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import sharding

DOCS = "doc_id long, text string, source string, weight double, row int, k1 int, range int"


def made(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1.0, 2, 3, 4) for i, t in enumerate(texts)], DOCS)


def held(docs, n, spread):
    """The rows of shards() after the checks that hold for any table."""
    rows = sharding.shards(docs, ["doc_id", "text"], n=n).collect()
    given = docs.select("doc_id", "text").collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert [(r.doc_id, r.text) for r in sorted(rows, key=order)] == [(r.doc_id, r.text) for r in sorted(given, key=order)]
    bytes_of, slots = [0] * n, [[] for _ in range(n)]
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    even, top = sum(bytes_of) / n, max([0, *(r.size for r in rows)])
    if top <= even:
        assert max(bytes_of) - min(bytes_of) <= spread * even, bytes_of
    return rows


def test_sizes_are_even_and_groups_stay_together(spark):
    rng = random.Random(1)
    texts = ["w" * int(rng.paretovariate(1.2) * 40) for _ in range(3000)] + ["a copy of a text " * 3] * 4 + [f"unique {i} é" for i in range(900)]
    rng.shuffle(texts)
    texts = [t[:3000] + str(i) * (t[0] == "w") for i, t in enumerate(texts)]
    rows = held(made(spark, texts), 7, 0.06)
    assert len({r.shard for r in rows if r.text.startswith("a copy")}) == 1


def test_a_group_of_a_third_and_rows_equal_in_all_columns_are_divided(spark):
    texts = [f"text number {i} " * (i % 9) for i in range(2000)]
    docs = made(spark, texts + ["the hot text " * 20] * 1500 + [""] * 500 + [None] * 300)
    same = made(spark, ["one row"]).drop("doc_id").withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns)
    docs = docs.unionByName(same.withColumn("row", F.lit(2)).crossJoin(spark.range(1500).select()).select(docs.columns))
    rows = held(docs, 10, 0.07)
    assert len({r.shard for r in rows if r.doc_id is None}) > 1  # identical rows spread as well
    assert len({r.shard for r in rows if (r.text or "").startswith("the hot")}) > 3


def test_large_records_and_small_tables(spark):
    rows = held(made(spark, ["x" * 90_000, "y" * 50_000, "z" * 50_000, *(f"{i}" * 20 for i in range(3000))]), 8, 0.1)
    assert len({r.shard for r in rows if len(r.text) >= 50_000}) == 3
    rows = held(made(spark, ["g" * 900_000, *(f"{i}" * 20 for i in range(3000))]), 8, 0.1)
    by = {r.shard: 0 for r in rows}
    for r in rows:
        by[r.shard] += r.size
    small = sorted(by.values())[:-1]
    assert len(small) == 7 and small[-1] - small[0] <= 0.1 * small[-1]  # the rest share what the giant leaves
    for texts in ([], ["a"], [None], ["a", "a", ""]):
        held(made(spark, texts), 5, 9.0)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = made(spark, [f"t{i % 400} " * (i % 50) for i in range(1500)])
    once = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs.coalesce(1), ["doc_id"], n=6).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs.repartition(9), ["doc_id"], n=6).collect()}
    assert {k: v[0] for k, v in once.items()} == {k: v[0] for k, v in again.items()} and len(once) == 1500
    assert once == again


def test_clashing_names_and_files(spark, tmp_path):
    docs = made(spark, [f"t{i}" * 9 for i in range(300)])
    with pytest.raises(ValueError):
        sharding.shards(docs.withColumn("slot", F.lit(1)), ["doc_id", "slot"])
    out = sharding.write_shards(docs, str(tmp_path / "out"), n=4, file_rows=50)
    assert out.count() == 300 and set(docs.columns) <= set(out.columns)
    assert out.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").count() == 0


def test_the_query_has_no_python(spark):
    plan = sharding.shards(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))

"""The trie against a brute-force version, with forced collisions, conversations over many ranges, and the awkward rows of every table."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import conversation_trie as C

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, cls int, rank int, part int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x, key=lambda t: t[0])] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def made(rows):
    return [(*r, 1, 2, 3, 4) for r in rows]


def awkward():
    rng, rows = random.Random(7), []
    for c in [*range(-7, 60), 1000, 1003, 9_000_000_000_000_000_004]:
        for t in range(rng.randint(1, 14)):
            rows.append((c, t if rng.random() < 0.97 else -t, rng.choice(["user", None, "assistant"]), rng.choice(["hi", "", None, "é\U0001f600 ja", "a\0", f"{rng.randint(0, 3)}"])))
    rows += [(c, t, "user", f"common {t}") for c in range(100, 180) for t in range(10)]
    rows += [(200, None, "user", "no number"), (200, 1, "user", "one"), (205, None, "user", "no number"), (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # ties have an order of their own, see below
    return made(rows)


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def test_trie_equals_brute_force(spark):
    rows = awkward()
    assert found(C.trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))) == brute(rows)


@pytest.mark.parametrize("bits", [{"bits": 3}, {"key_bits": 2}, {"bits": 2, "key_bits": 1}])
def test_collisions_are_split(spark, bits):
    rows = awkward()[:400]
    assert found(C.trie(spark.createDataFrame(rows, CONVERSATIONS), **bits)) == brute(rows)


def test_a_conversation_over_many_ranges(spark):
    rows = made([(5, t, "user", f"turn {t % 7}") for t in range(6000)] + [(c, t, "user", f"turn {t % 7}") for c in (6, 7, 8) for t in range(20)])
    turns = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    src = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    got = C.ranked(C._turns(src, 64)).where("conv = 5").orderBy("rank").select("rank", "g1", "w1", "g2", "key").collect()
    h = [0, 0]
    for k, r in enumerate(got, 1):
        h = [(x * b + r.key) % p for x, b, p in zip(h, C.BASES, C.PRIMES)]
        assert (r["rank"], r.g1, r.g2, r.w1) == (k, *h, pow(C.BASES[0], k, C.PRIMES[0]))
    short = brute([r for r in rows if r[1] < 30])
    nodes = {(r.conv_id, r.depth): r for r in C.trie(turns).collect()}
    assert len(nodes) == len([1 for r in short]) + 6000 - 30
    top = nodes[5, 0]
    assert (top.n_convs, top.n_children, top.n_leaves) == (4, *[r for r in short if r[1] == 0][0][4:6])
    assert nodes[5, 4500].saved_tokens == 0 and nodes[5, 1].saved_tokens == [r for r in short if r[:2] == (5, 1)][0][6]


def test_stretches_of_depths_sum_to_the_same(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(C, "STRETCH", 2)
    assert found(C.trie(spark.createDataFrame(rows, CONVERSATIONS))) == brute(rows)


def test_ties_and_repeated_rows_are_turns_each_in_one_order(spark):
    rows = made([(1, 1, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, 9, "x", "y")] * 1)
    a = found(C.trie(spark.createDataFrame(rows, CONVERSATIONS)))
    assert a == found(C.trie(spark.createDataFrame(rows[::-1], CONVERSATIONS).repartition(3)))
    assert a[0][3] == 4


def test_empty_tables_and_one_turn(spark):
    assert C.trie(spark.createDataFrame([], CONVERSATIONS)).collect() == []
    for rows in (made([(3, 0, "user", "x")]), made([(0, None, None, None)]), made([(None, 1, "a", "b")])):
        assert found(C.trie(spark.createDataFrame(rows, CONVERSATIONS))) == brute(rows)

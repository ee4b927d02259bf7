"""The suffix array against sorted suffixes."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators.suffix_array import SuffixArray, suffix_array


def some(n=40):
    rng = random.Random(4)
    out = [(i, "".join(rng.choice("aAbBé ") for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return out + [(100, "banana" * 20), (101, "banana" * 20), (102, "Xbanana banana"), (103, None), (104, "")]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(some(), "id long, title string").withColumns({c: F.lit(1) for c in ("at", "rank", "key")}).repartition(3)


@pytest.mark.parametrize("first", [1, 8])
def test_ranks_equal_sorted_suffixes(records, first):
    every = sorted(t.lower()[k:] for _, t in some() if t for k in range(len(t)))
    rank = {s: i for i, s in reversed(list(enumerate(every)))}
    got = {(r.id, r.at): r["rank"] for r in suffix_array(records.select("id", "title"), "id", first=first).collect()}
    assert got == {(i, k + 1): rank[t.lower()[k:]] for i, t in some() if t for k in range(len(t))}
    assert suffix_array(records.limit(0).select("id", "title"), "id").count() == 0


def test_search_and_repeats(records, monkeypatch):
    from pagemill.operators import suffix_array as S

    monkeypatch.setattr(S, "STEP", 16)
    index = SuffixArray.write(records.select("id", "title"), "id")
    texts = {i: t.lower() for i, t in some() if t}
    for term in ("a", "BANANA", "banana" * 20, "banana" * 21, "ab", "é ", "zzz", "nab", "xbanana b", " ", "b a", "anananana"):
        want = {(i, k + 1) for i, t in texts.items() for k in range(len(t)) if t.startswith(term.lower(), k)}
        got = [tuple(r) for r in index.search(term).collect()]
        assert len(got) == len(set(got)) and set(got) == want, term
    r = index.longest_repeat().first()
    assert (r.length, r.passage) == (120, "banana" * 20)
    order = [(r.id, r.at, r.common) for r in index.places.orderBy("place").collect()]
    suffixes = [texts[i][a - 1 :] for i, a, _ in order]
    assert suffixes == sorted(suffixes)
    for before, now, (_, _, common) in zip(suffixes, suffixes[1:], order[1:]):
        n = next((k for k, (x, y) in enumerate(zip(before, now)) if x != y), min(len(before), len(now)))
        assert common == n

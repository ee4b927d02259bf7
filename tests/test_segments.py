"""Indexes in segments against merged records, and the frontier of a stream over restarts."""

import datetime
import random

import pytest

from pagemill.operators.segments import Segments
from pagemill.streaming import pages as streaming

KIND = "page_id long, title string, as_of string, source string, extra int"


def test_segments_equal_merged_records(spark, tmp_path):
    rng, state, index = random.Random(2), {}, Segments(spark, str(tmp_path / "i"))
    assert index.records().count() == 0 and index.search("x").count() == 0
    for k in range(4):
        rows = [(rng.randrange(40), rng.choice(["Alpha Beta", "gamma", "beta", "", None]) and f"{rng.choice(["Alpha Beta", "gamma", "beta", ""])} {k}", f"2026-01-{rng.randint(1, 9):02}", "s", 1) for _ in range(30)] if k else []
        rows = [(i, t, a, s, e) for i, (t, a, s, e) in {r[0]: r[1:] for r in rows}.items()] + [(None, "no id", "2026-02-01", "s", 1)]
        index.append(spark.createDataFrame(rows, KIND))
        for i, t, a, s, _ in rows:
            if i is not None and a >= state.get(i, ("", ""))[0]:
                state[i] = (a, t, s)
        if k == 2:
            index.remove(spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long"), "2026-01-05")
            state |= {i: ("2026-01-05", "gone", None) for i in range(0, 40, 3) if state.get(i, ("",))[0] <= "2026-01-05"}
    want = sorted((i, t or "", a) for i, (a, t, s) in state.items() if s)
    live = lambda x: sorted((r.page_id, r.title or "", r.as_of) for r in x.records().collect())
    assert live(index) == want
    hits = lambda x: sorted(r.page_id for r in x.search("BETA").collect())
    assert hits(index) == [i for i, t, _ in want if "beta" in t.lower()]
    opened = Segments(spark, str(tmp_path / "i"))
    assert len(opened.folders) == 5 and live(opened) == want
    opened.compact()
    assert len(opened.folders) == 1 and live(opened) == want and hits(opened) == hits(index)
    assert live(Segments(spark, str(tmp_path / "i"))) == want and live(index) == want  # a reader of the earlier state


def test_two_writers_of_one_number(spark, tmp_path):
    a, b = (Segments(spark, str(tmp_path / "j")) for _ in range(2))
    rows = spark.createDataFrame([(1, "t", "2026", "s", 1)], KIND)
    a.append(rows)
    with pytest.raises(Exception, match="exist"):
        b.append(rows)
    assert Segments(spark, str(tmp_path / "j")).records().count() == 1


def test_a_stream_gives_each_url_once_over_restarts(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    kind = "page_id long, url string, html string, ts timestamp"

    def arrive(k, *rows):
        made = [(i, "http://h/d/", html, at + datetime.timedelta(hours=k)) for i, html in rows]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        got = []
        stream = streaming.frontier(streaming.read_stream(spark, str(tmp_path / "in"), kind, 1))
        query = streaming.run_to(stream, str(tmp_path / "cp"), lambda df, n: got.extend((r.url, r.host) for r in df.collect()))
        assert query.awaitTermination(180)
        return sorted(got)

    arrive(0, (1, "<a href=/a>x</a><a href=b#c>x</a><a href='mailto:x'>m</a><a href=/a>again</a>"), (2, None))
    assert run() == [("http://h/a", "h"), ("http://h/d/b", "h")]
    arrive(1, (3, "<a href=/a#z>x</a><a href=http://H2/q>x</a>"), (4, "<a href='http://['>x</a>"))
    arrive(2, (5, "<a href=b>x</a><iframe src=/f></iframe>"))
    assert run() == [("http://H2/q", "h2"), ("http://h/f", "h")]
    assert run() == []

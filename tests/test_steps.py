"""Flows as tables: every step's failure, several starts at once, odd tables."""

import pytest

from pagemill.plans.extract import el
from pagemill.plans.steps import MISSING, Link, Paged, Submit, Visit, flow

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [
            (1, "http://a/", "<a href=/menu>The MENU</a><a href=/none>gone</a><a href='ht!tp://['>bad</a><form id=f action=/find><input name=q></form><form id=g method=put></form>"),
            (2, "http://a/menu", "<a href=/find?q=x>find</a>"),
            (3, "http://a/find?q=x", "<a href='/find?q=x&row=5'>2</a><a href='/find?q=x&row=3'>no</a><a href='/film?id=1'>one</a><a href='/film?id=2+b%21'>two</a>".replace("row=3'", "row=5'")),
            (4, "http://a/find?q=x&row=5", "<a href='/find?row=5'>same</a><a href='/film?id=9'>nine</a>"),
            (5, "http://f/1", "<h1>One</h1>"), (6, "http://f/2+b%21", "<h1>Two</h1>"), (7, "http://f/1", "<h1>stored twice</h1>"), (8, None, None), (9, "http://b/", None),
        ],
        PAGES,
    )


def ends(df):
    return sorted((r.start, r.step, r.page_id, r.error) for r in df.collect())


def of(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_each_step_and_its_failures(spark, pages):
    starts = of(spark, "http://a/", "http://b/", "http://c/", None, "http://a/")
    lost = [("http://c/", 0, None, MISSING)]
    assert ends(flow(pages, starts, [])) == sorted([("http://a/", 0, 1, None), ("http://b/", 0, 9, None), *lost], key=str)
    assert ends(flow(pages, starts, [Link("menu"), Link("FIND")])) == sorted([("http://a/", 2, 3, None), ("http://b/", 1, 9, "no such link"), *lost], key=str)
    assert ends(flow(pages, of(spark, "http://a/"), [Link("gone")])) == [("http://a/", 1, 1, MISSING)]
    assert ends(flow(pages, of(spark, "http://a/"), [Submit("F", {"Q": "x"})])) == [("http://a/", 1, 3, None)]
    assert ends(flow(pages, of(spark, "http://a/"), [Submit("F", {"q": "y"})])) == [("http://a/", 1, 1, MISSING)]
    assert ends(flow(pages, of(spark, "http://a/"), [Submit("g")])) == [("http://a/", 1, 1, "method isn't supported")]
    assert ends(flow(pages, of(spark, "http://a/menu"), [Submit("f")])) == [("http://a/menu", 1, 2, "no such form")]
    assert ends(flow(pages, of(spark, "http://a/menu"), [Visit("id", "http://f/")])) == [("http://a/menu", 1, 2, "no such parameter")]


def test_paging_visits_and_records(spark, pages):
    steps = [Submit("f", {"q": "x"}), Paged("find"), Visit("id", "http://f")]
    got = flow(pages, of(spark, "http://a/"), steps, {"title": el("h1").first_text()})
    assert sorted((r.step, r.page_id, r.error, r.record and r.record.title) for r in got.collect()) == [(3, 4, MISSING, None), (3, 5, None, "One"), (3, 6, None, "Two")]
    assert ends(flow(pages, of(spark, "http://a/"), steps[:2])) == [("http://a/", 2, 3, None), ("http://a/", 2, 4, None)]


def test_empty_tables(spark, pages):
    assert ends(flow(pages.limit(0), of(spark, "http://a/"), [Link("x"), Paged("y")])) == [("http://a/", 0, None, MISSING)]
    assert ends(flow(pages, of(spark), [Link("x")])) == []

"""Registered queries against their SQL, on pages that the small tables don't have."""

import duckdb
import pytest

from pagemill.functions.dom import parse
from pagemill.queries import ORACLE_SQL, QUERIES

PAGE = "<!doctype html><html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>a &amp; b</p></article></body></html>"
#: Titles and headings that were cut after they had been escaped.
CUT = ("More than and then&amp;&amp", "Than &copy; &quot;and that&quot", "other &ampx &am", "other &#x27;&#x27 &amp;lt;", "than&", "than &amp;amp &lt")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cut"))
    rows = [(i, f"http://a/{i}", PAGE.format(t)) for i, t in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def by_sql(name, path):
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS FROM '{path}/pages.parquet/*.parquet'")
        return sorted(con.sql(ORACLE_SQL[name]).fetchall(), key=str)


def test_references_without_a_semicolon_count_by_the_standard_unless_asked_otherwise():
    title = lambda d: d.children[0].children[0].children[0]
    html = "<title>&amp;&ampx&#65&#65;&zz;</title><a href='?x=1&lt&lt;'>"
    text, a = title(parse(html)).children[0].text, parse(html).children[0].children[1].children[0]
    assert (text, a.attrs) == ("&&xAA&zz;", {"href": "?x=1<<"})
    text, a = title(parse(html, closed=True)).children[0].text, parse(html, closed=True).children[0].children[1].children[0]
    assert (text, a.attrs) == ("&&ampx&#65A&zz;", {"href": "?x=1&lt<"})


@pytest.mark.parametrize("name", ["articles_json", "page_titles", "stored_records", "stored_index_search", "title_search"])
def test_titles_cut_within_a_reference_are_as_in_sql(spark, cut, name):
    got = sorted(map(tuple, QUERIES[name](spark, cut).collect()), key=str)
    assert got and got == by_sql(name, cut)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Pages without a title, without html, of one id and of none."""
    path = str(tmp_path_factory.mktemp("odd"))
    html = [(1, PAGE.format("and than")), (2, "<p>than"), (3, None), (4, ""), (5, PAGE.format("")), (6, PAGE.format("and that")), (6, PAGE.format("or")), (None, PAGE.format("And than")), (7, None), (8, PAGE.format("and tzz")), (8, PAGE.format("xxxx th"))]
    spark.createDataFrame([(i, "http://a", h) for i, h in html], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["page_titles", "stored_index_search", "stored_records", "title_search"])
def test_odd_pages_are_as_in_sql(spark, odd, name):
    got = sorted(map(tuple, QUERIES[name](spark, odd).collect()), key=str)
    assert got and got == by_sql(name, odd)

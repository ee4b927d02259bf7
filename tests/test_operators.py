"""Operators over pages, forms, URLs and records against values worked out by hand or a plain evaluator."""

import gzip
import json
import random
from urllib.parse import quote_plus, unquote_plus

import pytest
from pyspark.sql import functions as F

from pagemill.engine import Engine
from pagemill.functions import predicates as P
from pagemill.functions import urls as U
from pagemill.functions.dom import parse
from pagemill.functions.json_text import canonical_json, write_json
from pagemill.operators import crawl, forms, nodes, search
from pagemill.plans.extract import Each, Obj, Root, Terminal, deep_text, each, el, extract, first_text, members, obj, root, scope
from pagemill.plans.flows import LISTING, MOVIE, listing_records, movie_records
from pagemill.sources import pages as sources
from pagemill.sources import sinks
from pagemill.streaming import pages as streaming

LIST = """<div id=x><li id=result_9><span class="lrg bold">no</span></div><div id=btfResults><ul><li id=result_1><span class="lrg bold">T<b>1</b></span>
<span class="med reg subt">2001</span><img src=a.png><table><tr><td class=clabel>Rent <b>HD</b><td>x<td class=cpriceR>$1</tr><tr><td>one</tr>
<tr><td class=clabel>Buy<td>x<td class=cpriceR>$2</table><li id=result_2>plain<table><tr><td>a<td>b<td>c</table><li id=other></ul></div>"""
FILM = """<div id=mdp-overview><h2 class=title>Film</h2><span class=year>1999</span><div id=mdp-boxshot><img src=b.png></div>
<div id=mdp-metadata-content><a>streaming</a> <a>DVD</a><a>stream<b>ing</b></a></div></div>"""
FORM = """<form action="/go?old=1" id=F><input name=a value="x y"><input type=checkbox name=c checked><input type=checkbox name=d value=1>
<input type=radio name=r value="" checked><input name=off disabled value=1><button name=b>B</button><input type=submit name=s value=S>
<textarea name=t value=v>text</textarea><select name=sel><option selected>o</select><input type=image name=im><input value=nameless>
<datalist><input name=dl value=1></datalist><input type=hidden name=_charset_ value=q><input name=nul></form>
<form method=post action="http://h/p"><input name=isindex type=text value="a&b"><input name=k value="é"></form>
<form method=post enctype=multipart/form-data><input name=z></form><form action="ftp://h/"><input name=z></form><form method=put></form>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/l", LIST), (2, "http://b/m", FILM), (3, "http://c/f?x#y", FORM), (4, "u", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").cache()


@pytest.fixture(scope="module")
def table(pages):
    return nodes.parse_html(pages).cache()


# -- a plain evaluator of templates


def find(domain, s):
    out = []
    for c in domain.children:
        if c.kind == "element" and c.name == s.name and all(holds(c, t) for t in s.tests):
            out.append(c)
        out += find(c, s)
    return out


def text(n):
    return n.text if n.kind == "text" else "".join(map(text, n.children)) if n.kind != "comment" else ""


def texts(n):
    return [n.text] if n.kind == "text" else [t for c in n.children for t in texts(c)]


def holds(n, t):
    kind, a, b = t
    if kind == "equals":
        return n.attrs.get(a) == b
    if kind == "starts":
        return n.attrs.get(a, "").startswith(b) and a in n.attrs
    return sum(c.kind == "element" for c in n.children) == a if kind == "children" else text(n) == a


def evaluate(t, domain):
    if isinstance(t, Root):
        return evaluate(t.template, next(iter(find(domain, t.selector)), domain))
    if isinstance(t, Terminal):
        at = domain if t.selector.name is None else next(iter(find(domain, t.selector)), None)
        if at is None:
            return None
        return {"attr": lambda: at.attrs.get(t.arg), "first_text": lambda: next(iter(texts(at)), None), "deep_text": lambda: text(at)}[t.kind]()
    if isinstance(t, list):
        return [v for x in t for v in ([evaluate(x.element, m) for m in find(domain, x.selector)] if isinstance(x, Each) else [evaluate(x, domain)])]
    if isinstance(t, (dict, Obj)):
        return {n: evaluate(v, domain if s is None else next(iter(find(domain, s)), domain)) for s, n, v in members(t)}
    return t


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else v


TEMPLATES = [
    LISTING,
    MOVIE,
    [each(el("li"), {"t": deep_text(), "i": el("img").attr("src")}), {"t": "end", "i": None}],
    {"a": [each(el("tr"), {"n": [each(el("td"), {"x": first_text()})]})], "b": 3, "c": True, "b ": 1.5},
    obj(("x", {"y": el("b").first_text()}), scope(el("table")), ("z", el("td").deep_text()), scope(), ("x", "again"), ("w", [[each(el("td"), {"q": first_text()})]])),
    root(el("nothing"), {"t": first_text()}),
]


@pytest.mark.parametrize("template", TEMPLATES, ids=range(len(TEMPLATES)))
def test_templates_equal_a_plain_evaluator(pages, table, template):
    got = {r.page_id: plain(r.record) for r in extract(table, template).collect()}
    assert got == {r.page_id: evaluate(template, parse(r.html or "")) for r in pages.collect()}


@pytest.mark.parametrize("bad", [[first_text()], "x", first_text(), [], {}, {"a": object()}, {"a": each(el("p"), {"b": 1})}, {1: "a"}, [el("p")]])
def test_malformed_templates(table, bad):
    with pytest.raises(ValueError):
        extract(table, bad)


def test_flows(pages):
    assert [r.title for r in listing_records(pages).orderBy("title").collect()] == ["T", "plain"]
    film = movie_records(pages).where("page_id = 2").first()
    assert (film.title, film.date, film.img, [o.label for o in film.offers]) == ("Film", "1999", "b.png", ["DVD", "streaming", "streaming"])


def test_structural_joins_keep_to_pages(table, capsys):
    extract(table, LISTING).explain()
    assert "Cartesian" not in (plan := capsys.readouterr().out) and "NestedLoop" not in plan


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("template", TEMPLATES, ids=range(len(TEMPLATES)))
def test_parsed_pages_give_what_flat_tables_give(pages, table, template):
    assert {r.page_id: plain(r.record) for r in extract(nodes.parse_pages(pages), template).collect()} == {r.page_id: plain(r.record) for r in extract(table, template).collect()}


def test_pages_are_parsed_once_and_nothing_is_shuffled(pages, capsys):
    parsed = nodes.parse_pages(pages)
    articles = [each(el("article"), {"title": el("h1").first_text(), "paras": [each(el("p"), {"text": deep_text()})]})]
    for df in (
        extract(parsed, articles), extract(parsed, LISTING), extract(parsed, MOVIE), nodes.links(parsed), nodes.resolved(nodes.links(parsed)), nodes.titles(parsed), nodes.forms(parsed),
        nodes.leaf_nodes(parsed, True), nodes.element_texts(parsed, "p"), nodes.element_paths(parsed, "p"), nodes.documents_meta(parsed), forms.controls(parsed),
    ):
        plan = plan_of(df, capsys)
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    assert plan_of(forms.requests(nodes.forms(parsed), forms.data_sets(forms.controls(parsed))), capsys).count("Exchange") <= 3


# -- forms


def test_data_sets_and_requests(pages, table):
    found = forms.controls(table)
    sets = forms.data_sets(found)
    first = [(e["name"], e["value"], e["type"]) for e in sets.where("page_id = 3").orderBy("form_id").first().data]
    assert first == [("a", "x y", None), ("c", "on", "checkbox"), ("r", "on", "radio"), ("s", "S", "submit"), ("t", "v", None), ("_charset_", "q", "hidden"), ("nul", None, None)]
    sent = forms.requests(nodes.forms(table), sets, pages).orderBy("form_id").collect()
    assert (sent[0].method, sent[0].url) == ("GET", "http://c/go?a=x+y&c=on&r=on&s=S&t=v&_charset_=UTF-8&nul=")
    assert (sent[1].method, sent[1].url, sent[1].body, sent[1].content_type) == ("POST", "http://h/p", "a%26b&k=%C3%A9", "application/x-www-form-urlencoded")
    assert [s.error for s in sent[2:]] == ["enctype isn't supported", "scheme isn't http", "method isn't supported"]
    changed = forms.set_control_value(found, "A", "new")
    assert forms.find_control(changed, "a").where("page_id = 3").orderBy("form_id").first().attrs["value"] == "new"
    stored = pages.select("page_id", F.when(F.col("page_id") == 2, F.lit("http://h/p")).otherwise(F.col("url")).alias("url"))
    assert forms.submit(forms.requests(nodes.forms(table), sets, pages), stored).where("method = 'POST'").first().target_page_id == 2
    assert nodes.find_form(nodes.forms(table), "f").where("page_id = 3").first().id == "F"


# -- urls


def test_coding(spark):
    values = ["".join(map(chr, range(256))), "a b+c*~", "😀é", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.e for r in df.select(U.encode_value(F.col("v")).alias("e")).collect()]
    assert got == [quote_plus(v, safe="*").replace("~", "%7E") for v in values]
    back = df.select("v", U.decode_value(U.encode_value(F.col("v"))).alias("d")).collect()
    assert all(r.v == r.d for r in back)
    odd = spark.createDataFrame([("a+b%41%zz%",), (None,)], "v string").select(U.decode_value("v").alias("d")).collect()
    assert [r.d for r in odd] == [unquote_plus("a+b%41%zz%"), None]


def test_pairs(spark):
    def of(q, **more):
        return [(p["name"], p["value"]) for p in spark.createDataFrame([(q,)], "q string").select(U.query_pairs(F.col("q"), **more).alias("p")).first().p]

    assert of("a=1&a=2&&b&=v&") == [("a", "1"), ("a", "2"), ("", ""), ("b", ""), ("", "v")]
    assert of("x&y", isindex=True) == [("", "x"), ("y", "")]
    assert of("k=%E9&_charset_=iso-8859-1&k=%E9") == [("k", "�"), ("_charset_", "iso-8859-1"), ("k", "é")]
    df = spark.createDataFrame([("a=1&a=2",)], "q string").select(U.query_pairs(F.col("q")).alias("p"))
    assert df.select(U.first_value(F.col("p"), "a").alias("v")).first().v == "1"
    split = spark.createDataFrame([("a&&b&",), ("",), ("a",)], "q string").select(U.strict_split(F.col("q")).alias("s")).collect()
    assert [r.s for r in split] == [["a", "", "b"], [], ["a"]]


def test_numbers_and_parts(spark):
    r = spark.createDataFrame([("12x", "fF", "HTTPS://h/a//b?q", "ht tp:")], "d string, x string, u string, bad string").select(
        U.base_10(F.col("d")).alias("d"), U.base_16(F.col("x")).alias("x"), U.is_http(F.col("u")).alias("h"), U.path_segments(F.col("u")).alias("s"),
        U.is_http(F.col("bad")).alias("b"), U.append_segment(F.lit("http://h/"), F.lit("a b")).alias("a"),
    ).first()
    assert tuple(r) == (12, 255, True, ["a", "b"], False, "http://h/a+b")


# -- nodes, links, crawl


def test_links_and_leaves(spark):
    html = '<a href="/x?row=20">One <b>T</b>wo</a><a name=n>no</a><iframe src="/i"></iframe><a href="search?row=30">next</a><a href="/search?row=40&movieid=7">n</a><p></p>'
    pages = spark.createDataFrame([(1, "http://h/d/", html), (2, "http://h/i", "")], "page_id long, url string, html string")
    table = nodes.parse_html(pages)
    links = nodes.links(table)
    assert [(r.idx, r.text, r.url, r.is_iframe) for r in links.orderBy("idx").collect()] == [
        (0, "One Two", "/x?row=20", False), (1, "", "/i", True), (2, "next", "search?row=30", False), (3, "n", "/search?row=40&movieid=7", False),
    ]
    assert nodes.find_link(links, "NEXT").first().idx == 2
    assert nodes.follow(links, pages, 1).first().target_page_id == 2
    with pytest.raises(ValueError):
        nodes.follow(links, pages, 256)
    full = nodes.resolved(links, pages).select("page_id", "idx", F.col("target").alias("url"))
    assert crawl.next_page(full, "SEARCH", current=10).first()["row"] == 40
    assert crawl.next_page(full, "search", current=40).count() == 0
    assert [r.value for r in crawl.harvest(full, "row").collect()] == ["40", "30", "20"]
    assert nodes.leaf_nodes(table).where("page_id = 1").orderBy("idx").first().path == "/0.html/0.head"
    assert Engine(pages).only("http://h/i").leaf_nodes(True).count() == 2


def test_deep_pages_and_urls_stored_twice(spark):
    deep = "<div>" * 1500 + '<p>x</p><a href="/b">y</a>'
    pages = spark.createDataFrame([(1, "http://h/a", deep), (2, "http://h/b", None), (3, "http://h/b", ""), (4, None, "<a href='/b'>z</a>")], "page_id long, url string, html string")
    parsed = nodes.parse_pages(pages)
    paths = nodes.element_paths(parsed, "p").collect()
    assert [r.page_id for r in paths] == [1] and paths[0].path.count("/") == 1503 and paths[0].path.endswith("/0.div/0.p")
    got = sorted((r.page_id, r.target, r.target_page_id) for r in nodes.follow(nodes.link_urls(parsed), pages, 0).collect())
    assert got == [(1, "http://h/b", 2), (4, "/b", None)]  # one row a link, to the least page


def test_what_pages_are(spark):
    rows = [(1, "u", "<!doctype html><b>x<p>y</b></i>"), (2, None, '<!DOCTYPE foo PUBLIC "p" "s">'), (3, "v", None)]
    parsed = nodes.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(tuple(r)[:4] for r in nodes.parse_errors(parsed).collect()) == [(1, 0, "misnested", "b"), (1, 1, "stray end", "i"), (2, 0, "odd doctype", None), (3, 0, "no doctype", None)]
    assert [tuple(r) for r in nodes.documents_meta(parsed).orderBy("page_id").collect()] == [
        (1, "u", "html", "", "", "no-quirks"), (2, None, "foo", "p", "s", "quirks"), (3, "v", None, None, None, "quirks"),
    ]


def test_walks_end(spark):
    def page(n, to):
        return n, f"http://h/{n}", f'<h1>t{n}</h1><a href="/x">other</a>' + (f'<a href="{to}">Next Page</a><a href="/9">next page 2</a>' if to is not None else "")

    rows = [page(0, "1"), page(1, "/2"), page(2, "0"), page(5, "6"), page(6, None), page(7, "/none"), page(9, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def way(n):
        return [(r.page_id, r.depth, r.record.t) for r in crawl.walk(pages, f"http://h/{n}", "next page", {"t": el("h1").first_text()}).orderBy("depth").collect()]

    assert way(0) == [(0, 0, "t0"), (1, 1, "t1"), (2, 2, "t2")] and way(5) == [(5, 0, "t5"), (6, 1, "t6")]
    assert way(7) == [(7, 0, "t7")] and way(8) == [] and Engine(pages).walk("http://h/6", "next page", {"t": el("h1").first_text()}).count() == 1


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(8, 0), (20, 21), (3, 3), (None, 1)], "src long, dst long")
    got = dict(crawl.reachable(edges, spark.createDataFrame([(2,)], "node long")).collect())
    assert got == {(2 + i) % 9: i for i in range(9)}
    assert dict(crawl.reachable(edges, spark.createDataFrame([(2,)], "node long"), depth=1).collect()) == {2: 0, 3: 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    assert dict(crawl.reachable(chain, spark.createDataFrame([(0,)], "node long")).collect()) == {i: i for i in range(21)}


def test_predicates(spark):
    html = '<p id="a" class="">x</p><b disabled checked>y</b><svg><desc>d</desc></svg><math><mi>m</mi></math><datalist><option>o</datalist>'
    t = nodes.parse_html(spark.createDataFrame([(1, html)], "page_id long, html string")).where("kind = 'element'")

    def names(c):
        return sorted(r.name for r in t.where(c).select("name").collect())

    assert names(P.has_attribute("id")) == ["p"] and names(P.has_attribute_value("id", "A")) == [] and names(P.attribute_equals("id", "a")) == ["p"]
    assert names(P.is_disabled() & P.is_checked()) == ["b"] == names(P.is_formatting())
    assert "p" in names(P.attribute_missing_or_empty("class")) and names(P.attribute_count() == 2) == ["b", "p"]
    assert names(P.is_html_integration_point()) == ["desc"] and names(P.is_mathml_text_integration_point()) == ["mi"]
    r = t.where("name = 'p'").select(P.element_tag().alias("t"), P.element_tag(False).alias("n"), P.get_attribute("zz").alias("z"), P.set_attribute("id", "b").alias("s"), P.remove_attribute("id").alias("r")).first()
    assert (r.t, r.n, r.z, r.s["id"], "id" in r.r) == ('<p id="a" class="">', "p", None, "b", False)
    assert t.where("name = 'svg'").select(P.element_tag().alias("t")).first().t == "<svg/>"
    assert [x.name for x in P.with_ancestor(t, "datalist").where("has_ancestor").collect()] == ["option"]


# -- json, search, sources, sinks, streams


def test_json(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',), ("[1,]",), ("1",), (None,), ('{"x":[null,true,"é"]}',), ("[NaN]",)], "t string")
    assert [r.j for r in df.select(canonical_json("t").alias("j")).collect()] == ['{"a":1}', None, None, None, '{"x":[null,true,"é"]}', None]
    assert spark.range(1).select(write_json(F.struct(F.lit(None).cast("string").alias("n"))).alias("j")).first().j == '{"n":null}'


def test_search(spark):
    df = spark.createDataFrame([(1, "Banana"), (2, "band"), (3, None), (4, "")], "id long, title string")
    assert [r.id for r in search.search(df, "ANA").collect()] == [1]
    table = search.suffixes(df, "id")
    rng = random.Random(0)
    for term in ["ban", "ana", "a", "ND", "zz", "banana", *("".join(rng.choice("bands") for _ in range(3)) for _ in range(5))]:
        want = sorted(r.id for r in search.search(df, term).collect())
        assert sorted(r.id for r in search.search_suffixes(table, term).collect()) == want
    long = spark.createDataFrame([(1, "x" * 50 + "abcdef"), (2, "x" * 50 + "abcdeg"), (3, "İstanbul STRASSE"), (4, "abcx abcy")], "id long, title string")
    table = search.suffixes(long, "id", longest=5)
    for term in ["xxxxxxxxxxabcdef", "xxxxxxxxxxabcdeg", "xxxxxxxxxxabcdez", "abcx abcy", "abcx abcx", "stanbul str", "x" * 51, "bc", ""]:
        assert sorted(r.id for r in search.search_suffixes(table, term, 5).collect()) == sorted(r.id for r in search.search(long, term).collect()), term
    index = search.Index.write(spark, df.withColumns({"as_of": F.lit("d"), "source": F.lit("s")}), "id")
    assert [tuple(r) for r in index.search("ANA").collect()] == [(1, "Banana", "d", "s")] and index.search("zz").count() == 0
    assert json.loads(search.as_json_array(search.search(df, "ban"), "id").first().json) == [{"id": 1, "title": "Banana"}, {"id": 2, "title": "band"}]


def test_sources(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"x" * 100)[:-9])
    got = {r.path.rsplit("/")[-1]: r.content for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert (bytes(got["a.gz"]), bytes(got["b.txt"])) == (b"onetwo", b"plain")
    rows = [(1, 200, "Text/HTML; charset=windows-1252", b"\x93hi\x94"), (2, 200, "text/plain", "é".encode()), (3, 404, "text/html", b""), (4, None, "image/png", b""), (5, 200, "text/html; charset=none", b"x")]
    df = spark.createDataFrame(rows, "page_id long, status int, content_type string, body binary")
    ok, no = sources.by_status(df)
    assert sorted(r.page_id for r in no.collect()) == [3, 4]
    kinds = sources.dispatch(ok)
    assert [(r.page_id, r.html) for r in kinds["html"].collect()] == [(1, "“hi”")] and kinds["text"].first().text == "é"


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "bé", "x")], "id long, t string, n string")
    for _ in range(2):
        sinks.store(df, str(tmp_path / "s"), "one")
    sinks.store(df, str(tmp_path / "s"), "two")
    assert sinks.stored(spark, str(tmp_path / "s"), "one").count() == 4 and sinks.stored(spark, str(tmp_path / "s")).count() == 6
    got = []
    sinks.tee(df, lambda d: sinks.write_json_lines(d, str(tmp_path / "j")), lambda d: got.append(d.agg(sinks.byte_count("t")).first()[0]))
    assert got == [4] and '{"id":1,"t":"a","n":null}' in [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert [r.id for r in sinks.recent(df, 1, "id").collect()] == [2]
    for k, page in enumerate([(1, "u", "<p>a"), (2, "v", "<p>b<p>c")]):
        spark.createDataFrame([page], streaming.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.node_stream(streaming.read_stream(spark, str(tmp_path / "in"), files_per_trigger=1))
    query = streaming.run_to(stream, str(tmp_path / "cp"), streaming.store_batches(str(tmp_path / "out")), lambda d, n: got.append(n))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("name = 'p'").count() == 3 and len(got) == 3

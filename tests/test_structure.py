"""Structural joins, chains, forms in one expression and charsets, against brute force and values worked out by hand."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions import predicates as P
from pagemill.functions.dom import rows
from pagemill.operators import crawl, forms, nodes, structure
from pagemill.plans.extract import el
from pagemill.queries import QUERIES
from pagemill.sources import pages as sources


def some_pages(n=12):
    rng, parts = random.Random(5), ["<div>", "</div>", "<ul>", "<li>", "</ul>", "<p>x", "<b>", "</b>", "<table><tr><td>", "</table>", "y"]
    return [(i, "<!doctype html>" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_holders_equal_brute_force(spark):
    made = some_pages()
    table = nodes.parse_html(spark.createDataFrame(made, "page_id long, html string").repartition(3))
    holds, inside = F.col("name").isin("div", "li", "td"), F.col("kind") == "text"
    brute = {}
    for page, html in made:
        of = rows(html)
        for r in of:
            brute[page, r[2]] = [a[2] for a in reversed(of) if a[8] in ("div", "li", "td") and a[2] < r[2] <= a[3]]
    assert {(r.page_id, r.pre): list(r.holders) for r in structure.held(table, holds).collect()} == brute
    assert {(r.page_id, r.pre): list(r.holders) for r in structure.held(table, holds, depth=2).collect()} == {k: v[:2] for k, v in brute.items()}
    texts = {(p, r[2]) for p, html in made for r in rows(html) if r[6] == "text"}
    want = sorted((p, a, pre) for (p, pre), v in brute.items() if (p, pre) in texts for a in v)
    assert sorted(map(tuple, structure.joined(table, holds, inside).collect())) == want
    got = {(r.page_id, r.pre): r.has_ancestor for r in P.with_ancestor(table, "li").collect()}
    assert got == {(p, r[2]): any(a[8] == "li" and a[2] < r[2] <= a[3] for a in rows(html)) for p, html in made for r in rows(html)}
    part = table.where("kind = 'text'")
    assert {(r.page_id, r.pre): r.has_ancestor for r in P.with_ancestor(part, "li", among=table).collect()} == {k: got[k] for k in texts}


def test_holders_of_odd_rows(spark):
    table = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 5, "a"), (1, 2, 2, "b"), (None, 1, 1, "b"), (2, None, None, "a"), (2, 3, 3, None)], "page_id long, pre int, last int, name string")
    got = sorted((r.page_id or 0, r.pre or 0, r.name or "", list(r.holders)) for r in structure.held(table, F.col("name") == "a").collect())
    assert got == [(0, 1, "b", []), (1, 0, "a", []), (1, 0, "a", []), (1, 2, "b", [0]), (2, 0, "a", []), (2, 3, "", [])]
    assert structure.held(table.limit(0), F.col("name") == "a").count() == 0
    with pytest.raises(ValueError):
        structure.held(table.withColumn("holders", F.lit(1)), F.lit(True))


def test_a_large_page_is_merged_in_one_shuffle(spark, capsys):
    big = [(1, i, 49_999 if i % 1000 == 0 else i, "div" if i % 1000 == 0 else "p") for i in range(50_000)]
    table = spark.createDataFrame(big, "page_id long, pre int, last int, name string").cache()
    table.count()
    found = structure.joined(table, F.col("name") == "div", F.col("name") == "p", depth=1)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan
    began = time.time()
    assert found.agg(F.max("holder"), F.count("*")).first()[:] == (49_000, 49_950)
    assert time.time() - began < 6


def test_chains_equal_a_plain_walk(spark):
    rng = random.Random(3)
    to = {i: rng.randrange(400) for i in range(400) if rng.random() < 0.97}
    to |= {1000 + i: 1001 + i for i in range(3000)}
    edges = list(to.items()) + [(5000, 7), (5000, 3), (None, 1), (4, None)]
    to |= {5000: 3}
    starts = [(0,), (1,), (1,), (17,), (1000,), (2500,), (5000,), (9999,), (None,)]
    got = sorted(map(tuple, crawl.chains(spark.createDataFrame(edges, "src long, dst long").repartition(5), spark.createDataFrame(starts, "s long")).collect()))
    want = []
    for (s,) in set(starts) - {(None,)}:
        node, seen = s, {}
        while node is not None and node not in seen:
            seen[node] = len(seen)
            node = to.get(node)
        want += [(s, n, d) for n, d in seen.items()]
    assert got == sorted(want)
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, crawl.chains(none, spark.createDataFrame([(1,)], "s long")).collect())) == [(1, 1, 0)]
    assert crawl.chains(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(None,)], "s long")).count() == 0


def test_walks_take_the_least_page_of_a_url(spark):
    page = lambda i, url, to: (i, url, f"<h1>t{i}</h1><a href='{to}'>next page</a>")
    made = [page(1, "http://h/1", "/2"), page(2, "http://h/2", "/4"), page(3, "http://h/2", "/5"), page(4, "http://h/4", "x"), page(5, "http://h/5", "x"), (6, None, None), (7, "http://h/7", "")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    of = lambda start, rows=pages: sorted((r.depth, r.page_id, r.url, r.record.t) for r in crawl.walk(rows, start, "next page", {"t": el("h1").first_text()}).collect())
    assert of("http://h/1") == [(0, 1, "http://h/1", "t1"), (1, 2, "http://h/2", "t2"), (2, 4, "http://h/4", "t4")]
    assert of("http://h/2")[0][1] == 2 and of(None) == [] and of("http://h/1", pages.limit(0)) == []
    assert [r[:2] for r in of("http://h/1", pages.unionByName(pages))] == [(0, 1), (1, 2), (2, 4)]


FORM = """<form id=A><input name=q value=1><textarea name=t value=v>text <b></textarea><input type=CheckBox name=c><datalist><input name=l></datalist>
<input type=IMAGE name=i><input name=Q value=2></form><form id=xb action=/b method=post><input name=k></form>"""


def test_forms_in_one_expression(spark, capsys):
    pages = spark.createDataFrame([(1, "http://h/p", FORM), (2, "http://h/e", None), (3, "http://h/f", "<form></form>")], "page_id long, url string, html string")
    parsed = nodes.parse_pages(pages)
    sent = forms.submitted(parsed, {"Q": "é", "none": "x"})
    sent.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    got = {(r.page_id, r.method): (r.url, r.body) for r in sent.collect()}
    # types are compared as they are written, so CheckBox is a text field and IMAGE sends its value
    assert got[1, "GET"] == ("http://h/p?q=%C3%A9&t=v&c=&i=&Q=2", None) and got[1, "POST"] == ("http://h/b", "k=") and got[3, "GET"] == ("http://h/f?", None)
    standard = {(r.page_id, r.method): r.url for r in forms.submitted(parsed, standard=True).collect()}
    assert standard[1, "GET"] == "http://h/p?q=1&t=text+%3Cb%3E&Q=2"
    one = forms.page_forms(parsed).where("page_id = 1").select(
        forms.first_form(F.col("forms"), "B")["id"].alias("f"), forms.first_form(F.col("forms"), "zz").alias("none"),
        forms.first_control(F.col("forms")[0]["controls"], "Q")["pre"].alias("pre"), F.size("forms").alias("n"),
    ).first()
    assert (one.f, one.none, one.n) == ("xb", None, 2) and one.pre is not None
    flat = forms.requests(nodes.forms(parsed), forms.data_sets(forms.set_control_value(forms.controls(parsed), "q", "é")))
    assert sorted(map(str, flat.collect())) == sorted(map(str, sent.collect()))


def test_results_of_links(spark):
    made = [(1, 0, "http://h/search?row=5&id=a"), (1, 1, "http://h/SEARCH?row=7&id=b+c"), (1, 2, "http://h/search/x?row=9"), (2, 0, "http://h/search?row=1"), (3, 0, "http://h/"), (4, 0, None)]
    links = spark.createDataFrame(made, "page_id long, idx int, url string")
    assert sorted(map(tuple, crawl.results(links, "search", "id", current=4).collect())) == [(1, 7, "http://h/SEARCH?row=7&id=b+c", ["b c", "a"]), (2, None, None, [])]
    assert crawl.next_page(links, "search", current=4).collect()[0][:] == (1, 7, "http://h/SEARCH?row=7&id=b+c")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (b"<meta charset=latin1>", "latin1"), (b"<META  CHARSET='koi8-r' />", "koi8-r"), (b"x<meta http-equiv='Content-Type' content=\"text/html; charset=koi8-r\">", "koi8-r"),
        (b"<meta content='text/html; charset=koi8-r'>", None), (b"<meta name=d content='a charset=b'><meta charset=\"x\">", "x"), (b"<!--<meta charset=a>--><meta charset=b>", "b"),
        (b"<!--<meta charset=a>", None), (b"<a title='<meta charset=a>'><meta charset=b>", "b"), (b"<meta charset=utf-16le>", "utf-8"), (b"<meta charset=x-user-defined>", "windows-1252"),
        (b"\xef\xbb\xbf<meta charset=latin1>", "utf-8"), (b"\xff\xfe<\0", "utf-16le"), (b"\xfe\xff\0<", "utf-16be"), (b" " * 1020 + b"<meta charset=a>", None), (b"", None), (None, None),
        (b"<metax charset=a>", None), (b"<meta charset=>", None),
    ],
)
def test_documents_name_their_charset(spark, body, want):
    df = spark.createDataFrame([(body,)], "b binary")
    assert df.select(sources.prescanned(F.col("b")).alias("c")).first().c == want


def test_bodies_by_their_own_charset(spark):
    made = [
        (1, "text/html", '<meta charset="koi8-r">да'.encode("koi8-r")), (2, "text/html; charset=utf-8", '<meta charset="koi8-r">да'.encode()), (3, "text/html", "да".encode("utf-16")),
        (4, "text/plain", b"<meta charset=latin1>\xc3\xa9"), (5, "text/html", "é".encode()), (6, "text/html", None), (7, "text/html", b"<meta charset=no-such>x"),
    ]
    kinds = sources.dispatch(spark.createDataFrame(made, "page_id long, content_type string, body binary"))
    got = {r.page_id: r.html for r in kinds["html"].collect()} | {r.page_id: r.text for r in kinds["text"].collect()}
    assert got == {1: '<meta charset="koi8-r">да', 2: '<meta charset="koi8-r">да', 3: "да", 4: "<meta charset=latin1>é", 5: "é"}


def test_damaged_gzip_files_are_null(spark, tmp_path):
    whole = gzip.compress(bytes(random.Random(1).randbytes(5000)))
    for name, raw in {"cut": whole[:3000], "no_trailer": whole[:-8], "half_trailer": whole[:-3], "whole": whole, "two": whole + whole, "tail": whole + b"xx"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/")[-1]: None if r.content is None else len(r.content) for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert got == {"cut": None, "no_trailer": None, "half_trailer": None, "whole": 5000, "two": 10_000, "tail": 5000}


def test_stored_responses_are_read_by_partition(spark, tmp_path, capsys):
    made = [(1, 200, "Text/HTML; charset=x", b"a"), (2, 404, "text/html", b"b"), (3, 200, "image/png", b"c"), (4, None, None, None), (5, 200, "text/plain", b"d"), (6, 200, None, b"e")]
    responses = spark.createDataFrame(made, "page_id long, status int, content_type string, body binary")
    sources.store_responses(responses, str(tmp_path / "r"))
    found = sources.read_responses(spark, str(tmp_path / "r"))
    assert sorted(r.page_id for r in found.collect()) == [1, 5] and found.columns == responses.columns
    found.explain()
    assert "PartitionFilters: [isnotnull(status_is" in capsys.readouterr().out and len(found.inputFiles()) >= 2
    schema = "page_id long, status int, content_type string, body binary, status_is int, kind string"
    got = []
    stream = sources.read_responses(spark, str(tmp_path / "r"), ("text/html",), True, schema)
    run = lambda: stream.writeStream.foreachBatch(lambda df, n: got.extend(r.page_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    sources.store_responses(responses.where("page_id = 1").withColumn("page_id", F.lit(9).cast("long")), str(tmp_path / "r"))
    run()
    assert got == [1, 9]


def test_the_engine_leads_to_all_operators(spark):
    from pagemill.engine import Engine
    from pagemill.plans.steps import Link, Submit

    made = [(1, "http://h/", "<title>Home page</title><a href=b>to b</a><form id=f action=/b></form>"), (2, "http://h/b", "<title>A page</title><h1>B</h1></i>"), (3, "http://h/b?", "<h1>C</h1>")]
    e = Engine(spark.createDataFrame(made, "page_id long, url string, html string"))
    start = spark.createDataFrame([("http://h/",)], "u string")
    assert [r.record.t for r in e.flow(start, [Link("to b")], {"t": el("h1").first_text()}).collect()] == ["B"]
    assert e.flow(start, [Submit("f")]).first().page_id == 3
    assert ("stray end", "i", 1, 32) in {(r.error, r.tag, r.line, r.col) for r in e.errors().collect()}
    assert sorted(r.id for r in e.index().search("PAGE").collect()) == [1, 2] and e.index().longest_repeat().first().passage == " page"
    assert e.only("http://h/b").links().count() == 0 and e.nodes().where("name = 'h1'").count() == 2


def test_reachability_of_odd_tables(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, None), (None, 3), (2, 2)], "src long, dst long")
    start = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    of = lambda e, s: sorted(map(tuple, crawl.reachable(e, s).collect()))
    assert of(edges, start(1, 1, None)) == [(1, 0), (2, 1)] and of(edges, start(None)) == [] and of(edges, start()) == []
    assert of(edges.limit(0), start(7)) == [(7, 0)]


def test_an_index_of_odd_records(spark):
    from pagemill.operators.search import Index, as_json_array

    made = [(1, "An Apple", "2026", "s"), (1, "an apple pie", "2026", "s"), (2, None, None, None), (3, "", "2026", "s"), (4, "Pineapple", None, "t")]
    records = spark.createDataFrame(made, "page_id long, title string, as_of string, source string").withColumn("suffix", F.lit(1))
    index = Index.write(spark, records, "page_id", longest=4)
    assert sorted((r.page_id, r.title) for r in index.search("APPLE").collect()) == [(1, "An Apple"), (1, "an apple pie"), (4, "Pineapple")]
    assert Index.write(spark, records.limit(0), "page_id").search("a").count() == 0
    assert as_json_array(records.select("page_id").where("page_id > 2"), "page_id").first().json == '[{"page_id":3},{"page_id":4}]'
    with pytest.raises(Exception, match="more than 2"):
        as_json_array(records.select("page_id"), "page_id", most=2).collect()


def test_holders_by_name_and_pages_parsed_once(spark):
    made = [(1, "<ul><li><ul><li><b>x</b></ul><p>y</ul><h1>z"), (2, None)]
    table = nodes.parse_html(spark.createDataFrame(made, "page_id long, html string"))
    got = structure.held(table, F.col("name").isin("ul", "li"), by=F.upper("name")).where("kind = 'element'")
    assert sorted((r.name, list(r.holders)) for r in got.collect() if r.page_id == 1) == sorted(
        [("html", []), ("head", []), ("body", []), ("ul", []), ("li", ["UL"]), ("ul", ["LI", "UL"]), ("li", ["UL", "LI", "UL"]), ("b", ["LI", "UL", "LI", "UL"]), ("p", ["LI", "UL"]), ("h1", [])]
    )
    plan = QUERIES["link_holders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join") == 0  # the parser and the merge


def test_texts_are_decoded_once_and_in_pieces(spark):
    plan = QUERIES["own_charsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    made = [(i, "text/html", c, x) for i, (c, x) in enumerate([("latin1", b"\xe9" * 700_000), ("utf-8", "é".encode() * 700_000 + b"\xff"), ("none", b"x"), (None, b"x"), ("utf-16le", b""), ("utf-8", None)])]
    df = spark.createDataFrame(made, "i int, content_type string, charset string, body binary").coalesce(1)
    got = {r.i: r.t for r in df.select("i", sources.decode_legacy("body", "charset").alias("t")).collect()}
    assert got == {0: "é" * 700_000, 1: "é" * 700_000 + "�", 2: None, 3: None, 4: "", 5: None}
    kinds = sources.dispatch(df.where("charset = 'latin1'").drop("charset"))
    assert kinds["html"].columns == ["i", "content_type", "body", "html"] and kinds["text"].count() == 0

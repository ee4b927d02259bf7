"""The registered queries over pages, and the SQL that DuckDB can hold them to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions.json_text import canonical_json
from .functions.urls import append_segment, decode_value, encode_value, query_pairs, strict_split, url_part
from .operators import crawl, forms, nodes, search, structure
from .operators.nodes import parse_html, parse_pages
from .operators.suffix_array import SuffixArray
from .plans.extract import deep_text, each, el, extract, obj, scope
from .plans.flows import LISTING_SOURCE, MOVIE, MOVIE_SOURCE, listing_records, movie_records
from .plans.steps import Paged, Submit, Visit, flow
from .sources import pages as sources
from .sources import sinks
from .sources.pages import read_pages


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def _parsed(spark, sf_dir) -> DataFrame:
    """Titles and headings of the pages were cut after they had been escaped: a last &amp without its semicolon stays as it is written, as in the SQL."""
    return parse_pages(_pages(spark, sf_dir), closed=True)


def _nodes(spark, sf_dir) -> DataFrame:
    return parse_html(_pages(spark, sf_dir), closed=True)


def _made(spark, sf_dir, *html) -> DataFrame:
    """The pages with other html, put together from strings and columns of theirs."""
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in html]
    return _pages(spark, sf_dir).withColumn("html", F.concat(*parts))


def _parsed_of(spark, sf_dir, *html) -> DataFrame:
    return parse_pages(_made(spark, sf_dir, *html))


def _titles(spark, sf_dir) -> DataFrame:
    """A title of each page, as in the SQL: empty where a page has none, null where it has no html."""
    pages = _pages(spark, sf_dir).withColumn("stored", F.col("html").isNotNull())
    return nodes.titles(parse_pages(pages, keep=["stored"], closed=True), F.when(F.col("stored"), ""))


def page_titles(spark, sf_dir):
    return _titles(spark, sf_dir)


def page_links(spark, sf_dir):
    return nodes.links(_parsed(spark, sf_dir)).select("page_id", "idx", "text", "url", "is_iframe")


def links_resolved(spark, sf_dir):
    return nodes.resolved(nodes.link_urls(_parsed(spark, sf_dir))).select("page_id", "idx", "target")


def link_first_match(spark, sf_dir):
    return nodes.find_link(nodes.links(_parsed(spark, sf_dir)), "TION").select("page_id", "idx", "text", "url")


def tag_counts(spark, sf_dir):
    found = _nodes(spark, sf_dir).where(P.is_in_namespace("html") & F.col("name").isin("a", "li", "h1", "p", "title", "article"))
    return found.groupBy("name").agg(F.count("*").alias("n"))


def element_counts(spark, sf_dir):
    """All elements by name. Of b there are more than tags: an unclosed one is opened again in every paragraph after it."""
    found = _nodes(spark, sf_dir).where("kind = 'element'")
    return found.groupBy("namespace", "name").agg(F.count("*").alias("n"))


def comment_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).where("kind = 'comment'").groupBy("page_id").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


def attr_filter(spark, sf_dir):
    """Ads: div elements whose class equals ad; and links whose url starts with /th, by page."""
    found = _nodes(spark, sf_dir).where(P.has_element_name("div") | P.has_element_name("a"))
    return found.groupBy("page_id").agg(
        F.count_if((F.col("name") == "div") & P.has_attribute_value("class", "ad")).alias("ads"),
        F.count_if((F.col("name") == "a") & F.coalesce(P.get_attribute("href").startswith("/th"), F.lit(False))).alias("th_links"),
    )


def leaf_counts(spark, sf_dir):
    """Leaves of each page by kind."""
    found = _nodes(spark, sf_dir).where("pre = last and kind <> 'document'")
    return found.groupBy("page_id").agg(F.count("*").alias("leaves"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("element", "comment", "doctype")])


def node_paths(spark, sf_dir):
    return nodes.element_paths(_parsed(spark, sf_dir), "title").select("page_id", "path", "depth")


def paragraph_texts(spark, sf_dir):
    """Each page's paragraphs: their number, and a digest of their texts in order."""
    found = nodes.element_texts(_parsed(spark, sf_dir), "p").groupBy("page_id")
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    return found.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.md5(every.cast("binary")).alias("texts"))


def articles_json(spark, sf_dir):
    """A record of each article: its heading and its paragraphs."""
    template = [each(el("article"), {"title": el("h1").first_text(), "paras": [each(el("p"), {"text": deep_text()})]})]
    got = extract(_parsed(spark, sf_dir), template).select("page_id", F.explode("record").alias("r"))
    said = F.array_join(F.transform("r.paras", lambda x: x["text"]), "\n")
    return got.select("page_id", "r.title", F.size("r.paras").alias("n_paras"), F.md5(said.cast("binary")).alias("paras"))


def nav_links_by_ad(spark, sf_dir):
    """Scoped members: the ad's text, then the navigation's links under their own scope."""
    links = [each(el("a"), obj(("text", deep_text()), scope(), ("list", "nav")))]
    template = obj(scope(el("div").equals("class", "ad")), ("ad", deep_text()), scope(el("nav")), ("links", links), ("first", el("a").attr("href")))
    got = extract(_parsed(spark, sf_dir), template)
    return got.select("page_id", "record.ad", "record.first", F.size("record.links").alias("n_links"), F.array_join(F.transform("record.links", lambda x: x.text), "|").alias("texts"))


def page_meta(spark, sf_dir):
    return nodes.documents_meta(_parsed(spark, sf_dir)).select("page_id", "url", "doctype", "mode")


def error_counts(spark, sf_dir):
    """Parse errors of all pages by kind and tag."""
    return nodes.parse_errors(_parsed(spark, sf_dir)).groupBy("error", "tag").agg(F.count("*").alias("n"))


# -- operators that the pages have nothing for: over html made of the pages' own columns


def listing_template(spark, sf_dir):
    """The first production template over listing pages of two results, one with offers."""
    n = F.col("page_id")
    offer = '<tr><td class="clabel">{}</td><td>-</td><td class="cpriceR">${}</td></tr>'
    first = '<div id="btfResults"><ul><li id="result_1"><span class="lrg bold">T<b>', n, '</b></span><span class="med reg subt">', n % 50 + 1970, '</span><img src="/i/', n
    rest = '.png"><table>' + offer.format("Rent <i>HD</i>", 3) + "<tr><td>none</td></tr>" + offer.format("Buy", 9) + '</table></li><li id="result_2">plain ', n
    got = listing_records(_made(spark, sf_dir, '<li id="result_0">no</li>', *first, *rest, "</li><li>other</li></ul></div>"))
    offers = F.array_join(F.transform("offers", lambda o: F.concat_ws("=", o["label"], o["price"])), ";")
    return got.select("page_id", "title", "date", "img", "source", offers.alias("offers"))


def movie_template(spark, sf_dir):
    """The second production template over a page of one movie."""
    n = F.col("page_id")
    html = '<h2 class="title">no</h2><div id="mdp-overview"><h2 class="title">Film ', n, '</h2><span class="year">', n % 50 + 1970, '</span><div id="mdp-boxshot"><img src="/b/', n
    more = '.png"></div><div id="mdp-metadata-content"><a>streaming</a> <a>D', F.when(n % 2 == 0, "VD").otherwise("vd"), "</a><a>stream<b>ing</b></a></div></div>"
    got = movie_records(_made(spark, sf_dir, *html, *more))
    return got.select("page_id", "title", "date", "img", "source", F.array_join(F.transform("offers", lambda o: o["label"]), ";").alias("offers"))


def form_requests(spark, sf_dir):
    """What submitting the forms of each page sends: one by GET with many controls, which not all pages have, one by POST, one that can't be sent."""
    n, u = F.col("page_id"), F.col("url")
    box = F.when(n % 3 == 0, "checked").otherwise("")
    get = '<form action="/go?old=1" id=F><input name=', F.when(n % 4 == 3, "z").otherwise("a"), ' value="x y"><input type=checkbox name=c ', box, "><input type=checkbox name=d value=1><input name=off disabled value=1>"
    rest = '<button name=b>B</button><input name="u" value="', u, '"><select name=s><option>o</select><datalist><input name=l value=1></datalist></form>'
    post = F.when(n % 5 != 4, F.concat(F.lit('<form method=post><input type=hidden name=n value="'), n, F.lit('"><textarea name=t value="a&amp;b">x</textarea></form>'))).otherwise("")
    pages = _made(spark, sf_dir, *get, *rest, post, "<form method=put><input name=z></form>")
    sent = forms.submitted(parse_pages(pages), {"A": "p q"})
    return forms.submit(sent, pages).select("page_id", "form_id", "method", "url", "body", "error", F.col("target_page_id").cast("string").alias("stored"))


def form_texts(spark, sf_dir):
    """The data sets of each page's form by the public standard: a textarea's text, types in any case."""
    n = F.col("page_id")
    html = '<form><textarea name=t value=v>text ', n, "</textarea><input type=", F.when(n % 2 == 0, "CHECKBOX").otherwise("Text"), " name=c></form>"
    found = forms.page_forms(_parsed_of(spark, sf_dir, *html), text=True).select("page_id", F.inline("forms"))
    said = [forms.describe(forms.data_set(F.col("controls"), standard)).alias(name) for name, standard in (("as_attributes", False), ("as_texts", True))]
    return found.select("page_id", *said)


def form_controls(spark, sf_dir):
    """The controls of each page's first form whose name holds f, if it has one, and its first control named q in any case."""
    n = F.col("page_id")
    html = "<form id=", F.when(n % 4 == 1, "none").when(n % 4 == 2, "Of").otherwise("F"), "><input name=", F.when(n % 3 == 0, "x").otherwise("Q"), ' value="', n
    rest = '"><table><tr><td><input type=radio name=r></table><label>x</label>', F.when(n % 2 == 0, "<input name=q>").otherwise(""), "</form><input name=out><form id=G><input name=g></form>"
    found = forms.page_forms(_parsed_of(spark, sf_dir, *html, *rest)).select("page_id", forms.first_form(F.col("forms"), "f").alias("f")).where("f is not null")
    names = F.array_join(F.transform("f.controls", lambda c: c["name"]), ",")
    q = P.get_attribute("value", forms.first_control(F.col("f.controls"), "q")["attrs"])
    return found.select("page_id", F.col("f.id").alias("form"), names.alias("names"), q.alias("q"))


def followed_links(spark, sf_dir):
    """Each page's second link, to the url of the page ten before it, followed to the stored page."""
    pages = _pages(spark, sf_dir)
    to = pages.select((F.col("page_id") + 10).alias("page_id"), F.col("url").alias("to"))
    html = F.concat(F.lit('<a href="#top">top</a><a href="'), F.coalesce(F.regexp_replace("to", "&", "&amp;"), F.lit("/none")), F.lit('">before</a>'))
    made = pages.join(to, "page_id", "left").withColumn("html", html).select("page_id", "url", "html")
    return nodes.follow(nodes.link_urls(parse_pages(made)), pages, 1).select("page_id", "target", F.col("target_page_id").cast("string").alias("stored"), "is_iframe")


def next_pages(spark, sf_dir):
    """Paging by rows: the last link to the search path whose row is above the current one, if there is one; and harvested movie ids, last first."""
    n = F.col("page_id")
    later = F.when(n % 3 == 0, n * 10 + 1).otherwise(n * 10 + 20)
    html = '<a href="/search?row=', n * 10, '&movieid=7">a</a><a href="/Search?row=', later, "&x=", n, '&movieid=m+', n, '">b</a>', F.when(n % 5 == 0, F.concat(F.lit('<a href="/search?row='), n * 10 + 9, F.lit('">c</a>'))).otherwise(""), '<a href="/other?row=999999999">d</a>'
    links = nodes.resolved(nodes.link_urls(_parsed_of(spark, sf_dir, *html))).withColumnRenamed("url", "href").withColumnRenamed("target", "url")
    page = crawl.results(links, "search", "movieid", current=F.col("page_id") * 10 + 5)
    return page.select("page_id", "row", F.regexp_extract("url", "^[^/]*//[^/]*(/.*)$", 1).alias("path"), F.array_join("values", "|").alias("ids"))


def paged_listing(spark, sf_dir):
    """The listing flow over stored pages: from page 0, whatever a page's first "next page" link leads to, until there is none; titles of all. Pages
    whose number ends with 8 or 9 share a url, of which the lesser counts, and links are written in several ways."""
    n = F.col("page_id")
    to = F.when(n % 10 == 7, n + 1).when(n % 10 == 8, n + 2).otherwise(n + 1).cast("string")
    link = F.when(n % 3 == 0, F.concat(F.lit('<a href="/list/'), to, F.lit('">Next page</a><a href="/list/0">next page</a>'))).when(n % 3 == 1, F.concat(F.lit('<a href="'), to, F.lit('">the NEXT PAGE</a>')))
    html = '<a href="/list/3">back</a><span class="t">title ', n, "</span>", link.otherwise(F.concat(F.lit('<a href="http://shop.example/list/'), to, F.lit('"><b>next</b> page</a>')))
    pages = _made(spark, sf_dir, *html).withColumn("url", F.concat(F.lit("http://shop.example/list/"), F.when(n % 10 == 9, n - 1).otherwise(n)))
    return crawl.walk(pages, "http://shop.example/list/0", "next page", {"title": el("span").equals("class", "t").first_text()}).select("page_id", "depth", "record.title")


def link_holders(spark, sf_dir):
    """How many elements of each name stand right within which list, navigation or article: a structural join of the flat node table. Pages are parsed
    once, and only elements that hold or are counted leave the scan."""
    kinds, counted = ("nav", "ul", "li", "article"), ("a", "li", "ul", "h1")
    table = _nodes(spark, sf_dir).where((F.col("kind") == "element") & F.col("name").isin(*kinds, *counted)).select("page_id", "pre", "last", "name")
    found = structure.held(table, F.col("name").isin(*kinds), depth=1, by=F.col("name")).where(F.col("name").isin(*counted))
    return found.select("name", F.try_element_at("holders", F.lit(1)).alias("within")).groupBy("name", "within").agg(F.count("*").alias("n"))


def own_charsets(spark, sf_dir):
    """Pages whose bytes name their charset themselves: by a meta element, one in a comment before it, or a byte order mark; or not at all."""
    n, k = F.col("page_id"), F.col("page_id") % 6
    text = F.regexp_replace("html", "[^\\x{0}-\\x{FF}]", "?")
    headed = (k == 0) & (n % 4 == 0)  # the header goes before what the document says
    meta = F.when(headed, "<meta charset=utf-8>").when(k == 0, '<meta charset="ISO-8859-1">').when(k == 1, "<!--<meta charset=utf-8>--><META http-equiv=Content-Type content='text/html; charset=latin1'>").when(k == 2, "<meta name=x content='charset=latin1'>").when(k == 3, "<meta charset=utf-16>").otherwise("")
    whole = F.concat(meta, text)
    body = F.when(k < 2, F.encode(whole, "ISO-8859-1")).when(k == 4, F.encode(F.concat(F.lit("\ufeff"), whole), "UTF-16LE")).when(k == 5, F.encode(F.concat(F.lit("\ufeff"), whole), "UTF-8")).otherwise(F.encode(whole, "UTF-8"))
    kind = F.when(headed, "text/html;charset=windows-1252").otherwise("Text/HTML")
    got = _pages(spark, sf_dir).select("page_id", kind.alias("content_type"), body.alias("body"), F.length(meta).alias("skip"))
    return sources.dispatch(got)["html"].select("page_id", F.md5(F.expr("substring(html, skip + 1)").cast("binary")).alias("text"))


def page_files(spark, sf_dir):
    """Pages written as gzip files and read back whole: bytes of all of them."""
    path = f"{sinks.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    pages = _pages(spark, sf_dir).select(F.regexp_replace("html", "[\r\n]", " ").alias("value"))
    pages.write.option("compression", "gzip").text(path)
    return sources.read_files(spark, path, "*.gz").agg(F.sum(F.octet_length("content")).alias("bytes"), F.count_if(F.col("content").isNull()).alias("damaged"))


def stored_records(spark, sf_dir):
    """Titles stored under two sources and as JSON lines in one pass, read back by source."""
    path = f"{sinks.shared_folder(spark)}/records-{uuid.uuid4().hex}"
    of = _titles(spark, sf_dir)
    even, odd = of.where("page_id % 2 = 0"), of.where("page_id % 2 = 1")
    sinks.store(even, f"{path}/store", "even")
    sinks.tee(odd, lambda df: sinks.store(df, f"{path}/store", "odd"), lambda df: sinks.write_json_lines(df, f"{path}/lines"))
    lines = spark.read.json(f"{path}/lines", schema="page_id long, title string").withColumn("source", F.lit("lines"))
    return sinks.stored(spark, f"{path}/store", "even").unionByName(sinks.stored(spark, f"{path}/store", "odd")).unionByName(lines).select("page_id", "title", "source")


def leaf_texts(spark, sf_dir):
    """The leaf nodes of each page's list, by their paths."""
    n = F.col("page_id")
    html = "<!doctype html><ul><li>a ", n, "<li>b<br>", F.when(n % 3 == 0, "<!--c-->").when(n % 3 == 1, "d<i></i>").otherwise(""), "</ul>"
    return nodes.leaf_nodes(_parsed_of(spark, sf_dir, *html), verbose=True).where("path like '%.ul%'").select("page_id", "idx", "path", "text", "shown")


def movie_flow(spark, sf_dir):
    """The movie flow over stored pages, from the home page of every eight: search, page through the results, visit each movie, read its record. Some
    home pages have no form or one that can't be sent, some searches lead nowhere, some movies aren't stored."""
    g, i = F.floor(F.col("page_id") / 8), F.col("page_id") % 8
    shop = F.concat(F.lit("http://m"), g)
    form = F.when(g % 5 == 1, "<p>no form").otherwise(F.concat(F.lit("<form action='/search' method="), F.when(g % 5 == 2, "put").otherwise("get"), F.lit("><input name=v1 value=old></form>")))
    more = F.concat(F.lit('<a href="/search?row=10">other</a><a href="/Search?row='), i * 10, F.lit('&v1=x">next</a><a href="/search/x?row=99">no</a>'))
    ids = F.concat(F.lit('<a href="/movie?movieid='), g, F.lit("-"), i + 3, F.lit('">m</a>'))
    film = F.concat(F.lit('<div id="mdp-overview"><h2 class="title">Film '), g, F.lit("-"), i, F.lit("</h2></div>"))
    html = F.when(i == 0, form).when(i.isin(1, 2), F.concat(ids, more)).otherwise(film)
    url = F.when(i == 0, shop).when((i == 1) & (g % 3 != 2), F.concat(shop, F.lit("/search?v1=a+b"))).when((i == 2) & (g % 4 != 3), F.concat(shop, F.lit("/Search?row=10&v1=x"))).when(i.isin(4, 5) & (g % 7 != 3), F.concat(F.lit("http://films/"), g, F.lit("-"), i)).otherwise(F.concat(shop, F.lit("/"), i))
    pages = _pages(spark, sf_dir).withColumns({"html": html, "url": url})
    steps = [Submit("search", {"V1": "a b"}), Paged("search"), Visit("movieid", "http://films/")]
    found = flow(pages, pages.where("page_id % 8 = 0").select("url"), steps, MOVIE)
    return found.select("start", "step", "page_id", "error", F.col("record.title").alias("title"))


def title_array(spark, sf_dir):
    """A stored suffix array of titles: the titles that hold a term, and the length of the longest passage that is repeated."""
    index = SuffixArray.write(nodes.titles(_parsed(spark, sf_dir)), "page_id")
    held = index.search("THAN").select("id").distinct().select(F.col("id").alias("page_id"), F.lit("than").alias("what"), F.lit(None).cast("int").alias("length"))
    return held.unionByName(index.longest_repeat().select(F.lit(None).cast("long").alias("page_id"), F.lit("repeat").alias("what"), "length"))


def responses(spark, sf_dir):
    """Stored responses by status and media type, their bytes decoded by the charset that they name."""
    n, html = F.col("page_id"), F.col("html")
    kind = F.when(n % 4 == 0, "Text/HTML; charset=utf-8").when(n % 4 == 1, "text/html; charset=UTF-16LE").when(n % 4 == 2, "text/plain").otherwise("image/png")
    body = F.when(n % 4 == 1, F.encode(html, "UTF-16LE")).otherwise(F.encode(html, "UTF-8"))
    got = _pages(spark, sf_dir).select("page_id", F.when(n % 7 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), body.alias("body"))
    ok, _ = sources.by_status(got)
    kinds = sources.dispatch(ok)
    of = lambda k, c: kinds[k].select("page_id", F.lit(k).alias("kind"), F.md5(F.col(c).cast("binary")).alias("text"))
    return of("html", "html").unionByName(of("text", "text"))


def byte_counts(spark, sf_dir):
    """Bytes of pages by the scheme of their url."""
    return _pages(spark, sf_dir).groupBy(url_part(F.col("url"), "PROTOCOL").alias("scheme")).agg(sinks.byte_count("html").alias("bytes"), F.count("*").alias("pages"))


def recent_pages(spark, sf_dir):
    """The last ten entries, the latest first: a feature, not a cut of the input."""
    return sinks.recent(_pages(spark, sf_dir).select("page_id", "url"), 10, "page_id")


def json_texts(spark, sf_dir):
    """JSON texts of each page, of which the first of repeated names counts, and which aren't texts if their root is no array or object."""
    n = F.col("page_id").cast("string")
    text = F.when(F.col("page_id") % 5 == 4, n).otherwise(F.concat(F.lit('{"id": '), n, F.lit(', "x": [null, true, "é"], "id": 0}')))
    return _pages(spark, sf_dir).select("page_id", canonical_json(text).alias("json"))


def escaped_pairs(spark, sf_dir):
    """Decoded queries with escapes, bad escapes, repeated names and a change of charset."""
    n = F.col("page_id").cast("string")
    query = F.concat(F.lit("q=a+b%2B"), n, F.lit("&q=2&bad=%zz%4&e=%C3%A9&_charset_=iso-8859-1&e=%E9&&last="))
    got = _pages(spark, sf_dir).select("page_id", F.posexplode(query_pairs(query)).alias("idx", "p"), decode_value(query).alias("whole"))
    return got.select("page_id", "idx", "p.name", "p.value", F.when(F.col("idx") == 0, F.substring("whole", 1, 6)).alias("whole"))


def element_predicates(spark, sf_dir):
    """How many elements of a page each predicate holds for."""
    n = F.col("page_id")
    html = '<p id="', n, '" class="">x<b disabled checked>y</b><svg><desc>d</desc></svg><math><mi>m</mi></math><datalist><option>o</datalist><input name=i><textarea></textarea><object></object>'
    of = P.with_ancestor(parse_html(_made(spark, sf_dir, *html)), "datalist").where("kind = 'element'")
    count = {
        "disabled": P.is_disabled(), "checked": P.is_checked(), "formatting": P.is_formatting(), "form_associated": P.is_form_associated(), "submittable": P.is_submittable(),
        "math_text": P.is_mathml_text_integration_point(), "html_point": P.is_html_integration_point(), "no_class": P.attribute_missing_or_empty("class"),
        "two_attributes": P.attribute_count() == 2, "equals": P.attribute_equals("class", ""), "in_datalist": F.col("has_ancestor"),
    }
    tag = F.max(F.when(F.col("name") == "p", P.element_tag()))
    changed = F.max(F.when(F.col("name") == "p", P.get_attribute("id", P.set_attribute("id", "new"))))
    return of.groupBy("page_id").agg(*[F.count_if(c).alias(k) for k, c in count.items()], tag.alias("tag"), changed.alias("id_set"))


def url_query_pairs(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    got = pages.select("page_id", F.posexplode(query_pairs(url_part(F.col("url"), "QUERY"))).alias("idx", "p"))
    return got.select("page_id", "idx", "p.name", "p.value")


def url_parts(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", *[url_part(u, p).alias(p.lower()) for p in ("PROTOCOL", "HOST", "PATH", "QUERY")], F.size(strict_split(F.coalesce(url_part(u, "QUERY"), F.lit("")))).alias("n_pairs"))


def url_encode_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(encode_value(F.col("text")).cast("binary")).alias("encoded"))


def visit_urls(spark, sf_dir):
    found = crawl.harvest(_pages(spark, sf_dir).select("page_id", F.lit(0).alias("idx"), "url"), "page")
    return found.select("page_id", "value", append_segment(F.lit("http://example.com/list/"), F.col("value")).alias("url"))


def title_search(spark, sf_dir):
    return search.search(nodes.titles(_parsed(spark, sf_dir)), "THAN").select("page_id", "title")


def title_suffix_search(spark, sf_dir):
    table = search.suffixes(nodes.titles(_parsed(spark, sf_dir)), "page_id")
    return search.search_suffixes(table, "THAN").select(F.col("id").alias("page_id"))


def stored_index_search(spark, sf_dir):
    """An index of titles, stored and opened again, searched for a word and for one longer than the suffixes it holds."""
    of = nodes.titles(_parsed(spark, sf_dir)).select("page_id", "title", F.lit("2026-01-01").alias("as_of"), F.lit("pages").alias("source"))
    index = search.Index.write(spark, of, "page_id", longest=4)
    return index.search("THAN").withColumn("term", F.lit("than")).unionByName(index.search("and th").withColumn("term", F.lit("and th"))).select("page_id", "title", "as_of", "source", "term")


def crawl_reachability(spark, sf_dir):
    """Pages' hosts linked along first labels: from each host to the one of the page after it, from the least host."""
    hosts = _pages(spark, sf_dir).select("page_id", url_part(F.col("url"), "HOST").alias("host"))
    edges = hosts.select("page_id", F.col("host").alias("src")).join(hosts.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("dst")), "page_id")
    return crawl.reachable(edges.select("src", "dst").distinct(), hosts.agg(F.min("host").alias("node")))


QUERIES = {
    f.__name__: f
    for f in (
        page_titles, page_links, links_resolved, link_first_match, tag_counts, element_counts, comment_nodes, attr_filter, leaf_counts, node_paths,
        paragraph_texts, articles_json, nav_links_by_ad, page_meta, error_counts, listing_template, movie_template, form_requests, form_controls, followed_links,
        next_pages, paged_listing, link_holders, own_charsets, page_files, stored_records, leaf_texts, form_texts, movie_flow, title_array, responses, byte_counts, recent_pages, json_texts, escaped_pairs, element_predicates, url_query_pairs, url_parts,
        url_encode_text, visit_urls, title_search, title_suffix_search, stored_index_search, crawl_reachability,
    )
}


def _text(x: str) -> str:
    """SQL: text with the entities that the pages have decoded."""
    for a, b in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_LINKS = """(SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS idx FROM pages)"""
_TITLE = _text("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_COUNT = "len(regexp_extract_all(html, '<{}[ >]'))"

#: The paragraphs of the article: what follows a <p> up to the next one, without tags.
_PARAS = f"""(SELECT page_id, html, list_transform(string_split(regexp_extract(html, '<article>(.*?)(</article>|<footer|$)', 1, 's'), '<p>')[2:],
  lambda x: {_text("regexp_replace(x, '<[^>]*>', '', 'g')")}) AS paras FROM pages)"""
_ENCODED = "replace(replace(replace(url_encode({}), '%20', '+'), '%2A', '*'), '~', '%7E')"

ORACLE_SQL = {
    "page_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_links": f"SELECT page_id, CAST(idx AS INT) AS idx, trim({_text('text')}) AS text, {_text('url')} AS url, false AS is_iframe FROM {_LINKS}",
    "links_resolved": f"SELECT l.page_id, CAST(idx AS INT) AS idx, regexp_extract(p.url, '^[^/]*//[^/]*') || {_text('l.url')} AS target FROM {_LINKS} l JOIN pages p USING (page_id)",
    "link_first_match": f"""SELECT page_id, CAST(idx AS INT) AS idx, trim({_text('text')}) AS text, {_text('url')} AS url FROM {_LINKS}
      WHERE contains(lower(text || chr(10) || url), 'tion') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY idx) = 1""",
    "tag_counts": "SELECT name, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, {_COUNT.format(t)} AS n FROM pages" for t in ("a", "li", "h1", "p", "title", "article")) + ") GROUP BY name",
    "comment_nodes": "SELECT page_id, len(regexp_extract_all(html, '<!--.*?-->')) AS n, regexp_extract(html, '<!--(.*?)-->', 1) AS first_text FROM pages",
    "attr_filter": """SELECT page_id, len(regexp_extract_all(html, '<div class="ad">')) AS ads, len(regexp_extract_all(html, '<a href="/th')) AS th_links FROM pages""",
    "element_counts": "SELECT 'html' AS namespace, name, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS name, {_COUNT.format(t)} AS n FROM pages" for t in "html head meta title style script body nav ul li a div article h1 p br footer".split()
    ) + " UNION ALL SELECT 'b', c + least(3, coalesce(sum(c) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
    " FROM (SELECT page_id, unnest(range(len(s))) AS k, unnest(list_transform(s, lambda x: len(regexp_extract_all(x, '<b>')))) AS c FROM"
    " (SELECT page_id, list_append(string_split(regexp_extract(html, '<article>(.*?)(</article>|<footer|$)', 1, 's'), '<p>')[2:], 'footer') AS s FROM pages))) GROUP BY name",
    "leaf_counts": """SELECT page_id, 3 + len(regexp_extract_all(html, '<br>')) + len(regexp_extract_all(replace(html, 'var t="</p>";', 'var'), '>[^<]+<')) + CAST(regexp_matches(html, '>[^<]+$') AS INT) AS leaves,
      1 + len(regexp_extract_all(html, '<br>')) AS elements, 1::BIGINT AS comments, 1::BIGINT AS doctypes FROM pages""",
    # each paragraph but the last is closed with a <b> open, by its end tag or by the next paragraph; the last by its end tag, if it has one
    "error_counts": """SELECT 'misnested' AS error, tag, sum(n)::BIGINT AS n FROM (
      SELECT 'p' AS tag, len(s) - 1 + CAST(contains(s[-1], '</p>') AS INT) AS n FROM (SELECT string_split(regexp_extract(html, '<article>(.*?)(</article>|<footer|$)', 1, 's'), '<p>')[2:] AS s FROM pages)
      UNION ALL SELECT 'footer', 1 FROM pages UNION ALL SELECT 'article', CAST(NOT contains(string_split(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<p>')[-1], '</p>') AS INT)
      FROM pages WHERE contains(html, '</article>')) GROUP BY tag HAVING sum(n) > 0""",
    "node_paths": "SELECT page_id, '/1.html/0.head/1.title' AS path, 3 AS depth FROM pages",
    "paragraph_texts": f"""SELECT page_id, len(paras)::BIGINT AS n, list_sum(list_transform(paras, lambda x: length(x)))::BIGINT AS chars,
      md5(array_to_string(paras, chr(10))) AS texts FROM {_PARAS}""",
    "articles_json": f"""SELECT page_id, {_text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title, CAST(len(paras) AS INT) AS n_paras,
      md5(array_to_string(paras, chr(10))) AS paras FROM {_PARAS}""",
    "nav_links_by_ad": f"""SELECT page_id, {_text("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS ad, {_text("regexp_extract(nav, '<a href=.([^<>]*).>', 1)")} AS first,
      CAST(len(regexp_extract_all(nav, '<a ')) AS INT) AS n_links, {_text("array_to_string(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), '|')")} AS texts
      FROM (SELECT page_id, html, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages)""",
    "page_meta": "SELECT page_id, url, 'html' AS doctype, 'no-quirks' AS mode FROM pages",
    "listing_template": f"""SELECT page_id, t AS title, CASE i WHEN 1 THEN CAST(page_id % 50 + 1970 AS VARCHAR) ELSE t END AS date, CASE i WHEN 1 THEN '/i/' || page_id || '.png' END AS img,
      '{LISTING_SOURCE}' AS source, CASE i WHEN 1 THEN 'Rent HD=$3;Buy=$9' ELSE '' END AS offers
      FROM (SELECT page_id, i, CASE i WHEN 1 THEN 'T' ELSE 'plain ' || page_id END AS t FROM pages, (VALUES (1), (2)) v(i))""",
    "movie_template": f"""SELECT page_id, 'Film ' || page_id AS title, CAST(page_id % 50 + 1970 AS VARCHAR) AS date, '/b/' || page_id || '.png' AS img, '{MOVIE_SOURCE}' AS source,
      CASE WHEN page_id % 2 = 0 THEN 'DVD;' ELSE '' END || 'streaming;streaming' AS offers FROM pages""",
    "form_requests": f"""SELECT page_id, 4 AS form_id, 'GET' AS method, regexp_extract(url, '^[^/]*//[^/]*') || '/go?' || CASE WHEN page_id % 4 = 3 THEN 'z=x+y' ELSE 'a=p+q' END
        || CASE WHEN page_id % 3 = 0 THEN '&c=on' ELSE '' END || '&u=' || {_ENCODED.format("url")} AS url, NULL::VARCHAR AS body, NULL::VARCHAR AS error, NULL::VARCHAR AS stored FROM pages
      UNION ALL SELECT page_id, 17, 'POST', url, 'n=' || page_id || '&t=a%26b', NULL, CAST(low AS VARCHAR) FROM (SELECT *, min(page_id) OVER (PARTITION BY url) AS low FROM pages) WHERE page_id % 5 <> 4
      UNION ALL SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN 21 ELSE 17 END, NULL, NULL, NULL, 'method isn''t supported', NULL FROM pages""",
    "form_texts": """SELECT page_id, 't=v' || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'c=' ELSE chr(10) || 'c=' END AS as_attributes,
      't=text ' || page_id || CASE WHEN page_id % 2 = 0 THEN '' ELSE chr(10) || 'c=' END AS as_texts FROM pages""",
    "form_controls": """SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'Of' ELSE 'F' END AS form, CASE WHEN page_id % 3 = 0 THEN 'x' ELSE 'Q' END || ',r' || CASE WHEN page_id % 2 = 0 THEN ',q' ELSE '' END AS names,
      CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END AS q FROM pages WHERE page_id % 4 <> 1""",
    "followed_links": """SELECT a.page_id, coalesce(b.url, regexp_extract(a.url, '^[^/]*//[^/]*') || '/none') AS target,
      CAST((SELECT min(page_id) FROM pages p WHERE p.url = b.url) AS VARCHAR) AS stored, false AS is_iframe FROM pages a LEFT JOIN pages b ON a.page_id = b.page_id + 10""",
    "next_pages": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN page_id * 10 + 9 WHEN page_id % 3 <> 0 THEN page_id * 10 + 20 END AS row,
      CASE WHEN page_id % 5 = 0 THEN '/search?row=' || (page_id * 10 + 9) WHEN page_id % 3 <> 0 THEN '/Search?row=' || (page_id * 10 + 20) || '&x=' || page_id || '&movieid=m+' || page_id END AS path,
      'm ' || page_id || '|7' AS ids FROM pages""",
    "paged_listing": """WITH RECURSIVE p AS (SELECT page_id, CASE WHEN page_id % 10 = 9 THEN page_id - 1 ELSE page_id END AS address,
        CASE WHEN page_id % 10 = 8 THEN page_id + 2 ELSE page_id + 1 END AS target FROM pages),
      known AS (SELECT address, min(page_id) AS page_id FROM p GROUP BY address),
      way(page_id, depth) AS (SELECT page_id, 0 FROM known WHERE address = 0
        UNION ALL SELECT k.page_id, w.depth + 1 FROM way w JOIN p ON p.page_id = w.page_id JOIN known k ON k.address = p.target)
      SELECT page_id, depth, 'title ' || page_id AS title FROM way""",
    "link_holders": f"""SELECT name, within, sum(n)::BIGINT AS n FROM (SELECT 'a' AS name, 'li' AS within, {_COUNT.format('a')} AS n FROM pages UNION ALL SELECT 'li', 'ul', {_COUNT.format('li')} FROM pages
      UNION ALL SELECT 'ul', 'nav', {_COUNT.format('ul')} FROM pages UNION ALL SELECT 'h1', 'article', {_COUNT.format('h1')} FROM pages) GROUP BY ALL""",
    "own_charsets": "SELECT page_id, md5(regexp_replace(html, '[^\\x00-\\xFF]', '?', 'g')) AS text FROM pages",
    "page_files": "SELECT CAST(sum(strlen(regexp_replace(html, '[\\r\\n]', ' ', 'g')) + 1) AS BIGINT) AS bytes, 0::BIGINT AS damaged FROM pages",
    "stored_records": f"""SELECT page_id, {_TITLE} AS title, s AS source FROM pages, (VALUES ('even'), ('odd'), ('lines')) v(s) WHERE page_id % 2 = CASE s WHEN 'even' THEN 0 ELSE 1 END""",
    "leaf_texts": """SELECT page_id, CAST(i + 2 AS INT) AS idx, '/1.html/1.body/0.ul' || path AS path, text, shown FROM (SELECT page_id, unnest(range(len(l))) AS i, unnest(l, recursive := true) FROM (SELECT page_id,
      list_concat([{'path': '/0.li/0.#text', 'text': 'a ' || page_id, 'shown': 'a ' || page_id}, {'path': '/1.li/0.#text', 'text': 'b', 'shown': 'b'}, {'path': '/1.li/1.br', 'text': NULL, 'shown': '<br/>'}],
      CASE page_id % 3 WHEN 0 THEN [{'path': '/1.li/2.#comment', 'text': 'c', 'shown': 'c'}]
        WHEN 1 THEN [{'path': '/1.li/2.#text', 'text': 'd', 'shown': 'd'}, {'path': '/1.li/3.i', 'text': NULL, 'shown': '<i/>'}] ELSE [] END) AS l FROM pages))""",
    "movie_flow": """WITH g AS (SELECT DISTINCT page_id // 8 AS g FROM pages), n AS (SELECT g, 'http://m' || g AS start, g * 8 AS home FROM g),
      f AS (SELECT *, CASE WHEN g % 5 = 1 THEN 'no such form' WHEN g % 5 = 2 THEN 'method isn''t supported' WHEN g % 3 = 2 OR NOT EXISTS (FROM pages WHERE page_id = home + 1) THEN 'page isn''t stored' END AS error FROM n)
      SELECT start, 1 AS step, home AS page_id, error, NULL::VARCHAR AS title FROM f WHERE error IS NOT NULL
      UNION ALL SELECT start, 3, CASE WHEN ok THEN home + i ELSE home + i - 3 END, CASE WHEN NOT ok THEN 'page isn''t stored' END, CASE WHEN ok THEN 'Film ' || g || '-' || i END
      FROM (SELECT *, g % 7 <> 3 AND EXISTS (FROM pages WHERE page_id = home + i) AS ok FROM f, (VALUES (4), (5)) v(i)
        WHERE error IS NULL AND (i = 4 OR g % 4 <> 3 AND EXISTS (FROM pages WHERE page_id = home + 2)))""",
    "title_array": f"""WITH t AS (SELECT page_id, lower({_TITLE}) AS t FROM pages), s AS (SELECT substr(t, i) AS s, page_id, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM t)),
      n AS (SELECT s, lag(s) OVER (ORDER BY encode(s), page_id, i) AS b FROM s)
      SELECT page_id, 'than' AS what, NULL::INT AS length FROM t WHERE contains(t, 'than')
      UNION ALL SELECT NULL, 'repeat', CAST(max(list_max(list_filter(range(0, least(len(s), len(b)) + 1), lambda k: left(s, k) = left(b, k)))) AS INT) FROM n""",
    "responses": "SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 'text' ELSE 'html' END AS kind, md5(html) AS text FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 <> 3",
    "byte_counts": "SELECT regexp_extract(url, '^([^:]*):', 1) AS scheme, sum(strlen(html))::BIGINT AS bytes, count(*) AS pages FROM pages GROUP BY 1",
    "recent_pages": "SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 10",
    "json_texts": """SELECT page_id, CASE WHEN page_id % 5 <> 4 THEN '{"id":' || page_id || ',"x":[null,true,"é"]}' END AS json FROM pages""",
    "escaped_pairs": """SELECT page_id, idx, name, value, CASE idx WHEN 0 THEN 'q=a b+' END AS whole FROM (SELECT page_id, CAST(i AS INT) AS idx, name, coalesce(value, 'a b+' || page_id) AS value
      FROM pages, (VALUES (0, 'q', NULL), (1, 'q', '2'), (2, 'bad', '%zz%4'), (3, 'e', 'é'), (4, '_charset_', 'iso-8859-1'), (5, 'e', 'é'), (6, '', ''), (7, 'last', '')) v(i, name, value))""",
    "element_predicates": "SELECT page_id, " + ", ".join(f"{n}::BIGINT AS {k}" for k, n in (
        ("disabled", 1), ("checked", 1), ("formatting", 1), ("form_associated", 3), ("submittable", 3), ("math_text", 1), ("html_point", 1), ("no_class", 14),
        ("two_attributes", 2), ("equals", 1), ("in_datalist", 1))) + """, '<p id="' || page_id || '" class="">' AS tag, 'new' AS id_set FROM pages""",
    "stored_index_search": f"""SELECT page_id, {_TITLE} AS title, '2026-01-01' AS as_of, 'pages' AS source, term FROM pages, (VALUES ('than'), ('and th')) v(term)
      WHERE contains(lower({_TITLE}), term)""",
    "url_query_pairs": """WITH q AS (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages WHERE contains(url, '?')),
      p AS (SELECT page_id, unnest(string_split(q, '&')) AS p, unnest(range(len(string_split(q, '&')))) AS idx FROM q)
      SELECT page_id, CAST(idx AS INT) AS idx, split_part(p, '=', 1) AS name, split_part(p, '=', 2) AS value FROM p""",
    "url_parts": """SELECT page_id, regexp_extract(url, '^([^:]*):', 1) AS protocol, regexp_extract(url, '//([^/?#]*)', 1) AS host,
      regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query,
      CAST(CASE WHEN contains(url, '?') THEN len(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) ELSE 0 END AS INT) AS n_pairs FROM pages""",
    "visit_urls": """SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS value,
      'http://example.com/list/' || regexp_extract(url, '[?&]page=([^&#]*)', 1) AS url FROM pages WHERE regexp_matches(url, '[?&]page=')""",
    "title_search": f"SELECT page_id, {_TITLE} AS title FROM pages WHERE contains(lower({_TITLE}), 'than')",
    "title_suffix_search": f"SELECT page_id FROM pages WHERE contains(lower({_TITLE}), 'than')",
    "url_encode_text": f"SELECT doc_id, md5({_ENCODED.format('text')}) AS encoded FROM documents",
    "crawl_reachability": """WITH RECURSIVE h AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS host FROM pages),
      e AS (SELECT DISTINCT a.host AS src, b.host AS dst FROM h a JOIN h b ON b.page_id = a.page_id + 1),
      r(node, depth) AS (SELECT min(host), 0 FROM h UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 60)
      SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""",
}

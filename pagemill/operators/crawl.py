"""Navigation over stored pages: reachability, paging, harvesting of query parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import append_segment, base_10, first_value, path_segments, query_pairs, resolve, url_part
from ..plans.extract import extract
from ..sources.sinks import kept, shared_folder
from .nodes import by_url, find_link, links, parse_pages


def reachable(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", depth: int | None = None) -> DataFrame:
    """(node, depth): every node reached from start (node) over edges, with the least number of links.

    Breadth-first with an anti-join against what was seen, so cycles end. Edges and each round's new nodes are checkpointed
    to the shared folder once: plans stay short, and a lost executor costs no earlier round. A round follows all links of one length, so this is
    for graphs that are wide; chains() follows long ones. Null ends, links of a node with itself and repeated links change nothing; null
    starts are left out, repeated ones are one; without links the starts are all, without starts there are no rows.
    """
    _checkpoints(edges.sparkSession)
    known = edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("node is not null and to is not null and node <> to").distinct().checkpoint()
    front = start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("depth")).where("node is not null").distinct().checkpoint()
    seen, round_ = front, 0
    while depth is None or round_ < depth:
        round_ += 1
        front = front.join(known, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        front = front.withColumn("depth", F.lit(round_)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # of tables that are written already
        if round_ % 16 == 0:
            seen = seen.checkpoint()
    return seen


def _checkpoints(spark) -> None:
    """The shared folder of the session's settings; one in the warehouse only where none is set, as in tests."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def chains(successors: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, depth): the nodes of the chain from each start, where every node has one successor at most, in rounds that double.

    A round knows the first 2**k nodes of each chain and where every node leads in 2**k steps: both make the next round, so a chain
    of a million nodes takes twenty joins of narrow rows, whatever its order, and each round is written to the shared folder once. A chain ends before it
    comes to a node again. Of several successors of a node the least counts, null ones end a chain; null starts have none, repeated
    starts are one; no starts or no successors give no rows or the starts alone.
    """
    to = successors.select(F.col(f"`{src}`").alias("node"), F.col(f"`{dst}`").alias("to")).where("node is not null and `to` is not null")
    to = kept(to.groupBy("node").agg(F.min("to").alias("to")))
    first = F.col(f"`{starts.columns[0]}`")
    way = kept(starts.where(first.isNotNull()).select(first.alias("start"), first.alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    known, step = way.count(), 1
    while known:
        ahead = way.join(to, "node").select("start", F.col("to").alias("node"), (F.col("depth") + step).alias("depth"))
        way = kept(way.unionByName(ahead).groupBy("start", "node").agg(F.min("depth").alias("depth")))
        was, known = known, way.count()
        if known == was:
            break
        twice = to.select(F.col("node").alias("to"), F.col("to").alias("after"))
        to, step = kept(to.join(twice, "to").select("node", F.col("after").alias("to"))), step * 2
    return way


def walk(pages: DataFrame, start: str, pattern: str, template) -> DataFrame:
    """(page_id, url, depth, record): the paging flow. From the stored page ``start``, the first link of each page that holds the pattern
    leads to the next, until one has none or leads to where the flow has been; each page on the way gives its record.

    Links of all pages are read once, chains() finds the way, and only pages on it are parsed for their records. Of a URL that is stored
    twice the least page counts, as a target and as the start; null and unknown targets end the way, an unknown or null start gives no rows, and so do no pages.
    """
    known = by_url(pages, "address", "id")
    link = find_link(links(parse_pages(pages)), pattern).withColumn("address", resolve("base", "url"))
    next_ = link.join(known, "address").select(F.col("page_id").alias("src"), F.col("id").alias("dst"))
    way = chains(next_, known.where(F.col("address") == F.lit(start)).select("id")).select(F.col("node").alias("page_id"), F.col("depth").cast("int").alias("depth"))
    seen = pages.join(way.select("page_id"), "page_id", "left_semi").dropDuplicates(["page_id"])
    found = extract(parse_pages(seen), template).select("page_id", "record")
    urls = known.select(F.col("id").alias("page_id"), F.col("address").alias("url"))
    return way.join(urls, "page_id").join(found, "page_id").select("page_id", "url", "depth", "record")


def parameters(links: DataFrame, url: str = "url") -> DataFrame:
    """Adds pairs, the decoded query of each link that has one; other links go. Links that have pairs already are given back."""
    if "pairs" in links.columns:
        return links
    found = links.withColumn("query", F.coalesce(url_part(F.col(url), "QUERY"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)))
    return found.where("query <> ''").withColumn("pairs", query_pairs(F.col("query")))


def harvest(links: DataFrame, name: str, url: str = "url") -> DataFrame:
    """(page_id, idx, value): the parameter of every link that has it, repeats kept, the last link first."""
    value = first_value(F.col("pairs"), name)
    return parameters(links, url).select("page_id", "idx", value.alias("value")).where("value is not null").orderBy("page_id", F.col("idx").desc())


def _next(path: str, row: str, current: Column | int, url: str) -> tuple[Column, Column]:
    """(whether a link with pairs leads to a later row of this path, its row)."""
    segments, number = path_segments(F.col(url)), base_10(first_value(F.col("pairs"), row))
    current = current if isinstance(current, Column) else F.lit(current)
    return (F.size(segments) == 1) & (F.lower(F.try_element_at(segments, F.lit(1))) == path.lower()) & (number > current), number


def next_page(links: DataFrame, path: str, row: str = "row", current: Column | int = 0, url: str = "url") -> DataFrame:
    """(page_id, row, url) of each page's next page: of the links to this one-segment path (in any case) whose row parameter is
    above the current one, the last."""
    fits, number = _next(path, row, current, url)
    found = parameters(links, url).where(fits)
    return found.groupBy("page_id").agg(F.max_by(F.struct(number.alias("row"), F.col(url).alias("url")), "idx").alias("n")).select("page_id", "n.*")


def results(links: DataFrame, path: str, name: str, row: str = "row", current: Column | int = 0, url: str = "url") -> DataFrame:
    """(page_id, row, url, values): next_page() and the values of harvest() of each page at once, the last link first; row and url are null where
    there is no next page, values is empty where no link has the parameter. Links' queries are decoded once."""
    fits, number = _next(path, row, current, url)
    value = first_value(F.col("pairs"), name)
    found = parameters(links, url).groupBy("page_id").agg(
        F.max_by(F.struct(number.alias("row"), F.col(url).alias("url")), F.when(fits, F.col("idx"))).alias("n"),
        F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct((-F.col("idx")).alias("at"), value.alias("value"))))).alias("v"),
    )
    return found.select("page_id", "n.row", "n.url", F.transform("v", lambda x: x["value"]).alias("values"))


def visit_urls(harvested: DataFrame, base: str) -> DataFrame:
    """Adds url: the base with the harvested value as its last segment."""
    return harvested.withColumn("url", append_segment(F.lit(base), F.col("value")))

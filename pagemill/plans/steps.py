"""Flows over stored pages as tables: where each start is, moved by one step after the other; what fails stays, with its step and its error."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import append_segment, base_10, resolve
from ..operators import forms as form_ops
from ..operators.crawl import chains
from ..operators.nodes import by_url, first_of, link_array, parse_pages
from ..sources.sinks import kept
from .extract import extract

MISSING = "page isn't stored"


@dataclass(frozen=True)
class Link:
    """To the page of the first link whose text or URL holds the pattern, in any case."""

    pattern: str


@dataclass(frozen=True)
class Submit:
    """To the page of the request of the first form whose id, name or action holds the pattern, its controls set to these values."""

    pattern: str
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Paged:
    """To this page and all that follow it: the next page is the last link to a path of this one segment whose row is above its own."""

    path: str
    row: str = "row"


@dataclass(frozen=True)
class Visit:
    """To a page for each value that the links give this parameter, the last link first: base/value."""

    name: str
    base: str


def _query_value(url: Column, name: str) -> Column:
    """The first value of a parameter, decoded; null where the URL has none."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1)
    given = url.rlike(rf"^[^?#]*\?(?:[^#]*&)?{name}=")
    return F.when(given, F.coalesce(F.try_url_decode(raw), raw))


def _outcome(step, of: DataFrame, name: str) -> DataFrame:
    """of, parsed pages with their links and forms, with a column: array<struct<to, error>>, where this step leads from each page."""
    one = lambda to, error: F.array(F.struct(to.alias("to"), error.alias("error")))
    if isinstance(step, Link):
        link = first_of(F.filter("links", lambda l: F.contains(F.lower(F.concat_ws("\n", l["text"], l["url"])), F.lit(step.pattern.lower()))))
        return of.withColumn(name, one(resolve("url", link["url"]), F.when(link.isNull(), "no such link")))
    if isinstance(step, Submit):
        form = form_ops.first_form(F.col("forms"), step.pattern)
        controls = form["controls"]
        for k, v in step.values.items():
            controls = form_ops.with_value(controls, k, v)
        sent = form_ops.request(form["action"], form["method"], form["enctype"], F.col("url"), form_ops.data_set(controls))
        return of.withColumn(name, one(sent["url"], F.when(form.isNull(), "no such form").otherwise(sent["error"])))
    if isinstance(step, Paged):
        own = F.coalesce(base_10(_query_value(F.col("url"), step.row)), F.lit(0))
        fits = lambda l: l["url"].rlike(rf"(?i)^([a-z]+://[^/?#]*)?/?{step.path}/?\?") & (base_10(_query_value(l["url"], step.row)) > own)
        last = F.try_element_at(F.filter("links", fits), F.lit(-1))
        return of.withColumn(name, one(resolve("url", last["url"]), F.lit(None).cast("string")))
    values = F.filter(F.transform(F.reverse("links"), lambda l: _query_value(l["url"], step.name)), lambda v: v.isNotNull())
    to = F.transform(values, lambda v: F.struct(append_segment(F.lit(step.base), v).alias("to"), F.lit(None).cast("string").alias("error")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("to"), F.lit("no such parameter").alias("error")))
    return of.withColumn(name, F.when(F.size(values) > 0, to).otherwise(none))


def flow(pages: DataFrame, starts: DataFrame, steps: list, template=None) -> DataFrame:
    """(start, step, page_id, error, record) of a flow from each URL of ``starts`` through the steps, and what a template makes of the pages that
    it ends at. step counts from 0, opening the start; a row with an error has the step that failed and the page where it did.

    One pass over the pages says where every step leads from each of them; it is written, and a step is a join of where starts are with it and with the URLs
    of stored pages. So all starts move at once, on narrow rows, and one that fails stops no other. Pages that a start comes to in several
    ways are rows each; of a URL that is stored twice the least page counts; null starts are left out, repeated ones are one; no pages
    give an error for each start. Records are read from the pages at the ends only.
    """
    known = kept(by_url(pages, "to", "at"))
    parsed = form_ops.with_forms(parse_pages(pages).withColumn("links", link_array()))
    names = [f"s{i}" for i in range(len(steps))]
    for name, step in zip(names, steps):
        parsed = _outcome(step, parsed, name)
    leads = kept(parsed.join(known.select(F.col("at").alias("page_id")), "page_id", "left_semi").select("page_id", *names))
    first = starts.select(F.col(starts.columns[0]).alias("start")).where("start is not null").distinct()
    here = first.join(known, F.col("start") == F.col("to"), "left").select("start", F.lit(0).alias("step"), F.col("at").alias("page_id"), F.when(F.col("at").isNull(), MISSING).alias("error"))
    here, failed = kept(here.where("error is null").select("start", "page_id")), [here.where("error is not null")]
    for i, (name, step) in enumerate(zip(names, steps), 1):
        out = leads.select("page_id", F.explode(name).alias("x")).select("page_id", "x.to", "x.error")
        if isinstance(step, Paged):
            next_ = out.join(known, "to").select(F.col("page_id").alias("src"), F.col("at").alias("dst"))
            ways = chains(next_, here.select("page_id").distinct()).select(F.col("start").alias("page_id"), "node")
            here = kept(here.join(ways, "page_id").select("start", F.col("node").alias("page_id")))
            continue
        moved = here.join(out, "page_id").join(known, "to", "left")
        moved = kept(moved.select("start", "page_id", "at", F.coalesce("error", F.when(F.col("at").isNull(), MISSING)).alias("error")))
        failed.append(moved.where("error is not null").select("start", F.lit(i).alias("step"), "page_id", "error"))
        here = moved.where("error is null").select("start", F.col("at").alias("page_id"))
    ends = here.select("start", F.lit(len(steps)).alias("step"), "page_id", F.lit(None).cast("string").alias("error"))
    for f in failed:
        ends = ends.unionByName(f)
    if template is None:
        return ends
    seen = pages.join(here.select("page_id").distinct(), "page_id", "left_semi").dropDuplicates(["page_id"])
    found = extract(parse_pages(seen), template).select("page_id", "record", F.lit(True).alias("_ended"))
    return ends.withColumn("_ended", F.col("error").isNull()).join(found, ["page_id", "_ended"], "left").drop("_ended").select("start", "step", "page_id", "error", "record")

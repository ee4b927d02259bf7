"""The two production templates and their flow over stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nodes import parse_pages
from .extract import deep_text, each, el, extract, first_text, obj, root, scope

#: Constants, element names, attribute values and member names of the two templates.
LISTING_SOURCE, MOVIE_SOURCE = "Amazon Instant Video", "Netflix"
LISTING = root(
    el("div").equals("id", "btfResults"),
    [
        each(
            el("li").starts_with("id", "result_"),
            obj(
                scope(el("span").equals("class", "lrg bold")), ("title", first_text()),
                scope(el("span").equals("class", "med reg subt")), ("date", first_text()),
                scope(), ("img", el("img").attr("src")), ("source", LISTING_SOURCE),
                ("offers", [each(el("tr").children_count(3), obj(
                    scope(el("td").equals("class", "clabel")), ("label", deep_text()),
                    scope(el("td").equals("class", "cpriceR")), ("price", deep_text()),
                ))]),
            ),
        )
    ],
)
MOVIE = root(
    el("div").equals("id", "mdp-overview"),
    obj(
        scope(el("h2").equals("class", "title")), ("title", first_text()),
        scope(el("span").equals("class", "year")), ("date", first_text()),
        scope(el("div").equals("id", "mdp-boxshot")), ("img", el("img").attr("src")), ("source", MOVIE_SOURCE),
        scope(el("div").equals("id", "mdp-metadata-content")),
        ("offers", [
            each(el("a").text_equals("DVD"), {"label": "DVD", "price": None}),
            each(el("a").text_equals("streaming"), {"label": "streaming", "price": None}),
        ]),
    ),
)


def listing_records(pages: DataFrame) -> DataFrame:
    """(page_id, title, date, img, source, offers): a row for each result of each listing page."""
    found = extract(parse_pages(pages), LISTING)
    return found.select("page_id", F.explode("record").alias("r")).select("page_id", "r.*")


def movie_records(pages: DataFrame) -> DataFrame:
    """(page_id, title, date, img, source, offers): a row for each page."""
    return extract(parse_pages(pages), MOVIE).select("page_id", "record.*")

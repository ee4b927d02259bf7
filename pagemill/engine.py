"""One object for the interactive operators over a table of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import forms as form_ops
from .operators import nodes as node_ops
from .operators import search as search_ops
from .operators.crawl import harvest, next_page, reachable, walk
from .operators.suffix_array import SuffixArray
from .plans.extract import extract
from .plans.steps import flow
from .sources import pages as page_source
from .sources import sinks


class Engine:
    """Each method gives a DataFrame; ``only`` narrows to one page by its URL before anything is parsed."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        return cls(page_source.read_pages(spark, path))

    def only(self, url: str) -> Engine:
        return Engine(self.pages.where(F.col("url") == url))

    def nodes(self) -> DataFrame:
        return node_ops.flat(self.parsed())

    def parsed(self) -> DataFrame:
        """A row for each page, its nodes in an array: what the other methods read, without a shuffle."""
        return node_ops.parse_pages(self.pages)

    def links(self) -> DataFrame:
        return node_ops.links(self.parsed())

    def link(self, index: int, stored: DataFrame | None = None) -> DataFrame:
        return node_ops.follow(node_ops.link_urls(self.parsed()), self.pages if stored is None else stored, index)

    def forms(self) -> DataFrame:
        return node_ops.forms(self.parsed())

    def controls(self) -> DataFrame:
        return form_ops.controls(self.parsed())

    def submit(self, values: dict[str, str] | None = None) -> DataFrame:
        """The request of every form, with these controls set, and the stored page it leads to."""
        return form_ops.submit(form_ops.submitted(self.parsed(), values), self.pages)

    def leaf_nodes(self, verbose: bool = False) -> DataFrame:
        return node_ops.leaf_nodes(self.parsed(), verbose)

    def extract(self, template) -> DataFrame:
        return extract(self.parsed(), template)

    def walk(self, start: str, pattern: str, template) -> DataFrame:
        """The paging flow from the page of a URL, by its first link that holds the pattern."""
        return walk(self.pages, start, pattern, template)

    def flow(self, starts: DataFrame, steps: list, template=None) -> DataFrame:
        """Where a flow of steps leads from each of these URLs, with the records at its ends and the errors on the way."""
        return flow(self.pages, starts, steps, template)

    def errors(self) -> DataFrame:
        return node_ops.parse_errors(self.parsed())

    def index(self, title: str = "title") -> SuffixArray:
        """A stored suffix array of the pages' titles."""
        return SuffixArray.write(node_ops.titles(self.parsed()).select("page_id", F.col("title").alias(title)), "page_id", title)

    def search(self, records: DataFrame, term: str) -> DataFrame:
        return search_ops.search(records, term)

    harvest, next_page, reachable = staticmethod(harvest), staticmethod(next_page), staticmethod(reachable)
    store, stored, recent = staticmethod(sinks.store), staticmethod(sinks.stored), staticmethod(sinks.recent)

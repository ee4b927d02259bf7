"""Pages as they arrive: the same parsing and extraction over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import is_http, resolve, url_part
from ..operators.nodes import link_array, parse_html, parse_pages

PAGES = "page_id long, url string, html string"


def read_stream(spark: SparkSession, path: str, schema: str = PAGES, files_per_trigger: int = 64) -> DataFrame:
    """A stream of page files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def node_stream(pages: DataFrame) -> DataFrame:
    """A stream of node rows: parsing is stateless and narrow."""
    return parse_html(pages)


def tag_windows(events: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) counts by window of event time, late rows dropped past the watermark."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def run_to(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each micro-batch, computed once, to every sink, until no input is left."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, so that a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def frontier(pages: DataFrame, ts: str = "ts", keep: str = "7 days") -> DataFrame:
    """(url, host, ts): each URL that the pages of a stream link to, once, when it comes up for the first time.

    What was seen is Spark's state, dealt out by URL and kept with the query's checkpoint, so a query that is started again
    emits nothing twice. A URL is forgotten once the stream's time, the latest ``ts`` less ``keep``, has passed its last emission by
    ``keep``; after that it would come once more. Rows later than that are dropped. Pages have page_id, url, html and ``ts``; links that aren't HTTP,
    or that resolve to nothing, are left out, and so are rows without a time; a page's fragment marks don't tell URLs apart.
    """
    parsed = parse_pages(pages, keep=[ts])
    found = parsed.select(ts, F.col("url").alias("base"), F.explode(F.array_distinct(F.transform(link_array(text=False), lambda l: l["url"]))).alias("to"))
    urls = found.where(f"`{ts}` IS NOT NULL").select(F.regexp_replace(resolve("base", "to"), "#.*$", "").alias("url"), F.col(ts).alias("ts"))
    known = urls.where(is_http(F.col("url"))).withColumn("host", F.lower(url_part(F.col("url"), "HOST"))).where("host IS NOT NULL")
    return known.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["url"]).select("url", "host", "ts")

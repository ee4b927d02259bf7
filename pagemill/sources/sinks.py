"""Sinks: record stores, JSON lines, byte counts, several outputs at once, recent log entries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import write_json


def shared_folder(spark: SparkSession, name: str = "_stages") -> str:
    """The folder in spark.checkpoint.dir that the driver and all executors share. Where it is unset, as in tests, one of the warehouse serves a
    local session; a cluster would write to each machine's own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/{name}"


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage: written to the shared folder and read back, so that no later action computes it again and no lost executor costs it."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(records: DataFrame, path: str, source: str) -> None:
    """Appends records under their source's partition."""
    records.withColumn("source", F.lit(source)).write.mode("append").partitionBy("source").parquet(path)


def stored(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Stored records; a source prunes to its partition."""
    df = spark.read.parquet(path)
    return df if source is None else df.where(F.col("source") == source)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(write_json(F.struct(*df.columns)).alias("value")).write.text(path)


def byte_count(value: str | Column) -> Column:
    """An aggregate: the bytes of a column."""
    return F.coalesce(F.sum(F.octet_length(value)), F.lit(0))


def tee(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """Gives df, computed once, to each sink."""
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()


def recent(log: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The last n entries, the latest first."""
    return log.orderBy(F.col(ts).desc()).limit(n)

"""Reading tables, cutting lineage in the shared folder, and Arrow helpers of the llm operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import shared_folder

#: Rows and bytes of an Arrow batch at most (but for one longer row): they bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share: spark.checkpoint.dir, or a local session's warehouse where it is unset."""
    path = f"{shared_folder(spark)}/pagemill-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    A lost executor loses nothing of it, and no later action computes df again.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pagemill-" in folder:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def map_text(
    df: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], list]],
    text: str = "text",
) -> DataFrame:
    """Adds to the columns ``keep`` of df the ``fields`` computed from whole texts, in one narrow stage.

    make() runs once a task; what it returns turns the texts of a batch (null: empty) into one list or Arrow array
    for each field. Rows keep their other columns, so null or repeated ids need no join. A name in both keep
    and fields raises ValueError.
    """
    if set(keep) & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(set(keep) & {f.name for f in fields})} are in the input already")
    session(df)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_pm_text"))
    schema = T.StructType([src.schema[c] for c in keep] + fields)
    names, n = schema.names, len(keep)
    kinds = [f.dataType for f in fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        of, arrow = make(), [to_arrow_type(k) for k in kinds]
        for b in batches:
            if b.num_rows:
                made = of(b.column(n).to_pylist())
                cols = [x if isinstance(x, pa.Array) else pa.array(x, a) for x, a in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], names=names)

    return src.mapInArrow(run, schema)


def of_row(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns, in this order, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


#: Rows of each range that its bounds are chosen by, about: a random sample that comes to the driver.
SAMPLED = 100
#: Rows of a range of ids, about, and ranges at most: the sample and the bounds stay below a hundred times as many.
RANGE_ROWS, RANGES = 1 << 15, 1 << 14
LAST = np.iinfo(np.int64).max


def id_ranges(df: DataFrame, doc_id: str, order: str) -> tuple[int, Column]:
    """(parts, code): ranges of (id, order) about equal in rows, of RANGE_ROWS rows but at least as many as shuffle partitions, and a column that is twice the
    number of a row's range, plus 1 for the greatest of the range, which occurs. Null ids come first.

    Bounds are ids, or where one id (or none) fills several ranges, ids with an ``order``, a column of longs; all of
    them occur. They are chosen from a sample of SAMPLED rows a range: of ids alone, and of orders too only if an id is that hot. Rows
    equal in both stay together.
    """
    rows, top = df.agg(F.count("*"), F.max(doc_id)).first()
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(RANGES, rows // RANGE_ROWS))
    share = min(1.0, SAMPLED * n / max(1, rows))

    def cuts(*by: str) -> list[tuple]:
        some = sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in df.select(*by).sample(share, 1).collect())
        return [some[len(some) * i // n] for i in range(1, n)] if some else []

    chosen = cuts(doc_id)
    if len(set(chosen)) == len(chosen) or rows <= 16 * n:  # of so few rows no range is large
        bounds = {(known, i, LAST) for known, i in chosen if known and i < top} | ({(True, top, LAST)} if top is not None else set())
    else:
        known, i, g = df.agg(F.max(F.struct(F.col(doc_id).isNotNull(), doc_id, order))).first()[0]
        bounds = {b for b in cuts(doc_id, order) if b < (known, i or 0, g)} | {(known, i or 0, g)}
    none = np.array(sorted(g for known, _, g in bounds if not known), np.int64)
    ids, tops = (np.array([b[k] for b in sorted(bounds) if b[0]], np.int64) for k in (1, 2))
    parts = max(1, len(bounds))

    @F.pandas_udf(T.IntegerType())
    def code(doc: pd.Series, known: pd.Series, g: pd.Series) -> pd.Series:
        at, known, g = doc.to_numpy(), known.to_numpy(), g.to_numpy()
        part, after = np.searchsorted(ids, at), np.searchsorted(ids, at, "right")
        for x in np.unique(at[known & (after > part)]).tolist():  # ids that bounds have
            own, lo, hi = known & (at == x), np.searchsorted(ids, x), np.searchsorted(ids, x, "right")
            part[own] = lo + np.searchsorted(tops[lo:hi], g[own])
        part = np.where(known, len(none) + part, np.searchsorted(none, g))
        is_id, is_none = np.clip(part - len(none), 0, max(0, len(ids) - 1)), np.clip(part, 0, max(0, len(none) - 1))
        head = np.zeros(len(at), bool)
        if len(ids):
            head |= known & (ids[is_id] == at) & ((tops[is_id] == g) | (tops[is_id] == LAST))
        if len(none):
            head |= ~known & (none[is_none] == g)
        return pd.Series((2 * np.minimum(part, parts - 1) + head).astype("int32"))

    return parts, code(F.coalesce(doc_id, F.lit(0).cast("long")), F.col(doc_id).isNotNull(), order)

"""Structural joins of node tables: elements and what they hold, by one merge with a stack of open elements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _merged(depth: int | None):
    """Rows in order of (page, pre): each with what the open elements that hold it are called by (their ranks, or another value), the nearest first,
    ``depth`` at most. Only elements that may hold others touch the stack; a page goes on from one batch to the next."""

    def run(batches):
        page, ranks, lasts, called = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            n, out = b.num_columns - 6, []
            for of, pre, last, holds, by in zip(*(b.column(i).to_pylist() for i in range(n, n + 5))):
                if of is None or pre is None:
                    out.append([])
                    continue
                if of != page:
                    page, ranks, lasts, called = of, [], [], []
                while lasts and lasts[-1] < pre:
                    lasts.pop()
                    ranks.pop()
                    called.pop()
                again = bool(ranks) and ranks[-1] == pre  # a row that repeats an element
                found = called[:-1] if again else called
                out.append(found[: None if depth is None else -depth - 1 : -1])
                if holds and not again:
                    ranks.append(pre)
                    lasts.append(last)
                    called.append(by)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.list_(b.column(n + 4).type))], names=[*b.schema.names[:n], "holders"])

    return run


def held(nodes: DataFrame, holds: Column, depth: int | None = None, by: Column | None = None) -> DataFrame:
    """Adds holders: the ranks of the elements that hold a node and for which ``holds`` is true, the nearest first, ``depth`` of them at
    most (all by default; none: an empty array). Linear in the rows, one shuffle by page, and no row for a pair. With ``by``, holders has this text of
    theirs instead of their ranks, so that nobody need look them up again.

    Nodes without a page or a rank are held by nothing; a repeated row of a node is held as the first and holds nothing more; an
    empty table gives an empty one. A column of nodes with the new name raises ValueError.
    """
    if "holders" in nodes.columns:
        raise ValueError("column holders is in the input already")
    keys = [F.col("page_id").cast("long").alias("_page"), F.col("pre").cast("int").alias("_pre"), F.col("last").cast("int").alias("_last"), F.coalesce(holds, F.lit(False)).alias("_holds")]
    known = F.col("_page").isNotNull() & F.col("_pre").isNotNull()
    kind = T.IntegerType() if by is None else T.StringType()
    rows = nodes.select("*", *keys, (F.col("pre") if by is None else by).cast(kind).alias("_by"))
    # rows that nothing holds go along, dealt by number: a second branch for them would make the table, and parse its pages, again
    dealt = rows.withColumn("_dealt", F.when(known, F.col("_page")).otherwise(F.monotonically_increasing_id()))
    schema = T.StructType([*nodes.schema.fields, T.StructField("holders", T.ArrayType(kind))])
    return dealt.repartition("_dealt").sortWithinPartitions("_page", "_pre").mapInArrow(_merged(depth), schema)


def joined(nodes: DataFrame, holds: Column, inside: Column, depth: int | None = None) -> DataFrame:
    """(page_id, holder, pre): each node for which ``inside`` is true with each element for which ``holds`` is true that holds it, or with
    its ``depth`` nearest ones. Rows that are neither don't leave the scan."""
    few = nodes.select("page_id", "pre", "last", F.coalesce(holds, F.lit(False)).alias("_h"), F.coalesce(inside, F.lit(False)).alias("_i")).where("_h OR _i")
    return held(few, F.col("_h"), depth).where("_i").select("page_id", F.explode("holders").alias("holder"), "pre")

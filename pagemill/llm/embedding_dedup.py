"""Embedding near-duplicates (operator 7): sorted projection passes with bounded windows, united over the passes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, written
from .components import connected_components

#: Least cosine of a link; least passes; neighbours compared on either side of a vector in a pass.
COSINE, PASSES, WINDOW = 0.9, 16, 48
#: A sort key's hashes, and the random directions of each: a hash is the direction, either way, that a vector points along most.
HASHES, DIRECTIONS = 8, 16
#: Chance that the passes find a link right at the least cosine, as estimated from the mean of the sample; measured, it is 0.93 at least.
RECALL = 0.99
#: Vectors, and numbers in them, of the sample that keys and passes are fitted on; passes that the estimate looks at.
SAMPLE, NUMBERS, TRIED = 1024, 1 << 20, 12
#: A vector's row in a pass; passes of a job, so that no more copies of the vectors than these are on disk at a time.
KEYED, TOGETHER = "pass int, dim int, key long, node long, v array<{}>", 32
#: Vectors of a chunk where links of loose components are counted pair by pair.
CHUNK = 512


def usable(x) -> bool:
    return x is not None and len(x) > 0 and None not in x and bool(np.isfinite(v := np.asarray(x, np.float64)).all() and v.any())


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashes(x: np.ndarray, first: int, passes: int, seed: int) -> np.ndarray:
    """[row, pass, hash] of vectors x: each hash projects them to DIRECTIONS random directions and numbers the one, either way, with
    the greatest projection. Vectors at a small angle share it more often, for as many values of a hash, than they share signs."""
    n, d = x.shape
    out = np.empty((n, passes, HASHES), np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, d, first + p]).standard_normal((d, HASHES * DIRECTIONS))
        on = (x @ planes).reshape(n, HASHES, DIRECTIONS)
        at = np.abs(on).argmax(axis=2)
        out[:, p] = 2 * at + (np.take_along_axis(on, at[:, :, None], 2)[:, :, 0] > 0)
    return out


def fitted(nodes: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, seed: int = 7) -> tuple[dict[int, np.ndarray], int]:
    """(centre of each length of vectors, passes), from a sample of at most SAMPLE distinct vectors, chosen by a hash.

    Keys are of vectors less the centre, the mean of the sample's: vectors with a common direction would share most hashes without. The
    sample also tells how many passes there have to be: each of its vectors gets a neighbour at the least cosine, in a random direction. From
    the hashes that both share, and how frequent these are, follows how many of all vectors stand between them in a pass.
    """
    count, widest = nodes.agg(F.count("*"), F.max("dim")).first()
    some = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(max(64, min(SAMPLE, NUMBERS // max(1, widest or 1)))).select("dim", "v").collect()
    by: dict[int, list] = {}
    for dim, v in some:
        by.setdefault(dim, []).append(v)
    units = {d: _unit(np.asarray(v, np.float64)) for d, v in by.items()}
    centres = {d: u.mean(axis=0) for d, u in units.items() if len(u) >= 64}
    if not centres:
        return {}, PASSES
    d, u = max(((d, units[d]) for d in centres), key=lambda x: len(x[1]))
    away = np.random.default_rng([seed, d]).standard_normal(u.shape)
    away -= (away * u).sum(axis=1, keepdims=True) * u
    near = cosine * u + math.sqrt(1 - cosine * cosine) * _unit(away) if d > 1 else u
    a, b = (_hashes(x - centres[d], 0, TRIED, seed) for x in (u, near))
    share = np.stack([[np.bincount(a[:, p, h], minlength=2 * DIRECTIONS) for h in range(HASHES)] for p in range(TRIED)]) / len(u)
    middle = np.cumsum(share, axis=2) - share / 2
    p, h = np.arange(TRIED)[None, :, None], np.arange(HASHES)[None, None, :]
    shared = np.cumprod(a == b, axis=2)  # 1 up to the first hash in which they differ
    group = np.where(shared, share[p, h, a], 1.0).prod(axis=2)
    first = np.minimum(shared.sum(axis=2), HASHES - 1)
    differ = np.take_along_axis(np.abs(middle[p, h, a] - middle[p, h, b]), first[:, :, None], 2)[:, :, 0]
    found = float((count * group * np.where(shared.all(axis=2), 0.5, differ) <= max(window - 1, 0.5)).mean())
    if found >= 1:
        return centres, PASSES
    return centres, max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-max(found, 1 / a.shape[0] / TRIED))))


def _stack(column: pa.Array) -> np.ndarray:
    """Rows of one length; the values of a list column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _keys(centres: dict[int, np.ndarray], passes: range, seed: int, number: pa.DataType):
    """Over (node, dim, v): a row for each pass with the vector's key, its hashes after each other, the first one highest."""
    shifts = (2 * DIRECTIONS - 1).bit_length() * np.arange(HASHES - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                rows = b.take(pa.array(at))
                x, v = _unit(_stack(rows.column(2))) - centres.get(d, 0.0), rows.column(2).cast(pa.list_(number))
                for p in passes:
                    key = (_hashes(x, p, 1, seed)[:, 0] << shifts).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), rows.column(1), pa.array(key), rows.column(0), v], names=["pass", "dim", "key", "node", "v"]
                    )

    return run


def _windows(cosine: float, window: int):
    """Over rows sorted by (pass, dim, key): links of each row to the ``window`` rows before it, one to each root it reaches,
    and the first and last ``window`` rows of the partition as they are, each once, for the links over its edges.

    Rows of the same run already united are joined once: what is given is a spanning forest of the links found, so
    there are at most as many as rows.
    """

    def given(a, b, rows):
        n = len(a) + rows.num_rows
        ends = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(rows.num_rows, pa.int64())]) for x in (a, b)]
        whole = [pa.concat_arrays([pa.nulls(len(a), c.type), c]) for c in rows.columns]
        return pa.RecordBatch.from_arrays([*ends, *whole], names=["a", "b", *rows.schema.names]) if n else None

    def run(batches):
        tail = None  # the last rows: (pass, dim, node, vectors)
        seen, end = 0, None  # rows of the partition so far; its last rows that are none of the first
        for b in batches:
            if not b.num_rows:
                continue
            first = b.slice(0, max(0, min(window - seen, b.num_rows)))
            rest, seen = b.slice(first.num_rows), seen + b.num_rows
            end = pa.concat_batches([end, rest]) if end is not None else rest
            end = end.slice(max(0, end.num_rows - window))
            group = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            cuts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0), True])
            a_out, b_out = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = tuple(group[:, s].tolist())
                node, v = b.column(3).to_numpy()[s:e], _unit(_stack(b.column(4).slice(s, e - s)))
                held = 0
                if tail is not None and tail[0] == at:
                    held = len(tail[1])
                    node, v = np.concatenate([tail[1], node]), np.concatenate([tail[2], v])
                root = list(range(len(node)))

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for d in range(1, min(window, len(node) - 1) + 1):
                    near = np.flatnonzero((v[d:] * v[:-d]).sum(axis=1) >= cosine)
                    for i in near[near + d >= held].tolist():
                        x, y = find(i), find(i + d)
                        if x != y:
                            root[y] = x
                            a_out.append(node[i])
                            b_out.append(node[i + d])
                tail = at, node[-window:], v[-window:]
            if (out := given(a_out, b_out, first)) is not None:
                yield out
        if end is not None and (out := given([], [], end)) is not None:
            yield out

    return run


def window_links(
    vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, seed: int = 7, single: bool = False, together: int = TOGETHER
) -> DataFrame:
    """(a, b): links of at least ``cosine`` found in the passes, as spanning forests, over rows (node, dim, v).

    Every pass sorts all vectors by its key in ranges. Each range also gives its first and last ``window`` rows; those of
    a pass are sorted once more, where the end of a range comes just before the beginning of the next. So no edge of a
    range divides a pair, and what is found doesn't depend on the ranges. ``passes`` are as fitted() says unless given; jobs take
    ``together`` of them. ``single`` says that all numbers are of single precision: half of the bytes are moved, and cosines are the same.
    """
    session(vectors)
    centres, enough = fitted(vectors, cosine, window, seed=seed)
    kind = KEYED.format("float" if single else "double")
    every = []
    for first in range(0, passes or enough, together):
        some = range(first, min(first + together, passes or enough))
        keys = vectors.select("node", "dim", "v").mapInArrow(_keys(centres, some, seed, pa.float32() if single else pa.float64()), kind)
        order = keys.repartitionByRange("pass", "dim", "key", "node").sortWithinPartitions("pass", "dim", "key", "node")
        every.append(written(order.mapInArrow(_windows(cosine, window), "a long, b long, " + kind)))
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    edges = found.where("a is null").drop("a", "b").repartition("pass", "dim").sortWithinPartitions("pass", "dim", "key", "node")
    over = edges.mapInArrow(_windows(cosine, window), "a long, b long, " + kind).where("a is not null")
    return found.where("a is not null").select("a", "b").unionByName(over.select("a", "b"))


def _tile_counts(cosine: float):
    """Links between the far rows and all rows of one component's pair of chunks."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        far, rest = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if far.empty or rest.empty:
            return pd.DataFrame({"node": [], "n": []})
        linked = _unit(np.stack(far["v"])) @ _unit(np.stack(rest["v"])).T >= cosine
        linked &= far["node"].to_numpy()[:, None] != rest["node"].to_numpy()[None, :]
        near = rest["is_far"].to_numpy() == 0
        to_far = linked.astype(np.int64) @ rest["copies"].to_numpy()
        to_near = linked[:, near].T.astype(np.int64) @ far["copies"].to_numpy()
        return pd.DataFrame({"node": np.r_[far["node"], rest["node"].to_numpy()[near]], "n": np.r_[to_far, to_near]})

    return count


def _numbered(nodes: DataFrame) -> DataFrame:
    """Adds node, a number of each distinct vector: the least id of its rows, or a number below all ids where vectors share that."""
    shared = nodes.groupBy("least_id").agg(F.count("*").alias("n")).where("n > 1").select("least_id", F.lit(True).alias("shared"))
    lowest = nodes.agg(F.min("least_id")).first()[0]
    below = F.lit(lowest or 0) - 1 - F.monotonically_increasing_id()
    return written(nodes.join(shared, "least_id", "left").withColumn("node", F.when(F.col("shared"), below).otherwise(F.col("least_id"))).drop("shared"))


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, passes: int | None = None, window: int = WINDOW
) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a count, linked to each other. Links found in the passes give the components.
    In a component, the vectors within half the links' angle of its least node all link to each other (the angle is a
    metric), so they are counted and not compared; every other vector of it is compared to all of the component in
    chunks. So n_links counts every link of a component. A link between components is one that no pass found; ``passes`` are
    fitted on a sample of the vectors (``fitted``) unless given.
    Null or zero vectors, vectors with null or non-finite components, and null ids link with nothing; vectors of
    different lengths don't link. Rows that repeat an id are nodes by their vectors: equal ones are one, others
    are as vectors of different ids; a row is given for each.
    An empty table gives an empty one; other columns are dropped.
    """
    session(df)
    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = written(src.withColumn("same", F.when(F.col("fine"), F.xxhash64("v"))))
    nodes = written(
        rows.where("fine").groupBy("same", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies")).withColumn("dim", F.size("v"))
    )
    nodes = _numbered(nodes)
    # nodes of one hash but different vectors are told apart by the vector itself
    of_row = written(rows.where("fine").join(nodes.select("same", "v", "node"), ["same", "v"]).select("vec_id", "node"))
    single = isinstance(getattr(df.schema[embedding].dataType, "elementType", None), T.FloatType)
    parts = connected_components(window_links(nodes, cosine, passes, window, single=single))
    inside = nodes.join(parts, "node").withColumn("most", F.array_max(F.transform("v", F.abs)))
    # scaled to components of 1 at most, so that no square overflows or vanishes
    inside = inside.select("node", "component", "copies", "v", F.transform("v", lambda x: x / F.col("most")).alias("u"))
    least = inside.where("node = component").select("component", F.col("u").alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.least(F.lit(1.0), dot(F.col("u"), F.col("c")) / F.sqrt(dot(F.col("u"), F.col("u"))) / F.sqrt(dot(F.col("c"), F.col("c")))))
    half = float(np.arccos(cosine)) / 2 - 1e-9
    placed = written(inside.join(least, "component").withColumn("far", angle > half).select("node", "component", "copies", "v", "far"))
    near = placed.where("not far").groupBy("component").agg(F.sum("copies").alias("near"))
    loose = placed.where("far").groupBy("component").agg(F.count("*").alias("n_far"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).join(loose, "component").withColumns(
        {"fars": F.ceil(F.col("n_far") / CHUNK).cast("int"), "alls": F.ceil(F.col("n") / CHUNK).cast("int")}
    )
    tile = placed.join(sizes, "component").withColumn("h", F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["component", "f", "a", "role", "node", "copies", "v", F.col("far").cast("int").alias("is_far")]
    as_far = tile.where("far").withColumns({"f": F.pmod("h", "fars").cast("int"), "role": F.lit(0)}).withColumn("a", each("alls")).select(*cols)
    as_all = tile.withColumns({"a": F.pmod("h", "alls").cast("int"), "role": F.lit(1)}).withColumn("f", each("fars")).select(*cols)
    # dealt by tile: the join before has all of a component in one place
    tiles = as_far.unionByName(as_all).repartition("component", "f", "a")
    counted = tiles.groupBy("component", "f", "a").applyInPandas(_tile_counts(cosine), "node long, n long")
    counted = counted.groupBy("node").agg(F.sum("n").alias("more"))
    links = placed.join(near, "component").join(counted, "node", "left").select(
        "node", "component",
        (F.when(F.col("far"), F.lit(0)).otherwise(F.col("near") - F.col("copies")) + F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    lowest = nodes.join(parts, "node").groupBy("component").agg(F.min("least_id").alias("lowest"))
    known = nodes.select("node", "least_id", "copies").join(links, "node", "left").join(lowest, "component", "left").select(
        "node", F.coalesce("lowest", "least_id").alias("component_id"), F.coalesce("n_links", F.col("copies") - 1).cast("long").alias("n_links")
    )
    good = of_row.join(known, "node").select("vec_id", "n_links", "component_id")
    bad = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

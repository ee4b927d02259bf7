"""Sharding (operator 13): records are range-partitioned by splitters sampled with their sizes. DataFrame functions only."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

SHARDS, OVERHEAD = 40, 16
#: Ranges of a shard, sampled keys of a range, and times its even share that a range may weigh before it is divided: together they
#: bound what comes to the driver and into the plan, whatever the size of the table.
RANGES, SAMPLED, OVERFULL, ROUNDS = 64, 16, 2.0, 8
#: A record of more than this part of a shard is a range of its own.
LARGE = 1 / 16
LEAST = -(1 << 63)
KEY = "struct<k1:bigint,k2:bigint,k3:bigint>"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _range(bounds: list[tuple]) -> Column:
    """The number of splitters that aren't above a row's key, by binary search in one literal array."""
    if not bounds:
        return F.lit(0)
    of = F.from_json(F.lit(json.dumps([dict(zip(("k1", "k2", "k3"), b)) for b in bounds])), f"array<{KEY}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    key = F.struct("k1", "k2", "k3")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(of, at + step - 1) <= key), at + step).otherwise(at))


def _nth(values: list, kind: str) -> Column:
    """The value of a row's range."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("range"))


def _chosen(sample: list[tuple], n: int, weight: float) -> set[tuple]:
    """Splitters at n even quantiles of rows (k1, k2, k3, weight, large) of that total weight, and around each large row.

    The first splitter of a k1 stands before all of its rows, so equal k1 stay together unless they fill a range by themselves.
    """
    out, cum, j, seen = set(), 0.0, 1, set()
    for k1, k2, k3, w, large in sorted(sample):
        cum += w
        if large:
            out |= {(k1, k2, k3), (k1, k2, k3 + 1)}
        if cum >= j * weight / n:
            out.add((k1, k2, k3) if k1 in seen else (k1, LEAST, LEAST))
            seen.add(k1)
            j = int(cum * n / weight) + 1
    return out


def _sampled(rows: DataFrame, rate: Column | float, large: float, seed: int) -> list[tuple]:
    """(range, k1, k2, k3, weight, large) of rows drawn with a chance of rate times their weight, by a hash of the key; the
    weight is divided by this chance."""
    chance = F.least(F.lit(1.0), rate * F.col("weight"))
    draw = F.shiftrightunsigned(F.xxhash64("k3", "k2", "k1", F.lit(seed)), 11) / float(1 << 53)
    got = rows.withColumn("chance", chance).where(draw < F.col("chance"))
    return [tuple(r) for r in got.select("range", "k1", "k2", "k3", F.col("weight") / F.col("chance"), F.col("size") > large).collect()]


def _dealt(ranges: list[tuple], shards: int, large: float) -> tuple[list[int], list[int]]:
    """(shard, first slot) of each range (bytes, rows) in order of keys.

    Records that are large go to the lightest shard, the largest first. The other ranges, in order, fill every shard up to
    one level: a shard's border is the border of ranges nearest to it.
    """
    shard, loads = [0] * len(ranges), [(0, s) for s in range(shards)]
    big = sorted((i for i, (size, n) in enumerate(ranges) if n == 1 and size > large), key=lambda i: (-ranges[i][0], i))
    for i in big:
        load, s = heapq.heappop(loads)
        shard[i] = s
        heapq.heappush(loads, (load + ranges[i][0], s))
    rest, level, below = sum(x[0] for x in ranges) - sum(ranges[i][0] for i in big), 0.0, 0
    for n, (load, _) in enumerate(sorted(loads), 1):  # the level at which the lightest n shards hold the rest
        below += load
        if n == shards or (rest + below) / n <= sorted(loads)[n][0]:
            level = (rest + below) / n
            break
    need = [max(0.0, level - load) for load, _ in sorted(loads, key=lambda x: x[1])]
    s, end, cum, alone = 0, need[0], 0.0, set(big)
    for i, (size, _) in enumerate(ranges):
        if i not in alone:
            while s < shards - 1 and cum + size / 2 > end:
                s += 1
                end += need[s]
            shard[i] = s
            cum += size
    base, held = [], [0] * shards
    for i, (_, n) in enumerate(ranges):
        base.append(held[shard[i]])
        held[shard[i]] += n
    return shard, base


def shards(docs: DataFrame, keep: list[str], text: str = "text", n: int = SHARDS) -> DataFrame:
    """``keep`` with size, text_crc32, shard (0 to n - 1) and slot (0, 1, ... in each shard), a row for each document.

    Keys are (hash of the text, hash of the kept columns, a number of the row), so equal texts are neighbours. A sample of
    keys, drawn with chances in proportion to a row's bytes and the mean of all, gives the quantiles that split rows into RANGES ranges a
    shard. Ranges that turn out over OVERFULL times their share are sampled again and divided, down to single rows. Shards
    are runs of ranges, and sizes differ by about the share of a range: n * RANGES ranges at most twice that share, as
    records over LARGE of a shard are ranges of their own, dealt to the lightest shards first. A text's copies share a
    shard unless they fill ranges by themselves: no group is too hot for any task.

    A record over a shard's even share has a shard to itself. Null texts have size 16, as empty ones; null ids and repeated rows are
    kept each. Reruns over the same files agree, but that rows equal in the kept columns may change places. An empty table gives an empty one. Columns of keep that clash with
    the new ones raise ValueError; others of any name are left out. The text is read once: all passes but the last go over the written keys.
    """
    clash = {"size", "text_crc32", "shard", "slot"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the input already")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = written(
        docs.select(
            row.alias("row"), size_of(F.col(f"`{text}`")).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(raw).alias("k1"), F.xxhash64(row).alias("k2"), F.monotonically_increasing_id().alias("k3"),
        )
    )
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    mean, large, even = (total or 0) / max(1, count), LARGE * (total or 0) / n, 2 * (total or 0) / (n * RANGES)
    rows = rows.withColumn("weight", F.col("size") + F.lit(mean))
    bounds: list[tuple] = []
    for round_ in range(ROUNDS + 1):  # all rows are one overfull range at first
        found = {r[0]: tuple(r)[1:] for r in rows.groupBy(_range(bounds).alias("range")).agg(F.sum("size"), F.count("*"), F.sum("weight")).collect()}
        ranges = [found.get(i, (0, 0, 0.0)) for i in range(len(bounds) + 1)]
        over = {i: w for i, (_, m, w) in enumerate(ranges) if m > 1 and w > OVERFULL * even}
        if not over or round_ == ROUNDS:
            break
        rates = [SAMPLED * min(4, 1 + round_) / even if i in over else 0.0 for i in range(len(ranges))]
        got: dict[int, list] = {i: [] for i in over}
        for i, *r in _sampled(rows.withColumn("range", _range(bounds)), _nth(rates, "double"), large, round_):
            got[i].append(tuple(r))
        more = set().union(*(_chosen(s, max(2, round(over[i] / even)), over[i]) for i, s in got.items())) - set(bounds)
        if not more:
            break
        bounds = sorted(set(bounds) | more)
    shard, base = _dealt([r[:2] for r in ranges], n, large)
    at = F.expr("row_number() OVER (PARTITION BY range ORDER BY k1, k2, k3)") - 1
    placed = rows.withColumn("range", _range(bounds)).withColumn("slot", (_nth(base, "bigint") + at).cast("long"))
    return placed.select("row.*", "size", "text_crc32", _nth(shard, "int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str | None = None, text: str = "text", n: int = SHARDS, file_rows: int = 1 << 20) -> DataFrame:
    """Writes whole documents as Parquet folders shard=0, shard=1, ... and returns what was written, read back.

    A shard's files are runs of file_rows slots, each sorted by slot, so no task holds a whole shard. Columns and odd rows as in shards().
    """
    path = path or shared_dir(docs.sparkSession)
    run = F.floor(F.col("slot") / file_rows)
    shards(docs, docs.columns, text, n).repartition(F.col("shard"), run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)

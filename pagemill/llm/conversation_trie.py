"""Conversation prefix trie (operator 11): rolling fingerprints of prefixes, verified groups, sums over subtrees."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, written

#: A conversation begins with up to HEADS - 1 turns of the first of its FAMILY of ids, as many as a checksum of its id says.
FAMILY, HEADS = 5, 9
#: Two primes below 2**31 and a base for each: a fingerprint is a pair of residues, 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Depths that a running sum takes together; rows of a partition of turns, about.
STRETCH, PART_ROWS = 4096, 1 << 20
NOTHING = hashlib.sha256().hexdigest()


class _Powers:
    """Powers of a base and of its inverse modulo a prime, as far as they were asked for."""

    def __init__(self, base: int, prime: int):
        self.prime, self.up, self.down = np.uint64(prime), np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.base, self.inverse = base, pow(base, -1, prime)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k, p = len(self.up), int(self.prime)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, p)) % self.prime])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, p)) % self.prime])
        return self.up[:n], self.down[:n]


def _scanned(batches):
    """Turns in order of (conv, turn), each with its rank in its conversation, so far as this partition has it, the rolling hash up to
    it, g = g * base + key, and base ** rank, by one scan of cumulative sums over a batch; the last state goes to the next batch."""
    from pyspark import TaskContext

    part, powers = TaskContext.get().partitionId(), [_Powers(b, p) for b, p in zip(BASES, PRIMES)]
    conv, rank, state = None, 0, [(0, 1), (0, 1)]
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = np.arange(n)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        start = np.repeat(first, np.diff(np.r_[first, n]))
        goes_on = (start == 0) & (ids[0] == conv)
        ranks = at - start + 1 + np.where(goes_on, rank, 0)
        out, last = [], []
        for table, prime, (g, w) in zip(powers, PRIMES, state):
            p = np.uint64(prime)
            up, down = table.get(n + 1)
            sums = np.r_[np.uint64(0), np.cumsum(np.mod(keys, prime).astype(np.uint64) * down[1:] % p) % p]
            own = (sums[1:] + p - sums[start]) % p * up[1:] % p
            own = np.where(goes_on, (own + np.uint64(g) * up[1:]) % p, own)
            power = np.where(goes_on, np.uint64(w) * up[1:] % p, up[at - start + 1])
            out += [own.astype(np.int64), power.astype(np.int64)]
            last.append((int(own[-1]), int(power[-1])))
        conv, rank, state = ids[-1], int(ranks[-1]), last
        cols = [pa.array(np.full(n, part, np.int64)), b.column(0), pa.array(ranks), *b.columns[1:], *map(pa.array, out)]
        yield pa.RecordBatch.from_arrays(cols, names=SCANNED)


SCANNED = ["part", "conv", "rank", "key", "nth", "bytes", "g1", "w1", "g2", "w2"]


def _turns(src: DataFrame, bits: int) -> DataFrame:
    """(conv, turn, key, nth, bytes): key is a hash of role and text. Contents are compared as they are: nth tells unlike ones of one key apart."""
    src = src.withColumn("key", F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1) if bits < 64 else F.xxhash64("role", "text"))
    contents = src.groupBy("key", "role", "text").agg(F.count("*").alias("n"))
    shared = written(contents.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    if not shared.isEmpty():
        nth = F.row_number().over(Window.partitionBy("key").orderBy("role", "text"))
        src = src.join(contents.join(shared, "key", "left_semi").select("key", "role", "text", nth.alias("nth")), ["key", "role", "text"], "left")
    else:
        src = src.withColumn("nth", F.lit(None).cast("int"))
    return src.select("conv", "turn", "key", F.coalesce("nth", F.lit(0)).alias("nth"), F.octet_length("text").cast("long").alias("bytes"))


def ranked(turns: DataFrame) -> DataFrame:
    """(conv, rank, key, nth, bytes, g1, w1, g2, w2) of each turn, over ranges of (conv, turn) of about equal rows.

    A conversation that reaches over ranges goes on from what the ranges before have of it. There are at most as many of these
    as ranges, so they are put together in the driver and broadcast: no conversation is too long for a task.
    """
    spark = session(turns)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // PART_ROWS)
    order = ["conv", F.col("turn").asc_nulls_first(), "key", "nth", "tie"]
    tied = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = "part long, conv long, rank long, key long, nth int, bytes long, g1 long, w1 long, g2 long, w2 long"
    rows = written(tied.select("conv", "key", "nth", "bytes").mapInArrow(_scanned, kinds))
    ends = rows.groupBy("part").agg(F.min("conv"), F.max("conv")).collect()
    over = sorted(c for c, n in Counter(c for _, lo, hi in ends for c in {lo, hi}).items() if n > 1)
    if not over:
        return rows.drop("part")
    last = F.max(F.struct("rank", "g1", "w1", "g2", "w2")).alias("x")
    sums = rows.where(F.col("conv").isin(over)).groupBy("conv", "part").agg(last).select("conv", "part", "x.*").orderBy("conv", "part").collect()
    bases, held = [], {}
    for conv, part, rank, g1, w1, g2, w2 in sums:
        r, *gw = held.get(conv, (0, 0, 1, 0, 1))
        bases.append((conv, part, r, *gw))
        (a1, p1), (a2, p2) = gw[:2], gw[2:]
        held[conv] = (r + rank, (a1 * w1 + g1) % PRIMES[0], p1 * w1 % PRIMES[0], (a2 * w2 + g2) % PRIMES[1], p2 * w2 % PRIMES[1])
    base = spark.createDataFrame(bases, "conv long, part long, r long, a1 long, p1 long, a2 long, p2 long")
    rows = rows.join(F.broadcast(base), ["conv", "part"], "left").fillna({"r": 0, "a1": 0, "p1": 1, "a2": 0, "p2": 1})
    g = [(F.col(f"a{i}") * F.col(f"w{i}") + F.col(f"g{i}")) % p for i, p in zip((1, 2), PRIMES)]
    w = [F.col(f"p{i}") * F.col(f"w{i}") % p for i, p in zip((1, 2), PRIMES)]
    return rows.select("conv", (F.col("rank") + F.col("r")).alias("rank"), "key", "nth", "bytes", g[0].alias("g1"), w[0].alias("w1"), g[1].alias("g2"), w[1].alias("w2"))


def rebuilt(turns: DataFrame, bits: int = 62) -> tuple[DataFrame, DataFrame]:
    """(turns of rebuilt conversations, conversations) of ranked().

    A rebuilt turn is (conv, depth, last, key, nth, bytes, cls, above): its prefix's fingerprint and that of the prefix without it. A
    conversation's own turns keep their hashes: the hash of what stands before them is taken out and that of the head put in,
    g + (head - own) * base ** (rank - h). So each conversation joins one row of its family's first one, and no turn's text is moved.
    """
    head = F.sort_array(F.collect_list(F.when(F.col("rank") < HEADS, F.struct("rank", "g1", "g2", "key", "nth", "bytes"))))
    convs = written(turns.groupBy("conv").agg(F.max("rank").alias("n"), head.alias("own")))
    first = convs.select(F.col("conv").alias("of"), F.col("own").alias("head"), F.col("n").alias("n_head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    made = convs.withColumns({"h": h, "of": F.col("conv") - F.col("conv") % FAMILY}).join(first, "of", "left")
    made = made.withColumn("m", F.least(F.col("h"), F.coalesce("n_head", F.lit(0))).cast("int"))
    made = made.withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    hash_at = lambda of, at, g: F.when(F.col(at) == 0, 0).otherwise(F.get(F.col(of), F.col(at) - 1)[g])
    moved = {}
    for i, (b, p) in enumerate(zip(BASES, PRIMES), 1):
        inverse = F.get(F.array(*[F.lit(pow(pow(b, k, p), -1, p)).cast("long") for k in range(HEADS)]), F.col("h"))
        moved[f"d{i}"] = F.pmod(hash_at("head", "m", f"g{i}") - hash_at("own", "h", f"g{i}"), F.lit(p)) * inverse % p
    made = written(made.withColumns(moved).select("conv", "h", "m", "length", "d1", "d2", F.slice(F.coalesce("head", F.array().cast(convs.schema["own"].dataType)), 1, F.col("m")).alias("head")))
    own = turns.join(made.drop("head"), "conv").where("rank > h")
    f = [(F.col(f"g{i}") + F.col(f"d{i}") * F.col(f"w{i}")) % p for i, p in zip((1, 2), PRIMES)]
    own = own.select("conv", (F.col("rank") - F.col("h") + F.col("m")).alias("depth"), "length", "key", "nth", "bytes", f[0].alias("f1"), f[1].alias("f2"))
    heads = made.select("conv", "length", F.explode("head").alias("x")).select(
        "conv", F.col("x.rank").alias("depth"), "length", "x.key", "x.nth", "x.bytes", F.col("x.g1").alias("f1"), F.col("x.g2").alias("f2")
    )
    before = [F.pmod(F.col(f"f{i}") - F.pmod("key", F.lit(p)), F.lit(p)) * pow(b, -1, p) % p for i, b, p in zip((1, 2), BASES, PRIMES)]
    one = lambda a, b: (F.shiftleft(a, 31) + b).bitwiseAND((1 << bits) - 1)
    rows = own.unionByName(heads)
    rows = rows.select("conv", "depth", (F.col("depth") == F.col("length")).alias("last"), "key", "nth", "bytes", one(F.col("f1"), F.col("f2")).alias("cls"), one(*before).alias("above"))
    return written(rows), made.select("conv", "length")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of rebuilt() whose cls and above are of equal prefixes only.

    Each group of (depth, cls) is held to its representative turn by turn: all members must have the content of the representative's turn at this
    depth and come from one group above, which by induction makes whole prefixes equal. Both ends of the order of contents and
    of groups above show it, summed before they are shuffled. If any group fails, groups are split by content and by the group
    above, named by their least conversation, until no round splits more; a round mends one depth below a collision.
    """
    turn = F.struct("key", "nth")
    ends = rows.groupBy("depth", "cls").agg(F.min(turn).alias("t"), F.max(turn).alias("u"), F.min("above").alias("a"), F.max("above").alias("b"))
    if ends.where("t <> u OR a <> b").isEmpty():
        return rows
    count, above = -1, F.lit(0).cast("long")
    rows = rows.withColumn("print", F.col("cls")).withColumn("above", above)
    while True:
        found = rows.groupBy("depth", "print", "above", "key", "nth").agg(F.min("conv").alias("rep"))
        named = written(rows.drop("cls").join(found, ["depth", "print", "above", "key", "nth"]).withColumnRenamed("rep", "cls"))
        now = named.select("depth", "print", "above", "cls").distinct().count()
        if now == count:
            return named.drop("print")
        count = now
        up = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("cls").alias("up"))
        rows = written(named.drop("above").join(up, ["conv", "depth"], "left").withColumn("above", F.coalesce("up", above)).drop("up"))


def _hashed(batches):
    """SHA-256 of the ids of each (depth, cls), comma-joined as they come; a node goes on from one batch to the next."""
    now, sha = None, None

    def done(node):
        return pa.RecordBatch.from_pylist([{"depth": node[0], "cls": node[1], "ends_sha256": sha.hexdigest()}])

    for b in batches:
        if not b.num_rows:
            continue
        depth, cls = (b.column(i).to_numpy() for i in (0, 1))
        conv = b.column(2).cast(pa.string()).to_pylist()
        cuts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (cls[1:] != cls[:-1])]).tolist()
        for i, j in zip(cuts, [*cuts[1:], b.num_rows]):
            node, text = (int(depth[i]), int(cls[i])), ",".join(conv[i:j]).encode()
            if node == now:
                sha.update(b"," + text)
                continue
            if now is not None:
                yield done(now)
            now, sha = node, hashlib.sha256(text)
    if now is not None:
        yield done(now)


def trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = 62, key_bits: int = 64
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the
    trie of rebuilt conversations, the root first in depth.

    Turns are in order of ``turn``, null first; turns that share a number are in order of a hash of role and text. Null roles and texts are empty. Rows
    without a conversation belong to none and count nowhere; repeated rows are turns each; no conversations give no rows. Columns
    other than these four don't matter.

    Sums over subtrees need no pass for each depth: a node's saving counts for the least conversation that goes through it, its representative, which goes
    through all nodes above as well. So a node's sum is that of its members' whole savings without what its own
    representative saves above it; leaves are counted alike. Work is some fifteen shuffles of narrow rows, at any depth. Ids of
    a node's ends are hashed in order as a stream: SHA-256 has no other way, a task holds one state and no list.
    """
    none = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    src = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), none(role).alias("role"), none(text).alias("text"))
    turns = ranked(_turns(src.where("conv IS NOT NULL"), key_bits))
    rows, convs = rebuilt(turns, bits)
    rows = verified(rows)
    node = ["depth", "cls"]
    nodes = rows.groupBy(*node).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("above").alias("above"))
    nodes = written(nodes)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("cls")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, node, "left").fillna({"n_children": 0})
    nodes = nodes.withColumns({"w": (F.col("n_convs") - 1) * F.col("bytes"), "leaf": (F.col("n_children") == 0).cast("long"), "stretch": F.floor(F.col("depth") / STRETCH)})
    nodes = written(nodes)
    # what a representative saves above a node, by stretches of its depths
    run = lambda *by: Window.partitionBy(*by).orderBy("stretch" if by == ("rep",) else "depth").rowsBetween(Window.unboundedPreceding, -1)
    base = nodes.groupBy("rep", "stretch").agg(F.sum("w").alias("w")).select("rep", "stretch", F.sum("w").over(run("rep")).alias("base")).where("base > 0")
    upper = nodes.withColumn("upper", F.coalesce(F.sum("w").over(run("rep", "stretch")), F.lit(0))).join(base, ["rep", "stretch"], "left")
    each = nodes.groupBy(F.col("rep").alias("conv")).agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaves"))
    sums = rows.join(each, "conv").groupBy(*node).agg(F.sum("w").alias("all"), F.sum("leaves").alias("n_leaves"))
    ends = rows.where("last").select("depth", "cls", "conv")
    ends = ends.unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("cls"), "conv"))
    ends = ends.repartition("depth", "cls").sortWithinPartitions("depth", "cls", "conv").mapInArrow(_hashed, "depth long, cls long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("cls").alias("above"), F.col("rep").alias("parent"))
    least, count = convs.agg(F.min("conv"), F.count("*")).first()
    saved = F.col("all") - F.col("upper") - F.coalesce("base", F.lit(0))
    out = upper.join(sums, node).join(parents, ["depth", "above"], "left").withColumn("saved", saved)
    columns = ["depth", "cls", "rep", "parent", "n_convs", "n_children", "n_leaves", "saved"]
    out = out.withColumn("parent", F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent"))).select(columns)
    top = nodes.agg(F.sum((F.col("depth") == 1).cast("long")).alias("n"), F.sum("leaf").alias("leaves"), F.sum("w").alias("w")).where(F.lit(count > 0))
    zero = F.lit(0).cast("long")
    top = top.select(
        zero.alias("depth"), zero.alias("cls"), F.lit(least).cast("long").alias("rep"), F.lit(None).cast("long").alias("parent"), F.lit(count).cast("long").alias("n_convs"),
        F.coalesce("n", zero).alias("n_children"), F.greatest(F.coalesce("leaves", zero), F.lit(1)).alias("n_leaves"), F.coalesce("w", zero).alias("saved"),
    )
    out = out.unionByName(top).join(ends, node, "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


#: All prefixes as lists of turns, grouped by themselves; CRC-32 bit by bit.
ORACLE = f"""WITH numbered AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT c, list(t ORDER BY k) AS turns FROM numbered GROUP BY c),
  drawn AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(s) AS BIGINT) FOR s IN string_split(CAST(c AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % {HEADS} AS h FROM own),
  whole AS (SELECT d.c, list_concat(coalesce(f.turns[1:d.h], []), d.turns[d.h + 1:]) AS turns FROM drawn d LEFT JOIN own f ON f.c = d.c - d.c % {FAMILY}),
  steps AS (SELECT c, turns, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS d FROM whole),
  nodes AS (SELECT turns[1:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(CASE WHEN d > 0 THEN strlen(turns[d].x) END), 0) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM steps GROUP BY ALL),
  counted AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.path[1:n.d] = n.path) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
  above AS (SELECT path[1:k] AS path, (n_convs - 1) * bytes AS w, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted)),
  sums AS (SELECT path, sum(w) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY path)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM counted JOIN sums USING (path)"""

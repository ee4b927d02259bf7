"""Mixing sources to target weights (operator 5) by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, written

#: White space is \x20 and \x09-\x0D; the weights repeat over the sources; words mixed per word; the most repeats.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words of a block at most; a source whose target has fewer blocks gets this many smaller ones (or one a word).
BLOCK, BLOCKS = 4096, 64
#: Documents of a source in a task's running sum, about; digits of the hash that deal them out are chosen by it.
ROWS = 1 << 16
#: Words of a partition of the mix in order, about.
PART_WORDS = 1 << 20
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(df: DataFrame) -> DataFrame:
    """Order of sources by code point, null last, which Spark's byte order of UTF-8 is."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target) of each row (source, source_size), in one pass without iteration.

    Giving the excess of full sources to the others by weight, again and again, ends at one water level: a source
    gets the least of weight * level and its cap. Sorted by cap / weight, the first source that isn't full shows the
    level, and those after it show lower ones. The rows here are sources, not documents.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    of = _numbered(sizes).withColumns({"weight": weight, "cap": most * F.col("source_size")})
    of = of.withColumns({"all": share * F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything)})
    level = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    of = of.withColumn("level", level)
    open_ = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    of = of.withColumn("level", F.max(open_).over(everything))
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return of.withColumn("target", target).select("source", "source_size", "rank", "target")


def in_blocks(sources: DataFrame, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Adds goal (the target in whole words), blocks, block (words of each but the last) and the source's share [low, high) of
    the schedule, by its blocks, to the rows of targets()."""
    goal = F.round("target").cast("long")
    n = F.greatest(F.ceil(F.col("goal") / block), F.least("goal", F.lit(blocks))).cast("long")
    of = sources.withColumn("goal", goal).withColumn("blocks", n).withColumn("block", F.ceil(F.col("goal") / F.when(n > 0, n)).cast("long"))
    ranked = Window.orderBy("rank")
    of = of.withColumn("high", F.sum("blocks").over(ranked) / F.expr("nullif(sum(blocks) over (), 0)"))
    return of.withColumn("low", F.lag("high", 1, 0.0).over(ranked))


def schedule(spark, sources: DataFrame) -> DataFrame:
    """(slot, rank, turn): the order in which a mix's blocks are read, over rows of in_blocks(); turn is the block of the source.

    There are as many golden-ratio points as blocks. The point of a slot falls into one source's share, and the turn counts
    that source's slots before it. A source's slots are as many as its blocks but for the discrepancy of the points (a
    few, whatever the size): turns beyond its blocks fall out, and blocks that got no slot come after the last, in turn.

    Slots are a distributed range in stretches of 4,096: turns are counted in each stretch, and stretches are
    summed by source. Sources meet slots by a coarse grid of shares, so each slot meets a few sources only.
    """
    stretch, grid = 4096, 4096
    total, last, ranks = sources.agg(F.sum("blocks"), F.max(F.when(F.col("blocks") > 0, F.col("rank"))), F.count("*")).first()
    lo, hi = F.floor(F.col("low") * grid).cast("int"), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)).cast("int")
    cells = sources.where("blocks > 0").select("rank", "low", "high", F.explode(F.sequence(lo, hi)).alias("cell"))
    points = spark.range(total or 0).withColumn("point", F.pmod(F.lit(0.5) + F.col("id") * GOLDEN, F.lit(1.0)))
    points = points.withColumn("cell", F.floor(F.col("point") * grid).cast("int")).withColumnRenamed("id", "slot")
    # shares follow each other without a gap; the last ends at 1 whatever rounding leaves of it
    within = (F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | (F.col("rank") == F.lit(last)))
    hit = points.join(cells, "cell").where(within).withColumn("stretch", F.floor(F.col("slot") / stretch))
    turns = Window.partitionBy("stretch", "rank").orderBy("slot")
    hit = hit.select("slot", "rank", "stretch", (F.row_number().over(turns) - 1).alias("turn"))
    sums = hit.groupBy("rank", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("rank", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    dealt = hit.join(base, ["rank", "stretch"]).select("slot", "rank", (F.col("turn") + F.col("base")).alias("turn"))
    dealt = dealt.join(sources.select("rank", "blocks"), "rank").where("turn < blocks").select("slot", "rank", "turn")
    got = sources.join(sums.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = got.where("n < blocks").select("rank", "n", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("turn"))
    return dealt.unionByName(more.select((F.lit(total or 0) + (F.col("turn") - F.col("n")) * ranks + F.col("rank")).alias("slot"), "rank", "turn"))


def mix(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
) -> DataFrame:
    """``keep`` with size, source_size, target, taken, copies and slots, a row for each document.

    Each source's documents are shuffled by a hash of their id and text and laid end to end, again and again. The line
    is cut into blocks of equal words up to the source's target, the last block being what is left. The schedule's slots are
    joined to the blocks of their source and turn; taken is what a document's words in these blocks sum to, and slots (ascending,
    at most ``most``) are those of the blocks that it begins in, each time that it is taken: the place of its copies in the mix. copies is how often it
    comes whole, as often as its taken words go into its size, the rest decided by the hash. So a source's
    taken sum to its target, rounded, whatever the sizes of the others, and no document takes more than ``most`` times its
    size (a whole number).
    Null or blank texts have size 0 and take 0. Null sources are one source, the last; sources of size 0 have target 0.
    Repeated rows are laid in turn; an empty table gives an empty one. Nothing depends on partitions, so reruns agree.
    Texts are written once and meet what they take in one join; all else is done on keys and sizes.
    """
    spark = session(docs)
    clash = {"size", "source_size", "target", "taken", "copies", "slots"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the input already")
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("key"), row.alias("row"), F.col(f"`{source}`").cast("string").alias("source"),
            n_words(F.col(f"`{text}`")).alias("size"), F.md5(F.concat(said(doc_id), F.lit(":"), said(text)).cast("binary")).alias("h"), F.xxhash64(row).alias("tie"),
        )
    )
    lines = rows.drop("row")
    digits = max(2, math.ceil(math.log(max(1, rows.count()) / ROWS, 16)))
    lines = lines.withColumn("bucket", F.substring("h", 1, digits))
    sums = written(lines.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sources = written(in_blocks(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), block))
    # one row for each source and bucket
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.join(sources, sums.source.eqNullSafe(sources.source)).select(
        sums.source.alias("s"), F.col("bucket").alias("k"), "rank", "source_size", "target", "goal", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    laid = Window.partitionBy("source", "bucket").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.withColumn("offset", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    at = at.join(base, at.source.eqNullSafe(base.s) & (at.bucket == base.k)).withColumn("start", F.col("base") + F.col("offset"))
    drawn = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = written(at.select("key", "rank", "size", "source_size", "target", "goal", "block", "start", drawn.alias("drawn")))
    # a document's places in its source's repeated line up to the goal, and the blocks that they lie in
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal") - 1 - F.col("start")) / F.col("source_size")))
    placed = at.where("size > 0 and start < goal").withColumn("round", F.explode(rounds)).withColumn("a", F.col("round") * F.col("source_size") + F.col("start"))
    placed = placed.withColumn("b", F.least(F.col("a") + F.col("size"), "goal"))
    turn = F.explode(F.sequence(F.floor(F.col("a") / F.col("block")), F.floor((F.col("b") - 1) / F.col("block"))))
    placed = placed.select("key", "rank", "a", "b", "block", turn.alias("turn"))
    words = F.least("b", (F.col("turn") + 1) * F.col("block")) - F.greatest("a", F.col("turn") * F.col("block"))
    begins = F.col("turn") == F.floor(F.col("a") / F.col("block"))
    read = placed.join(schedule(spark, sources), ["rank", "turn"])
    taken = read.groupBy("key").agg(F.sum(words).alias("taken"), F.array_sort(F.collect_list(F.when(begins, F.col("slot")))).alias("slots"))
    none = F.array().cast("array<bigint>")
    words = F.coalesce("taken", F.lit(0))
    copies = F.when(F.col("size") > 0, F.floor(words / F.col("size") + F.col("drawn"))).otherwise(0).cast("int")
    known = at.join(taken, "key", "left").select("key", "size", "source_size", "target", words.alias("taken"), copies.alias("copies"), F.coalesce("slots", none).alias("slots"))
    return rows.select("key", "row").join(known, "key").select("row.*", "size", "source_size", "target", "taken", "copies", "slots")


def in_order(mixed: DataFrame, slot: str = "slot", words: str = "size") -> DataFrame:
    """Rows of a mix in the order of their slots: partitions are ranges of slots of about PART_WORDS words, and so are the files of what is
    written, by name; any run of files has the shares of the targets, but for a few blocks. Slots are even, so no sample is taken."""
    top, total = mixed.agg(F.max(slot), F.sum(words)).first()
    parts = max(1, math.ceil((total or 0) / PART_WORDS))
    part = F.least(F.floor(F.col(slot) * parts / float((top or 0) + 1)), F.lit(parts - 1)).cast("int")
    ties = [c for c in mixed.columns if c != slot]
    return mixed.withColumn("_part", part).repartitionById(parts, "_part").drop("_part").sortWithinPartitions(slot, F.xxhash64(*ties))


#: Sums and takes as the schedule leaves them, every block of a source's line up to its target; and the slot of the block that each document
#: begins in: golden-ratio points through the shares, numbered within their source, missing turns after the last.
ORACLE = f"""WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
  sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
  caps AS (SELECT *, CASE rank % {len(WEIGHTS)} {" ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))} END AS weight, {MOST} * source_size AS cap FROM sums),
  filled AS (SELECT *, (sum({SHARE} * source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
    FROM caps WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  aimed AS (SELECT *, coalesce(least(cap, weight * max(level) FILTER (cap / weight >= level) OVER ()), cap) AS target FROM filled),
  whole AS (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM aimed),
  cut AS (SELECT *, greatest((goal + {BLOCK - 1}) // {BLOCK}, least(goal, {BLOCKS})) AS blocks FROM whole),
  shares AS (SELECT *, CASE WHEN blocks > 0 THEN (goal + blocks - 1) // blocks END AS block, sum(blocks) OVER () AS total,
    CAST(sum(blocks) OVER (ORDER BY rank) AS DOUBLE) / sum(blocks) OVER () AS high, CAST(sum(blocks) OVER (ORDER BY rank) - blocks AS DOUBLE) / sum(blocks) OVER () AS low,
    max(rank) FILTER (blocks > 0) OVER () AS last, count(*) OVER () AS ranks FROM cut),
  points AS (SELECT i AS slot, (CAST(0.5 AS DOUBLE) + i * CAST({GOLDEN} AS DOUBLE)) % CAST(1 AS DOUBLE) AS point FROM range(CAST((SELECT max(total) FROM shares) AS BIGINT)) r(i)),
  hits AS (SELECT slot, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn FROM points JOIN shares ON blocks > 0 AND point >= low AND (point < high OR rank = last)),
  got AS (SELECT s.rank, s.total, s.ranks, s.blocks, count(h.slot) AS n FROM shares s LEFT JOIN hits h USING (rank) GROUP BY ALL),
  slots AS (SELECT slot, rank, turn FROM hits JOIN shares USING (rank) WHERE turn < blocks
    UNION ALL SELECT total + (t - n) * ranks + rank, rank, t FROM (SELECT *, unnest(range(CAST(n AS BIGINT), CAST(blocks AS BIGINT))) AS t FROM got)),
  laid AS (SELECT doc_id, size, source_size, target, goal, rank, block,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM sized s JOIN shares a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(CASE WHEN size = 0 THEN 0
  ELSE goal // source_size * size + greatest(0, least(size, goal - goal // source_size * source_size - start)) END AS BIGINT) AS taken, CAST(slot AS BIGINT) AS first_slot
  FROM laid LEFT JOIN slots ON size > 0 AND start < goal AND slots.rank = laid.rank AND turn = start // block"""

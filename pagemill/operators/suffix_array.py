"""A suffix array of a column of texts: every suffix's place in order, by prefix doubling over shuffles of numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept, shared_folder

#: Letters that the first order of suffixes is by; each round doubles them.
FIRST = 8
#: Places of a row of the stored array's directory.
STEP = 1 << 12


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the number (from 0) of rows before those of a row's key, over ranges of keys: counts of each key are summed within a range, and ranges
    by their totals. A key that very many rows share is one row of counts."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n")).repartitionByRange(*by).sortWithinPartitions(*by)
    counts = kept(counts.withColumn("_part", F.spark_partition_id()))
    totals = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = counts.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", F.coalesce(F.sum("_all").over(totals), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(base, "_part")
    numbered = numbered.select(*by, (F.col("_in") + F.col("_base")).alias(name))
    return rows.join(numbered, by)


def suffix_array(records: DataFrame, id_column: str, column: str = "title", first: int = FIRST) -> DataFrame:
    """(id, at, rank): for each letter of a text in lower case, from 1, how many suffixes of all texts come before the one that begins there.

    Ranks by the first letters come from the letters themselves. Then a suffix's rank by twice as many is the order of its own rank and of the one of the
    suffix that begins where those letters end: rounds of one self-join of (id, at, rank) each, until no two suffixes share a rank or all those
    that do are equal to the end. So a number is shuffled for a place of a text and never the suffix. Equal suffixes share a rank, as a text that is
    stored twice has. Null and empty texts have no rows; rows that repeat an id must repeat its text; no records give no rows.
    """
    lower = records.where(F.length(column) > 0).select(F.col(f"`{id_column}`").alias("id"), F.lower(column).alias("t")).where("id is not null").dropDuplicates(["id"])
    cut = lower.select("id", F.length("t").alias("end"), F.col("t"), F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at"))
    cut = cut.select("id", "at", "end", F.substring(F.col("t"), F.col("at"), F.lit(first)).alias("key"))
    ranks = kept(_numbered(cut, ["key"], "rank").select("id", "at", "end", "rank"))
    width, longest = first, ranks.agg(F.max("end")).first()[0] or 0
    shared = -1
    while width < longest:
        now = ranks.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if not now[0] or now == shared:
            break
        shared = now
        after = ranks.select("id", (F.col("at") - width).alias("at"), F.col("rank").alias("then")).where("at > 0")
        pair = ranks.join(after, ["id", "at"], "left").withColumn("then", F.coalesce("then", F.lit(-1).cast("long")))  # nothing comes before anything
        ranks = kept(_numbered(pair, ["rank", "then"], "new").select("id", "at", "end", F.col("new").alias("rank")))
        width *= 2
    return ranks.select("id", "at", "rank")


class SuffixArray:
    """Texts, and the places of their suffixes in order, stored: (rank, id, at, common), the last being how many letters a suffix shares with the one before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts, self.places, self.directory = (spark.read.parquet(f"{path}/{x}") for x in ("texts", "places", "directory"))

    @classmethod
    def write(cls, records: DataFrame, id_column: str, column: str = "title", path: str | None = None) -> SuffixArray:
        """Stores the array of a column at a path, or in a new folder of the shared one; odd rows are as in suffix_array()."""
        spark = records.sparkSession
        path = path or f"{shared_folder(spark)}/suffix-array-{uuid.uuid4().hex}"
        texts = records.where(F.length(column) > 0).select(F.col(f"`{id_column}`").alias("id"), F.lower(column).alias("text")).where("id is not null").dropDuplicates(["id"])
        texts.write.parquet(f"{path}/texts")
        order = kept(suffix_array(records, id_column, column).repartitionByRange("rank", "id", "at").sortWithinPartitions("rank", "id", "at").withColumn("part", F.spark_partition_id()))
        # neighbours in order: within a range, and the last of a range with the first of the next
        within = Window.partitionBy("part").orderBy("rank", "id", "at")
        sizes = order.groupBy("part").agg(F.count("*").alias("n"), F.max(F.struct("rank", "id", "at")).alias("end"))
        ranges = sizes.select(
            "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
            F.lag("end").over(Window.orderBy("part")).alias("carried"),
        )
        placed = order.withColumns({"n": F.row_number().over(within) - 1, "before": F.lag(F.struct("rank", "id", "at")).over(within)}).join(ranges, "part")
        placed = placed.withColumns({"place": F.col("n") + F.col("base"), "before": F.coalesce("before", "carried")})
        own = spark.read.parquet(f"{path}/texts")
        pair = placed.join(own, "id").join(own.select(F.col("id").alias("bid"), F.col("text").alias("btext")), F.col("before.id") == F.col("bid"), "left")
        a, b = F.expr("substring(text, at)"), F.expr("substring(btext, before.at)")
        common = F.when(F.col("btext").isNull(), 0).otherwise(_shared(a, b))
        pair.select("place", "rank", "id", "at", common.cast("int").alias("common")).repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/places")
        places = spark.read.parquet(f"{path}/places")
        steps = places.where(F.col("place") % STEP == 0).join(own, "id").select("place", F.expr("substring(text, at)").alias("suffix"))
        steps.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/directory")
        return cls(spark, path)

    def search(self, term: str) -> DataFrame:
        """(id, at) of every place where a text holds the term, in any case, of any length.

        The directory, a suffix for each STEP places, bounds the run of places whose suffixes begin with the term; only row groups of that run are
        read, and its two ends are compared with the texts."""
        low = term.lower()
        key = F.substring(F.col("suffix"), 1, len(low)) if low else F.lit("")
        lo, hi = self.directory.agg(F.max(F.when(key < low, F.col("place"))), F.min(F.when(key > low, F.col("place")))).first()
        run = self.places.where((F.col("place") >= (lo or 0)) & (F.lit(True) if hi is None else F.col("place") < hi))
        sure = self.directory.where(key == low).agg(F.min("place"), F.max("place")).first()
        inner = F.lit(False) if sure[0] is None else F.col("place").between(*sure)
        edge = run.where(~inner).join(self.texts, "id").where(F.expr("substring(text, at)").startswith(low)).select("id", "at")
        return run.where(inner).select("id", "at").unionByName(edge)

    def longest_repeat(self) -> DataFrame:
        """(id, at, length, passage): a longest passage that stands at two places, at the first of them in order; no row where no letter repeats."""
        top = self.places.agg(F.max(F.struct("common", (-F.col("place")).alias("p"), "id", "at")).alias("x")).select("x.*").where("common > 0")
        return top.join(self.texts, "id").select("id", "at", F.col("common").alias("length"), F.expr("substring(text, at, common)").alias("passage"))


def _shared(a: Column, b: Column) -> Column:
    """Letters that two texts share from their beginnings, by halving: a text of n letters takes log n comparisons."""
    most = F.least(F.length(a), F.length(b))
    halves = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(most, F.lit(1)))).cast("int") + 1)
    of = lambda x, n: F.substring(x, F.lit(1), n)

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
        same = of(a, mid) == of(b, mid)
        return F.struct(F.when(same, mid).otherwise(at["lo"]).alias("lo"), F.when(same, at["hi"]).otherwise(F.greatest(mid - 1, at["lo"])).alias("hi"))

    return F.aggregate(halves, F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi")), step, lambda at: at["lo"])

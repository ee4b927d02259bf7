"""Search over stored records: substring of a title, by scan or by a suffix table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import write_json
from ..sources.sinks import shared_folder

#: Letters of the suffixes' keys, and of the suffixes themselves.
KEY, LONGEST = 3, 32


def search(records: DataFrame, term: str, column: str = "title") -> DataFrame:
    """Records whose title holds the term, in any case."""
    return records.where(F.contains(F.lower(column), F.lit(term.lower())))


def as_json_array(records: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """One row, json: the records as a JSON array, in the order of a column. All of them meet in one row, so this is for what a
    search prints, and more than ``most`` are an error; sinks.write_json_lines() writes a result of any size."""
    records = records.limit(most + 1)
    rec = F.struct(F.col(order).alias("_o"), write_json(F.struct(*records.columns)).alias("j"))
    every = F.transform(F.array_sort(F.collect_list(rec)), lambda x: x.j)
    fits = F.when(F.count("*") > most, F.raise_error(F.lit(f"more than {most} records: write JSON lines"))).otherwise("[")
    return records.agg(F.concat(fits, F.array_join(every, ","), F.lit("]")).alias("json"))


def suffixes(records: DataFrame, id_column: str, column: str = "title", longest: int = LONGEST) -> DataFrame:
    """(key, suffix, at, id): each suffix of a title, its first ``longest`` letters in lower case, and where it begins; key is its
    first letters. Written in order of suffixes, a search reads the row groups of its term."""
    cut = records.where(F.length(column) > 0).select(F.col(id_column).alias("id"), F.lower(column).alias("t"))
    cut = cut.select("id", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at"))
    suffix = F.substring(F.col("t"), F.col("at"), F.lit(longest))
    return cut.select(F.substring(suffix, 1, KEY).alias("key"), suffix.alias("suffix"), "at", "id")


def search_suffixes(table: DataFrame, term: str, longest: int = LONGEST) -> DataFrame:
    """(id): of the titles that hold the term, in any case. A term longer than the suffixes is looked up in parts, which must
    follow each other in the title."""
    low, found = term.lower(), None
    for k in range(0, max(1, len(low)), longest):
        part = low[k : k + longest]
        key: Column = F.col("key") == part[:KEY] if len(part) >= KEY else F.col("key").startswith(part)
        hits = table.where(key & F.col("suffix").startswith(part)).select("id", (F.col("at") - k).alias("at"))
        if found is not None:
            then = hits.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
            hits = found.join(then, F.col("id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at")), "left_semi")
        found = hits
    return found.select("id").distinct()


class Index:
    """Records of a title, as of and source, and the suffixes of their titles, both stored."""

    def __init__(self, spark: SparkSession, path: str, id_column: str, longest: int = LONGEST):
        self.records, self.table = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/suffixes")
        self.id_column, self.longest = id_column, longest

    @classmethod
    def write(cls, spark: SparkSession, records: DataFrame, id_column: str, path: str | None = None, longest: int = LONGEST) -> Index:
        """Stores an index at a path, or in a new folder of the shared one; records hold the id, title, as_of and source. Null and empty titles are stored and
        have no suffixes, null ids are found as null, rows that repeat an id are found each; no records make an empty index; other columns are left out."""
        path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        records.select(id_column, "title", "as_of", "source").write.parquet(f"{path}/records")
        stored = spark.read.parquet(f"{path}/records")
        suffixes(stored, id_column, longest=longest).repartitionByRange("suffix").sortWithinPartitions("suffix").write.parquet(f"{path}/suffixes")
        return cls(spark, path, id_column, longest)

    def search(self, term: str) -> DataFrame:
        """The records whose title holds the term, in any case. The suffixes find ids; of records that share one, those count whose own title holds it."""
        found = search_suffixes(self.table, term, self.longest).withColumnRenamed("id", "_id")
        return search(self.records.join(found, F.col(self.id_column).eqNullSafe(F.col("_id")), "left_semi"), term)

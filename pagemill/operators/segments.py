"""An index of records in segments: appended batches, of which the newest record of an id counts, with removals and compaction."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder
from .search import search

RECORD = "title string, as_of string, source string"
#: Buckets of ids within a segment: compaction and merges read a segment's rows of one bucket together.
BUCKETS = 64


class Segments:
    """Records of (id, title, as_of, source) in folders of Parquet, and a manifest of the folders that count.

    A batch is written whole before the manifest names it, and a manifest is a new file, never a changed one: the greatest
    number is the state. So a lost writer leaves a folder that nobody reads, and readers see the state that they opened.
    One writer at a time: a second one that writes the same number fails.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id_column: str = "page_id"):
        self.spark, self.id_column = spark, id_column
        self.path = path or f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
        self.number, self.folders = self._state()

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, list[str]]:
        root, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(root):
            return 0, []
        last = max((f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return 0, []
        return int(last[:-5]), json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{last}").collect()))

    def _commit(self, folders: list[str]) -> None:
        name, fs = self._fs(f"{self.path}/manifest/{self.number + 1:09}.json")
        out = fs.create(name, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        self.number, self.folders = self.number + 1, folders

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS))
        rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "id").write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, records: DataFrame) -> Segments:
        """Adds a segment. Columns but for id, title, as_of and source are left out; null ids too, as they name no record. Rows of one id
        are one record, the newest of them."""
        self._commit([*self.folders, self._written(self._rows(records, F.lit(False)))])
        return self

    def remove(self, ids: DataFrame, as_of: str) -> Segments:
        """Adds a segment of tombstones: records of these ids (the first column) that aren't newer than as_of are gone."""
        gone = ids.select(F.col(ids.columns[0]).alias(self.id_column), F.lit(None).cast("string").alias("title"), F.lit(as_of).alias("as_of"), F.lit(None).cast("string").alias("source"))
        self._commit([*self.folders, self._written(self._rows(gone, F.lit(True)))])
        return self

    def _rows(self, records: DataFrame, gone) -> DataFrame:
        rows = records.select(F.col(f"`{self.id_column}`").cast("long").alias("id"), *[F.col(c).cast("string") for c in ("title", "as_of", "source")]).where("id is not null")
        return rows.withColumns({"gone": gone, "segment": F.lit(len(self.folders))})

    def _newest(self) -> DataFrame:
        """One row of each id over all segments: that of the greatest as_of (null first), of equal ones the latest segment's, summed up before it is shuffled."""
        kind = f"id long, {RECORD}, gone boolean, segment int, bucket long"
        if not self.folders:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in self.folders])
        order = F.struct(F.coalesce("as_of", F.lit("")).alias("a"), F.col("as_of").isNotNull().alias("b"), "segment", F.col("gone"), F.xxhash64("title", "source").alias("h"))
        return rows.groupBy("id").agg(F.max_by(F.struct("title", "as_of", "source", "gone"), order).alias("r")).select("id", "r.*")

    def records(self) -> DataFrame:
        """(id, title, as_of, source) of the records that count."""
        return self._newest().where("not gone").select(F.col("id").alias(self.id_column), "title", "as_of", "source")

    def search(self, term: str) -> DataFrame:
        """The records that count whose title holds the term, in any case. Old titles of an id don't, so segments are merged first."""
        return search(self.records(), term)

    def compact(self) -> Segments:
        """All segments in one, without tombstones and older records. Folders that no manifest names any more stay for readers of earlier ones."""
        live = self._newest().where("not gone").withColumns({"segment": F.lit(0)}).select("id", "title", "as_of", "source", "gone", "segment")
        self._commit([self._written(live)])
        return self

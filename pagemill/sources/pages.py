"""Sources: stored pages and page files, by content type and status; decoding of bytes."""

from __future__ import annotations

import codecs
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of decoded texts that are Python objects at a time (but for one longer text).
PIECE = 1 << 20


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of a Parquet table; only these columns are scanned."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of whole files, gunzipped where they are gzip files. Damaged or cut-off gzip files have null content; files without bytes
    have no row, as Spark's reader has none; a folder without files gives no rows. A file is one row, so it must fit a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", gunzip(F.col("content")).alias("content"))


def _inflate(x: bytes | None) -> bytes | None:
    if x is None or x[:2] != b"\x1f\x8b":
        return x
    out = b""
    try:
        while x[:2] == b"\x1f\x8b":  # members follow each other
            d = zlib.decompressobj(31)
            out += d.decompress(x) + d.flush()
            if not d.eof:  # cut off
                return None
            x = d.unused_data
    except zlib.error:
        return None
    return out


@F.pandas_udf(T.BinaryType())
def gunzip(content: pd.Series) -> pd.Series:
    """The content of a gzip file; other bytes as they are; null where the file is damaged."""
    return content.map(_inflate, na_action="ignore")


def _decoded(x: bytes | None, label: str | None) -> str | None:
    if x is None or label is None:
        return None
    try:
        return x.decode(codecs.lookup(label.strip()).name, "replace")
    except (LookupError, ValueError):
        return None


@F.arrow_udf(T.StringType())
def _decode(content: pa.Array, charset: pa.Array) -> pa.Array:
    # a batch as a whole is there as Arrow's bytes only; Python's objects are of one piece of it at a time
    parts, out, held = [], [], 0
    for i in range(len(content)):
        said = _decoded(content[i].as_py(), charset[i].as_py())
        out.append(None if said is None else said.encode("utf-8", "replace"))
        held += len(out[-1] or b"")
        if held >= PIECE:
            parts.append(pa.array(out, pa.binary()))
            out, held = [], 0
    parts.append(pa.array(out, pa.binary()))
    return pa.concat_arrays(parts).cast(pa.string())


#: Text of bytes by the label of their charset, with replacement; null where no such decoder is known. Named nondeterministic, as Spark would decode once for
#: a filter on the text and again for the text, with a second Python worker for each task.
decode_legacy = _decode.asNondeterministic()


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def charset_of(content_type: Column, otherwise: str = "utf-8") -> Column:
    found = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1))
    return F.when(found != "", found).otherwise(otherwise)


#: A tag with its attributes; the bytes that are looked through for one that names the charset.
_TAG, PRESCAN = r"""<[a-zA-Z/](?:"[^"]*"|'[^']*'|[^'">])*>""", 1024
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, empty if it has none."""
    pattern = rf"(?i)^(?:\s*[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?[\s/]+)*?{name}\s*=\s*{_VALUE}"
    rest = F.regexp_replace(tag, r"(?i)^<meta[\s/]*", "")
    return F.concat(*[F.regexp_extract(rest, pattern, i) for i in (1, 2, 3)])


def prescanned(body: Column) -> Column:
    """The charset that an HTML document names itself: by its byte order mark, or by the first meta element within its first 1,024 bytes that
    names one; null if neither does. UTF-16 in a meta element can't be, so it is UTF-8; comments don't count."""
    mark = F.hex(F.substring(body, 1, 3))
    head = F.regexp_replace(F.decode(F.substring(body, 1, PRESCAN), "ISO-8859-1"), r"(?s)<!--.*?(-->|$)", "")
    metas = F.filter(F.regexp_extract_all(head, F.lit(_TAG), F.lit(0)), lambda t: t.rlike(r"(?i)^<meta[\s/]"))
    pragma = lambda t: F.when(F.lower(_attribute(t, "http-equiv")) == "content-type", charset_of(_attribute(t, "content"), ""))
    named = F.transform(metas, lambda t: F.lower(F.trim(F.coalesce(F.nullif(_attribute(t, "charset"), F.lit("")), pragma(t), F.lit("")))))
    first = F.try_element_at(F.filter(named, lambda c: c != ""), F.lit(1))
    said = F.when(first.startswith("utf-16"), "utf-8").when(first == "x-user-defined", "windows-1252").otherwise(first)
    return F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FEFF"), "utf-16be").when(mark.startswith("FFFE"), "utf-16le").otherwise(said)


def dispatch(responses: DataFrame, content_type: str = "content_type", body: str = "body") -> dict[str, DataFrame]:
    """html and text tables of responses by media type, case-insensitive, bodies decoded; others are dropped.

    The charset is that of the byte order mark, which goes from the text, else of the header, else, in HTML, of the document itself, else UTF-8; null bodies and
    unknown charsets are left out."""
    kind, said = media_type(F.col(content_type)), charset_of(F.col(content_type), "")
    own = prescanned(F.col(body))
    marked = F.hex(F.substring(body, 1, 3)).rlike("^(EFBBBF|FEFF|FFFE)")
    charset = F.when(marked, own).when(said != "", said).when(kind == "text/html", F.coalesce(own, F.lit("utf-8"))).otherwise("utf-8")
    read = lambda only: responses.where(kind == only).withColumn("text", F.regexp_replace(decode_legacy(F.col(body), charset), "^\ufeff", "")).where("text is not null")
    return {"html": read("text/html").withColumnRenamed("text", "html"), "text": read("text/plain")}


def by_status(responses: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): status 200 and all else, null included."""
    ok = F.coalesce(F.col(status) == 200, F.lit(False))
    return responses.where(ok), responses.where(~ok)


def store_responses(responses: DataFrame, path: str, status: str = "status", content_type: str = "content_type") -> None:
    """Appends responses under partitions of status_is and kind (the media type), so that readers of some skip the files of the others. Null ones
    have partitions of their own; columns of these names raise an error of Spark's."""
    keyed = responses.withColumns({"status_is": F.col(status).cast("int"), "kind": media_type(F.col(content_type))})
    keyed.repartition("status_is", "kind", F.pmod(F.monotonically_increasing_id(), F.lit(16))).write.mode("append").partitionBy("status_is", "kind").parquet(path)


def read_responses(spark: SparkSession, path: str, kinds: tuple = ("text/html", "text/plain"), stream: bool = False, schema: str | None = None) -> DataFrame:
    """Stored responses of status 200 and these media types: only the files of their partitions are read. As a stream, whose offsets
    are the files that came, it needs the schema with the partitions' columns."""
    reader = spark.readStream if stream else spark.read
    found = (reader.schema(schema) if schema else reader).parquet(path)
    return found.where((F.col("status_is") == 200) & F.col("kind").isin(*kinds)).drop("status_is", "kind")

"""URL and form coding as columns: built-ins where they have the right meaning, Arrow batches where none has."""

from __future__ import annotations

import codecs
from urllib.parse import unquote_to_bytes, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def encode_value(value: Column) -> Column:
    """Form coding of UTF-8 bytes: a space is +, letters, digits and * - . _ stay, all else is %XX."""
    return F.url_encode(value)


def strict_split(value: Column, separator: str = "&") -> Column:
    """Inner empty parts stay; an empty last part goes."""
    parts = F.split(value, f"\\Q{separator}\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _decoder(label: str) -> str:
    try:
        return codecs.lookup(label or "utf-8").name
    except (LookupError, ValueError):
        return "utf-8"


def _decoded(value: str, charset: str = "utf-8") -> str:
    return unquote_to_bytes(value.replace("+", " ")).decode(_decoder(charset), "replace")


@F.pandas_udf(T.StringType())
def decode_value(values: pd.Series) -> pd.Series:
    """+ is a space and %HH a byte; a malformed % stays; bytes are UTF-8, with replacement."""
    return values.map(_decoded, na_action="ignore")


def query_pairs(query: Column, charset: str = "utf-8", isindex: bool = False) -> Column:
    """Ordered (name, value) pairs of a query. The first = divides; without one the value is empty, or, for the first
    string under isindex, the name is. A pair _charset_ sets the charset of itself and later pairs. Null: null."""

    @F.pandas_udf(PAIRS)
    def split(queries: pd.Series) -> pd.Series:
        def of(q):
            if q is None:
                return None
            parts, now, out = q.split("&"), charset, []
            if parts[-1] == "":
                parts.pop()
            for i, p in enumerate(parts):
                name, eq, value = p.partition("=")
                if isindex and i == 0 and not eq:
                    name, value = "", p
                if _decoded(name) == "_charset_":
                    now = _decoded(value)
                out.append({"name": _decoded(name, now), "value": _decoded(value, now)})
            return out

        return pd.Series([of(q) for q in queries], dtype="object")

    return split(query)


def first_value(pairs: Column, name: str) -> Column:
    """The value of the first pair of this name, or null."""
    return F.try_element_at(F.filter(pairs, lambda p: p["name"] == name), F.lit(1))["value"]


def url_encode_pairs(data: Column) -> Column:
    """The query of a form's data set, array<struct<name,value,type>>: name=value joined by &, a null value as name=.

    A hidden _charset_ entry gives UTF-8; a first entry that is a text field named isindex gives its bare value.
    """

    def said(e: Column) -> Column:
        value = F.when((e["name"] == "_charset_") & (e["type"] == "hidden"), F.lit("UTF-8")).otherwise(e["value"])
        return F.concat(encode_value(e["name"]), F.lit("="), F.coalesce(encode_value(value), F.lit("")))

    first = F.try_element_at(data, F.lit(1))
    bare = (first["name"] == "isindex") & (first["type"] == "text")
    rest = F.array_join(F.transform(F.slice(data, 2, F.greatest(F.size(data) - 1, F.lit(0))), lambda e: F.concat(F.lit("&"), said(e))), "")
    return F.when(F.size(data) == 0, F.lit("")).otherwise(
        F.concat(F.when(F.coalesce(bare, F.lit(False)), F.coalesce(encode_value(first["value"]), F.lit(""))).otherwise(said(first)), rest)
    )


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    """A relative URL against its document's; null where it can't be."""

    def of(b, r):
        if r is None:
            return None
        try:
            return urljoin(b or "", r.strip()) or None
        except ValueError:
            return None

    return pd.Series([of(b, r) for b, r in zip(base, relative)], dtype="object")


def url_part(url: Column, part: str) -> Column:
    """PROTOCOL, HOST, PATH, QUERY or REF of a URL; null if it has none or is malformed."""
    return F.try_parse_url(url, F.lit(part))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url_part(url, "PROTOCOL")).isin("http", "https"), F.lit(False))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(url_part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")


def append_segment(base: Column, segment: Column) -> Column:
    """base/segment, without doubling a slash."""
    return F.concat_ws("/", F.regexp_replace(base, "/$", ""), encode_value(segment))


def base_10(value: Column, otherwise: int = 0) -> Column:
    """Leading digits as a number."""
    return F.coalesce(F.regexp_extract(value, r"^[0-9]{1,18}", 0).try_cast("long"), F.lit(otherwise))


def base_16(value: Column) -> Column:
    return F.when(value.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(value, 16, 10).cast("long"))

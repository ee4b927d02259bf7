"""JSON texts: strict roots, first duplicate wins, nulls written."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first_wins(pairs):
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def _refuse(x):
    raise ValueError(x)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The text without spaces, of repeated names the first kept; null if it isn't an RFC 4627 text, whose root is an array or
    object. What comes out is safe for parse_json and from_json, which treat repeated names otherwise."""

    def of(t):
        try:
            v = json.loads(t, object_pairs_hook=_first_wins, parse_constant=_refuse)
        except (ValueError, TypeError, RecursionError):
            return None
        return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (dict, list)) else None

    return texts.map(of)


def write_json(value: Column) -> Column:
    """As JSON, nulls included."""
    return F.to_json(value, {"ignoreNullFields": "false"})

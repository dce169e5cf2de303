"""JSON text of any value."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.binding import transformation
from tributary.types import as_type, try_to

#: Fixed forms that count as nothing.
EMPTY = ['{"v":null}', '{"v":""}', '{"v":0}', '{"v":0.0}', '{"v":-0.0}', '{"v":false}', '{"v":[]}', '{"v":{}}', "{}"]


@F.pandas_udf(T.StringType())
def _python_style(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    def one(text, kind):
        if text is None:
            return None
        value = json.loads(text)["v"]
        if kind.startswith(("struct", "array<struct")):
            return json.dumps(value)
        return str(datetime.fromisoformat(value).replace(tzinfo=None) if kind.startswith("timestamp") else value)

    return pd.Series([one(*pair) for pair in zip(texts, kinds)], dtype=object)


@transformation
def to_json_string(value: Column, cast="string", python_style=False) -> Column:
    """JSON text of objects and arrays with NULL fields kept; texts as they are; nothing (NULL, empty, 0, false) is NULL.

    ``python_style`` writes objects and lists of objects like Python's json module and all else (lists, maps, times) like
    Python's ``str``, by an Arrow UDF; the default is built in.
    """
    framed = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    filled = F.when(~framed.isin(EMPTY), framed)
    text = _python_style(filled, F.typeof(value)) if python_style else F.get_json_object(filled, "$.v")
    return try_to(text, as_type(cast))

"""Looking paths up in a schema, without asking the engine to analyse anything."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_PART = re.compile(r"`((?:[^`]|``)+)`|([^.`]+)")


@dataclass(frozen=True)
class Found:
    """``kind`` is NULL unless the path names exactly one column or field."""

    kind: T.DataType | None
    ambiguous: bool = False


def split_path(path: str) -> list[str]:
    return [(quoted or "").replace("``", "`") or bare for quoted, bare in _PART.findall(path)]


def case_sensitive(df: DataFrame) -> bool:
    return str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"


def _field(kind: T.DataType, name: str, exact: bool) -> Found:
    if isinstance(kind, T.ArrayType):
        inner = _field(kind.elementType, name, exact)
        return Found(T.ArrayType(inner.kind), False) if inner.kind is not None else inner
    if isinstance(kind, T.MapType):
        return Found(kind.valueType)
    if not isinstance(kind, T.StructType):
        return Found(None)
    same = [f for f in kind.fields if f.name == name or (not exact and f.name.lower() == name.lower())]
    return Found(same[0].dataType) if len(same) == 1 else Found(None, len(same) > 1)


def lookup(df: DataFrame, path: str) -> Found:
    """The type at a dotted path; through an array of objects it is an array of the field's type."""
    exact, found = case_sensitive(df), Found(df.schema)
    for part in split_path(path):
        found = _field(found.kind, part, exact)
        if found.kind is None:
            return found
    return found

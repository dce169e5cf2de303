"""One reading of type names: objects, classes, DDL text and class names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_CLASS_NAME = re.compile(r"^(\w+Type)(\(\))?$")


def as_type(kind) -> T.DataType:
    """``kind`` as a type object; ``"int"``, ``"IntegerType"``, ``"IntegerType()"``, ``"null"`` and types all do."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, type) and issubclass(kind, T.DataType):
        return kind()
    if not isinstance(kind, str):
        raise TypeError(f"not a type: {kind!r}")
    text = kind.strip()
    if text.lower() in ("null", "void"):
        return T.NullType()
    named = _CLASS_NAME.match(text)
    if named and isinstance(getattr(T, named[1], None), type):
        try:
            return getattr(T, named[1])()
        except TypeError as e:
            raise TypeError(f"{text} needs parameters; write it as DDL, e.g. array<string>") from e
    return T.DataType.fromDDL(text)


def is_type(kind) -> bool:
    try:
        as_type(kind)
    except Exception:  # the DDL parser raises engine errors of several kinds
        return False
    return True


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGRAL)


def try_to(column: Column, kind) -> Column:
    """Cast that gives NULL where the value has no such form."""
    return column.try_cast(as_type(kind))

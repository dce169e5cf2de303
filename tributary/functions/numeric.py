"""Numbers out of text with blanks, underscores and fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.binding import transformation
from tributary.types import as_type, is_integral, try_to

_WHOLE = r"^[+-]?[0-9]+$"


def number(value: Column, kind: T.DataType) -> Column:
    """Whole numbers stay exact; fractions go through double and are rounded half up for integer types."""
    text = F.regexp_replace(F.trim(value.cast("string")), "_", "")
    if is_integral(kind):
        rounded = try_to(F.round(try_to(text, "double"), 0), kind)
        return F.when(text.rlike(_WHOLE), try_to(text, kind)).otherwise(rounded)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return try_to(try_to(text, "double"), kind)
    return try_to(text, kind)


@transformation
def to_num(value: Column, cast="bigint") -> Column:
    """A number of type ``cast``; blanks around it and underscores within are ignored, commas are not."""
    return number(value, as_type(cast))


def _fixed(kind: str, label: str):
    def core(value: Column, cast=None) -> Column:
        return number(value, as_type(kind))

    core.__name__ = core.__qualname__ = label
    core.__doc__ = f"As ``to_num`` with type {kind}; another ``cast`` is ignored."
    return transformation(core)


to_int, to_long = _fixed("int", "to_int"), _fixed("bigint", "to_long")
to_float, to_double = _fixed("float", "to_float"), _fixed("double", "to_double")


@transformation
def meters_to_cm(value: Column, cast="int") -> Column:
    """A hundred times the number, rounded half up for integer types."""
    kind = as_type(cast)
    scaled = try_to(value.cast("string"), "double") * 100
    return try_to(F.round(scaled, 0) if is_integral(kind) else scaled, kind)

"""Renaming, plain text, and user functions."""

from __future__ import annotations

from pyspark.sql import Column

from tributary.functions.binding import transformation
from tributary.types import as_type, try_to


@transformation
def as_is(value: Column, cast=False) -> Column:
    """The value unchanged, or cast."""
    return try_to(value, as_type(cast)) if cast else value


@transformation
def to_str(value: Column, cast=None) -> Column:
    """The value as text, blanks kept."""
    return try_to(value, "string")


@transformation
def apply(value: Column, *, func, cast=False) -> Column:
    """``func(column)``, a function from column to column, then cast."""
    result = func(value)
    return try_to(result, as_type(cast)) if cast else result

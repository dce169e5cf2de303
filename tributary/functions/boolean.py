"""Truth values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.binding import transformation
from tributary.types import as_type, try_to

#: Fixed words that count beside the engine's own (t, true, y, yes, 1 and their opposites).
TRUE_WORDS, FALSE_WORDS = ("on", "enabled"), ("off", "disabled")


@transformation
def to_bool(value: Column, true_values=(), false_values=(), case_sensitive=False, replace_default_values=False, cast="boolean") -> Column:
    """True or false by word lists, then by the engine's literals; anything else is NULL.

    Own words extend the fixed ones unless ``replace_default_values``; blanks around a value do not matter.
    """
    text = F.trim(value.cast("string"))
    fold = (lambda w: str(w)) if case_sensitive else (lambda w: str(w).lower())
    yes = [fold(w) for w in (*(() if replace_default_values and true_values else TRUE_WORDS), *(true_values or ()))]
    no = [fold(w) for w in (*(() if replace_default_values and false_values else FALSE_WORDS), *(false_values or ()))]
    seen = text if case_sensitive else F.lower(text)
    truth = F.when(seen.isin(yes), F.lit(True)).when(seen.isin(no), F.lit(False)).otherwise(try_to(text, "boolean"))
    return try_to(truth, as_type(cast))


@transformation
def has_value(value: Column, cast="boolean") -> Column:
    """Whether there is anything but NULL or empty text; 0, false and blanks are values."""
    return try_to(value.isNotNull() & (F.coalesce(value.cast("string"), F.lit("x")) != ""), as_type(cast))

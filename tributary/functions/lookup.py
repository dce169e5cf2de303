"""Replacing values by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.binding import transformation
from tributary.types import as_type, try_to

SOURCE = "source_column"


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@transformation
def map_values(value: Column, mapping=None, default=SOURCE, ignore_case=True, pattern_type="equals", cast="string") -> Column:
    """The value of the first key that matches the source's text, else ``default`` (the source itself).

    Keys are texts to equal, SQL patterns (``sql_like``) or regular expressions to be found (``regex``); case
    matters only to the last, or without ``ignore_case``. NULL matches nothing. Every result is cast.
    """
    if not mapping:
        raise ValueError("map_values needs a mapping with at least one entry")
    if pattern_type not in ("equals", "sql_like", "regex"):
        raise ValueError(f"pattern_type is equals, sql_like or regex, not {pattern_type!r}")
    kind, text = as_type(cast), value.cast("string")
    folded = ignore_case and pattern_type != "regex"
    seen = F.lower(text) if folded else text
    rules = None
    for key, result in mapping.items():
        if isinstance(key, Column):
            pattern = F.lower(key.cast("string")) if folded else key.cast("string")
        else:
            pattern = str(key).lower() if folded else str(key)
        if pattern_type == "equals":
            hit = seen == pattern
        elif pattern_type == "sql_like":
            hit = F.like(seen, _value(pattern))
        else:
            hit = F.rlike(seen, _value(pattern))
        result = try_to(_value(result), kind)
        rules = F.when(hit, result) if rules is None else rules.when(hit, result)
    other = value if isinstance(default, str) and default == SOURCE else _value(default)
    return rules.otherwise(try_to(other, kind))

"""Arrays out of delimited text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.binding import transformation
from tributary.types import as_type, is_integral, try_to


@transformation
def str_to_array(value: Column, sep=",", cast="string", regex_sep=False) -> Column:
    """Items between the outer brackets (which may be missing), without blanks around them.

    ``sep`` is taken literally unless ``regex_sep``. Items that do not fit ``cast`` are NULL; integer types
    round fractions half up. Inner brackets stay.
    """
    kind = as_type(cast)
    inner = F.regexp_replace(value.cast("string"), r"^\s*\[*\s*|\s*\]*\s*$", "")
    items = F.split(inner, rf"\s*{sep if regex_sep else re.escape(sep)}\s*")
    if is_integral(kind):
        exact = lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), try_to(x, kind))
        items = F.transform(items, lambda x: exact(x).otherwise(try_to(F.round(try_to(x, "double"), 0), kind)))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        items = F.transform(items, lambda x: try_to(x, "double"))
    return F.transform(items, lambda x: try_to(x, kind))

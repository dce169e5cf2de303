"""Deferred column functions: configured once, bound to a source column any number of times.

A function called without a source gives an ``Expr``, an immutable value that a mapping can hold and reuse;
called with a source it gives the finished ``Column``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATH = re.compile(r"^Column<'([\w.`]+)'>$")
_ALIAS = re.compile(r"^Column<'.* AS `?(\w+)`?'>$", re.S)


def column_of(source: str | Column) -> Column:
    return F.col(source) if isinstance(source, str) else source


def name_of(source: str | Column) -> str | None:
    """Last part of a path, or an alias; NULL for other expressions, which Spark names itself."""
    if isinstance(source, str):
        return source.split(".")[-1].strip("`")
    text = repr(source)
    found = _ALIAS.match(text) or _PATH.match(text)
    return found[1].split(".")[-1].strip("`") if found else None


@dataclass(frozen=True)
class Expr:
    core: Callable[..., Column]
    name: str | None = None
    alternatives: tuple = ()
    options: dict[str, Any] = field(default_factory=dict)

    def on(self, source: str | Column, name: str | None = None) -> Column:
        """The function over ``source`` (or the first alternative with a value), under its output name."""
        value = column_of(source)
        if self.alternatives:
            value = F.coalesce(value, *[column_of(a) for a in self.alternatives])
        result = self.core(value, **self.options)
        label = name or self.name or name_of(source)
        return result.alias(label) if label else result


def _listed(alternatives) -> tuple:
    if alternatives is None or alternatives is False:
        return ()
    return tuple(alternatives) if isinstance(alternatives, (list, tuple, set)) else (alternatives,)


def transformation(core: Callable[..., Column]) -> Callable[..., Expr | Column]:
    """Make a public function of ``core(value, **options)``."""

    @wraps(core)
    def function(source_column: str | Column | None = None, name: str | None = None, *, alt_src_cols=None, **options):
        expr = Expr(core, name, _listed(alt_src_cols), options)
        return expr if source_column is None else expr.on(source_column)

    function.is_transformation = True
    return function


def as_expr(target) -> Expr | None:
    """``target`` as an ``Expr`` if it is one or a bare function, else NULL."""
    if isinstance(target, Expr):
        return target
    return target() if getattr(target, "is_transformation", False) else None

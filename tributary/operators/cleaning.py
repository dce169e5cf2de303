"""Rules that replace values, with a column that records what was replaced.

All rules and the record are one projection over the input row, so a plan does not grow with the number of
rules. With ``sequential`` a rule's default or bound may refer to a column cleaned by an earlier rule.
Steps are stateless and run on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.base import Transformer
from tributary.types import try_to

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _fit(value, kind: T.DataType) -> Column:
    """A default in the type of the column it goes into; NULL if it has no such form."""
    return try_to(value if isinstance(value, Column) else F.lit(value), kind)


class Cleaner(Transformer):
    """Base: subclasses turn a column and its rule into the cleaned column."""

    def __init__(self, cleaning_definitions: dict | None = None, column_to_log_cleansed_values: str | None = None, store_as_map: bool = False, sequential: bool = False):
        self.cleaning_definitions = {c: dict(r) for c, r in (cleaning_definitions or {}).items()}
        self.column_to_log_cleansed_values = column_to_log_cleansed_values
        self.store_as_map, self.sequential = store_as_map, sequential
        self._validate()

    def _validate(self) -> None:
        """Check the rules as far as possible without a table."""

    def _clean(self, column: Column, kind: T.DataType, name: str, rule: dict) -> Column:
        raise NotImplementedError

    def transform(self, input_df: DataFrame) -> DataFrame:
        rules, log = self.cleaning_definitions, self.column_to_log_cleansed_values
        kinds = {f.name: f.dataType for f in input_df.schema.fields}
        unknown = [c for c in rules if c not in kinds]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        if log and any(c.lower() == log.lower() for c in kinds):
            raise ValueError(f"the column {log} exists already; log every cleaner to a column of its own")
        if self.sequential:
            return self._one_after_the_other(input_df, kinds)
        cleaned = {c: self._clean(F.col(f"`{c}`"), kinds[c], c, r) for c, r in rules.items()}
        columns = [cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in input_df.columns]
        if log:
            columns.append(self._record({c: (F.col(f"`{c}`"), new) for c, new in cleaned.items()}).alias(log))
        return input_df.select(*columns)

    def _one_after_the_other(self, df: DataFrame, kinds: dict) -> DataFrame:
        names, log = df.columns, self.column_to_log_cleansed_values
        old = {c: f"__old_{i}" for i, c in enumerate(self.cleaning_definitions)}
        out = df.select("*", *[F.col(f"`{c}`").alias(o) for c, o in old.items()])
        for c, rule in self.cleaning_definitions.items():
            out = out.withColumn(c, self._clean(F.col(f"`{c}`"), kinds[c], c, rule))
        record = [self._record({c: (F.col(o), F.col(f"`{c}`")) for c, o in old.items()}).alias(log)] if log else []
        return out.select(*[F.col(f"`{c}`") for c in names], *record)

    def _record(self, pairs: dict[str, tuple[Column, Column]]) -> Column:
        """Replaced values as text by column: an object with all rules' columns, or a map of the replaced ones."""
        texts = {
            c: F.when(~new.eqNullSafe(old), F.coalesce(old.cast("string"), F.lit("null"))) for c, (old, new) in pairs.items()
        }
        if not self.store_as_map:
            return F.struct(*[t.alias(c) for c, t in texts.items()]) if texts else F.lit(None).cast("string")
        none, empty = F.lit(None).cast("map<string,string>"), F.create_map().cast("map<string,string>")
        if not texts:
            return none
        # joined from one map per rule rather than filtered, as lambdas end whole-stage code generation
        maps = [F.when(t.isNotNull(), F.create_map(F.lit(c), t)).otherwise(empty) for c, t in texts.items()]
        full = F.map_concat(*maps) if len(maps) > 1 else maps[0]
        return F.when(F.coalesce(*texts.values()).isNotNull(), full).otherwise(none)


class EnumCleaner(Cleaner):
    """Values outside (mode ``allow``) or inside (``disallow``) a list become ``default``; NULL stays NULL.

    Rules: ``{column: {"elements": [...], "mode": ..., "default": ...}}``.
    """

    def _validate(self) -> None:
        for name, rule in self.cleaning_definitions.items():
            if not rule.get("elements"):
                raise ValueError(f"{name}: a list of elements is needed")
            if "mode" not in rule:
                raise RuntimeError(f"Please provide a `mode` attribute! ({name}: allow or disallow)")
            if rule["mode"] not in ("allow", "disallow"):
                raise ValueError(f"{name}: mode is allow or disallow, not {rule['mode']!r}")

    def _clean(self, column: Column, kind: T.DataType, name: str, rule: dict) -> Column:
        listed = [_fit(e, kind) for e in rule["elements"] if e is not None]
        inside = F.coalesce(column.isin(*listed), F.lit(False)) if listed else F.lit(False)
        replaced = ~inside if rule["mode"] == "allow" else inside
        return F.when(column.isNotNull() & replaced, _fit(rule.get("default"), kind)).otherwise(column)


class ThresholdCleaner(Cleaner):
    """Numbers, dates and timestamps not within ``min`` and ``max`` (both included), NULL too, become ``default``.

    Rules: ``{column: {"min": ..., "max": ..., "default": ...}}`` with literals or columns.
    """

    def __init__(self, thresholds: dict | None = None, column_to_log_cleansed_values: str | None = None, store_as_map: bool = False, sequential: bool = False):
        super().__init__(thresholds, column_to_log_cleansed_values, store_as_map, sequential)

    def _validate(self) -> None:
        for name, rule in self.cleaning_definitions.items():
            if rule.get("min") is None or rule.get("max") is None:
                raise ValueError(f"{name}: min and max are needed")

    def _clean(self, column: Column, kind: T.DataType, name: str, rule: dict) -> Column:
        if not isinstance(kind, (T.NumericType, *_TEMPORAL)):
            raise ValueError(f"{name}: thresholds need a number, date or timestamp, not {kind.simpleString()}")

        def bound(x):
            if isinstance(kind, _TEMPORAL) or isinstance(x, str):
                return _fit(x, kind)
            return x if isinstance(x, Column) else F.lit(x)

        return F.when(column.between(bound(rule["min"]), bound(rule["max"])), column).otherwise(_fit(rule.get("default"), kind))


class NullCleaner(Cleaner):
    """NULL becomes ``default``; empty text stays. Rules: ``{column: {"default": ...}}``."""

    def _validate(self) -> None:
        for name, rule in self.cleaning_definitions.items():
            if rule.get("default") is None:
                raise ValueError(f"{name}: a default other than NULL is needed")

    def _clean(self, column: Column, kind: T.DataType, name: str, rule: dict) -> Column:
        return F.coalesce(column, _fit(rule["default"], kind))

"""The contract of steps: configuration in the constructor, data in one method."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.component import Component


class Transformer(Component):
    """A lazy, side-effect-free step from table to table; usable with ``df.transform(step)``."""

    kind = "Transformer"

    def transform(self, input_df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} must implement transform(input_df)")

    def __call__(self, input_df: DataFrame) -> DataFrame:
        return self.transform(input_df)


def fresh_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` is called so in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem

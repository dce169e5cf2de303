"""The contracts of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.component import Component


class Extractor(Component):
    """A source: ``extract()`` gives a lazy table."""

    kind = "Extractor"

    def extract(self) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} must implement extract()")


class Loader(Component):
    """A sink: ``load(df)`` writes a table and returns nothing."""

    kind = "Loader"

    def load(self, input_df: DataFrame) -> None:
        raise NotImplementedError(f"{type(self).__name__} must implement load(input_df)")

"""A source, steps and a sink, run in this order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


class Pipeline:
    """``input_df`` stands in for a source; ``bypass_loader`` returns the result instead of loading it.

    A step is anything with ``transform(df)`` or a function from table to table. Steps are lazy: only the sink
    (or the caller) starts a job. A source that keeps a log of what it has read (it has ``commit()``) writes it after the
    sink has stored the rows; without a sink it does as it does by itself.
    """

    def __init__(self, input_df: DataFrame | None = None, bypass_loader: bool = False):
        self.input_df, self.bypass_loader = input_df, bypass_loader
        self.extractor = self.loader = None
        self.transformers: list = []

    def set_extractor(self, extractor) -> Pipeline:
        assert self.input_df is None, "a pipeline with an input_df takes no extractor"
        self.extractor = extractor
        return self

    def set_loader(self, loader) -> Pipeline:
        assert not self.bypass_loader, "a pipeline that bypasses its loader takes none"
        self.loader = loader
        return self

    def add_transformers(self, transformers) -> Pipeline:
        self.transformers += list(transformers) if isinstance(transformers, (list, tuple)) else [transformers]
        return self

    def clear_transformers(self) -> Pipeline:
        self.transformers = []
        return self

    def extract(self) -> DataFrame:
        if self.input_df is not None:
            return self.input_df
        assert self.extractor is not None, "set an extractor or an input_df first"
        return self.extractor.extract()

    def transform(self, input_df: DataFrame) -> DataFrame:
        return reduce(lambda df, step: df.transform(getattr(step, "transform", step)), self.transformers, input_df)

    def load(self, input_df: DataFrame) -> DataFrame | None:
        if self.bypass_loader:
            return input_df
        assert self.loader is not None, "set a loader or bypass it"
        return self.loader.load(input_df)

    def execute(self) -> DataFrame | None:
        if self.bypass_loader or not hasattr(self.extractor, "commit"):
            return self.load(self.transform(self.extract()))
        done = self.load(self.transform(self.extractor.extract(commit=False)))
        self.extractor.commit()
        return done

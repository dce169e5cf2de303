"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.operators.base import Transformer


class Sieve(Transformer):
    """Keep the rows for which an SQL expression is true; NULL drops the row."""

    def __init__(self, filter_expression: str):
        if not isinstance(filter_expression, str):
            raise ValueError("filter_expression has to be an SQL expression as a string")
        self.filter_expression = filter_expression

    def transform(self, input_df: DataFrame) -> DataFrame:
        return input_df.where(self.filter_expression)


class NoIdDropper(Transformer):
    """Drop the rows in which all of ``id_columns`` are NULL."""

    def __init__(self, id_columns: str | list[str] = "id"):
        self.id_columns = [id_columns] if isinstance(id_columns, str) else list(id_columns)

    def transform(self, input_df: DataFrame) -> DataFrame:
        return input_df.na.drop(how="all", subset=self.id_columns)

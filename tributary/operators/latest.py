"""The newest row of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.base import Transformer, fresh_name


class NewestByGroup(Transformer):
    """One row per ``group_by``: the first by ``order_by``, all descending with NULLs last.

    A NULL key is a group. Ties are arbitrary unless ``tie_break`` columns (ascending, NULLs last) settle
    them. The plan limits each group before the shuffle, so a hot group moves one row per task. Streams are
    refused: a newest row is never final there.
    """

    def __init__(self, group_by: str | list[str] = "id", order_by: str | list[str] = ("updated_at", "deleted_at"), tie_break: str | list[str] = ()):
        listed = lambda x: [x] if isinstance(x, str) else list(x)
        self.group_by, self.order_by, self.tie_break = listed(group_by), listed(order_by), listed(tie_break)

    def transform(self, input_df: DataFrame) -> DataFrame:
        if input_df.isStreaming:
            raise ValueError("the newest row per group needs a finished table; use it in foreachBatch")
        order = [F.col(c).desc_nulls_last() for c in self.order_by] + [F.col(c).asc_nulls_last() for c in self.tie_break]
        rank = fresh_name(input_df, "__rank")
        window = Window.partitionBy(*[F.col(c) for c in self.group_by]).orderBy(*order)
        return input_df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)

"""One row per array element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators.base import Transformer
from tributary.operators.schema import lookup


class Exploder(Transformer):
    """Each element of ``path_to_array`` in a row of its own, as ``exploded_elem_name``.

    A top-level array column is replaced; a nested array stays where it is. Rows with an empty or NULL array
    are dropped, or kept with a NULL element if ``drop_rows_with_empty_array`` is false. Entries of a map
    become objects with ``key`` and ``value``. A column already called like the element is replaced.
    """

    def __init__(self, path_to_array: str = "included", exploded_elem_name: str = "elem", drop_rows_with_empty_array: bool = True):
        self.path_to_array = path_to_array
        self.exploded_elem_name = exploded_elem_name
        self.drop_rows_with_empty_array = drop_rows_with_empty_array

    def transform(self, input_df: DataFrame) -> DataFrame:
        values = F.col(self.path_to_array)
        found = lookup(input_df, self.path_to_array)
        if found.kind is not None and isinstance(found.kind, T.MapType):
            values = F.map_entries(values)
        dropped = {self.path_to_array, self.exploded_elem_name}
        kept = [F.col(f"`{c}`") for c in input_df.columns if c not in dropped]
        generator = F.explode if self.drop_rows_with_empty_array else F.explode_outer
        return input_df.select(*kept, generator(values).alias(self.exploded_elem_name))

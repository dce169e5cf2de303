"""Column comments."""

from __future__ import annotations

import logging
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.errors import ColumnNotFound
from tributary.operators.base import Transformer

logger = logging.getLogger("tributary")


class AnnotatorMode(Enum):
    insert = "insert"
    upsert = "upsert"


class MissingColumn(Enum):
    raise_error = "raise_error"
    skip = "skip"


def load_comments(table: str, spark: SparkSession | None = None) -> dict[str, str]:
    """Non-empty comments of a catalog table, or of a path like ``parquet.`/folder` ``, by column."""
    session = spark or SparkSession.active()
    fields = session.table(table).schema.fields if "`/" not in table else session.sql(f"SELECT * FROM {table} LIMIT 0").schema.fields
    return {f.name: f.metadata["comment"] for f in fields if f.metadata.get("comment")}


def _with_comments(df: DataFrame, comments: dict[str, str | None]) -> DataFrame:
    """All comments in one projection; other metadata of the columns stays."""
    if not comments:
        return df
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        columns.append(column.alias(f.name, metadata={**f.metadata, "comment": comments[f.name]}) if f.name in comments else column)
    return df.select(*columns)


def _wanted(df: DataFrame, comments: dict, mode: AnnotatorMode, missing: MissingColumn) -> dict:
    present = {f.name: f.metadata.get("comment") for f in df.schema.fields}
    unknown = [c for c in comments if c not in present]
    if unknown and missing is MissingColumn.raise_error:
        raise ColumnNotFound(f"no such columns: {', '.join(unknown)}; there are {', '.join(present)}")
    for c in unknown:
        logger.warning("no comment set: column %s does not exist", c)
    return {c: text for c, text in comments.items() if c in present and (mode is AnnotatorMode.upsert or not present[c])}


def update_comment(df: DataFrame, column_name: str, comment: str | None, annotator_mode: AnnotatorMode = AnnotatorMode.upsert, missing_column_handling: MissingColumn = MissingColumn.raise_error) -> DataFrame:
    """Set one comment; mode ``insert`` leaves an existing non-empty one."""
    return _with_comments(df, _wanted(df, {column_name: comment}, annotator_mode, missing_column_handling))


class Annotator(Transformer):
    """Set the comments of ``comments_mapping``, joined with those of an existing table.

    In mode ``upsert`` the mapping wins over the table's comments, in mode ``insert`` the table wins, and
    comments that columns already have stay. Comments of table columns the input lacks are ignored.
    """

    def __init__(self, comments_mapping: dict | None = None, mode: AnnotatorMode = AnnotatorMode.upsert, missing_column_handling: MissingColumn = MissingColumn.raise_error, sql_source_table_identifier: str | None = None):
        self.comments_mapping = dict(comments_mapping or {})
        self.mode, self.missing_column_handling = mode, missing_column_handling
        self.sql_source_table_identifier = sql_source_table_identifier

    def transform(self, input_df: DataFrame) -> DataFrame:
        comments = dict(self.comments_mapping)
        if self.sql_source_table_identifier:
            stored = load_comments(self.sql_source_table_identifier, input_df.sparkSession)
            stored = {c: text for c, text in stored.items() if c in input_df.columns}
            comments = {**stored, **comments} if self.mode is AnnotatorMode.upsert else {**comments, **stored}
        return _with_comments(input_df, _wanted(input_df, comments, self.mode, self.missing_column_handling))

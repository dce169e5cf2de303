"""Relational sources over JDBC: whole queries, and loads bounded by a log of earlier loads."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.base import Extractor

REQUIRED = ("url", "driver", "user", "password")


def check_options(options: dict) -> None:
    """Assert that all connection options are there, as texts."""
    for key in REQUIRED:
        assert key in options, f"{key} is missing from the jdbc_options."
        assert isinstance(options[key], str), f"{key} has to be provided as a string object."


def read_query(options: dict, query: str) -> DataFrame:
    """A lazy table of ``query``. ``partitionColumn`` and bounds among the options make it a parallel read."""
    reader = SparkSession.active().read.format("jdbc")
    return reader.options(**{**options, "dbtable": f"({query}) as table_statement"}).load()


def in_parts(options: dict, query: str, column: str | None, parts: int | None, reader: Callable[[dict, str], DataFrame]) -> dict:
    """``options`` by which ``query`` is read in ``parts`` over the range of ``column`` (a number, date or timestamp).

    The database is asked for the range first; rows beyond it, and NULLs, belong to the outer parts, so nothing is left out.
    """
    if not column or not parts or parts < 2:
        return options
    low, high = reader(options, f"select min({column}) as low_end, max({column}) as high_end from ({query}) asked").first()
    if low is None or low == high:
        return options
    return {**options, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


class JDBCExtractorFullLoad(Extractor):
    """The rows of a query. ``reader(options, query)`` stands in for the database in tests.

    With ``partition_column`` and ``num_partitions`` the query is read in parallel, else by one task.
    """

    def __init__(
        self, query: str, jdbc_options: dict, cache: bool = True, reader: Callable[[dict, str], DataFrame] = read_query,
        partition_column: str | None = None, num_partitions: int | None = None,
    ):
        check_options(jdbc_options)
        self.query, self.jdbc_options, self.cache, self.reader = " ".join(query.split()).rstrip(";"), dict(jdbc_options), cache, reader
        self.partition_column, self.num_partitions = partition_column, num_partitions

    def extract(self) -> DataFrame:
        df = self.reader(in_parts(self.jdbc_options, self.query, self.partition_column, self.num_partitions, self.reader), self.query)
        return df.cache() if self.cache else df


@dataclass(frozen=True)
class Bounds:
    """An interval of the boundary column; an absent end is NULL. ``lower`` is excluded unless told otherwise."""

    lower: object = None
    upper: object = None
    lower_included: bool = False


def decide_bounds(partition: int, own: tuple | None, preceding_last, succeeding_first, has_preceding: bool, has_succeeding: bool, exact_reload: bool = False) -> Bounds:
    """What to load for a partition, from its own log entry or its neighbours' (see ``BoundsLog.bounds``)."""
    if own is not None:
        return Bounds(own[0], own[1], exact_reload)
    return Bounds(preceding_last if has_preceding else None, succeeding_first if has_succeeding else None)


def _literal(value) -> str:
    text = str(value)
    try:
        int(text)
    except ValueError:
        return "'" + text.replace("'", "''") + "'"
    return text


def bounded_query(table: str, column: str, bounds: Bounds) -> str:
    """``select`` with a lower bound (excluded) and an upper bound (included), where there are any."""
    tests = []
    if bounds.lower is not None:
        tests.append(f"{column} {'>=' if bounds.lower_included else '>'} {_literal(bounds.lower)}")
    if bounds.upper is not None:
        tests.append(f"{column} <= {_literal(bounds.upper)}")
    return f"select * from {table}" + (f" where {' and '.join(tests)}" if tests else "")


def observed_bounds(df: DataFrame, column: str) -> tuple:
    """Least and greatest value, NULLs aside, in one pass."""
    row = df.agg(F.min(F.col(column)).alias("a"), F.max(F.col(column)).alias("b")).first()
    return row["a"], row["b"]


class BoundsLog:
    """The log table ``partition_column, dt, first_value, last_value`` of earlier loads."""

    SCHEMA = "partition_column string, dt int, first_value string, last_value string"

    def __init__(self, table: str, partition_column: str | None = None):
        self.table, self.partition_column = table, partition_column

    def read(self) -> DataFrame:
        df = SparkSession.active().table(self.table)
        if self.partition_column is None:
            row = df.select("partition_column").limit(1).first()
            self.partition_column = row[0] if row else None
        return df.where(F.col("partition_column").eqNullSafe(F.lit(self.partition_column)))

    def bounds(self, partition: int, exact_reload: bool = False) -> Bounds:
        """Own entry first; else from the last value of the nearest older to the first of the nearest newer load."""
        p, dt = int(partition), F.col("dt")
        pair = F.struct("first_value", "last_value")
        row = self.read().agg(
            F.max(F.when(dt == p, pair)).alias("own"), F.max_by("last_value", F.when(dt < p, dt)).alias("before"),
            F.min_by("first_value", F.when(dt > p, dt)).alias("after"), F.max(F.when(dt < p, dt)).alias("older"), F.min(F.when(dt > p, dt)).alias("newer"),
        ).first()
        own = tuple(row["own"]) if row["own"] is not None else None
        return decide_bounds(p, own, row["before"], row["after"], row["older"] is not None, row["newer"] is not None, exact_reload)

    def write(self, partition: int, first_value, last_value) -> None:
        """Replace the entry of ``partition``; a load without values leaves no entry."""
        if first_value is None and last_value is None:
            return
        spark = SparkSession.active()
        row = spark.createDataFrame([(self.partition_column, int(partition), str(first_value), str(last_value))], self.SCHEMA)
        if not spark.catalog.tableExists(self.table):
            row.write.partitionBy("partition_column", "dt").saveAsTable(self.table)
            return
        keyed = {c.name for c in spark.catalog.listColumns(self.table) if c.isPartition}
        if "dt" not in keyed:
            raise ValueError(f"{self.table} has to be partitioned by dt, so that one entry can be replaced")
        rows = row
        if "partition_column" not in keyed:  # the other columns' entries of that day share the partition
            other = ~F.col("partition_column").eqNullSafe(F.lit(self.partition_column))
            kept = spark.table(self.table).where((F.col("dt") == int(partition)) & other)
            entries = [tuple(r) for r in kept.select("partition_column", "dt", "first_value", "last_value").collect()]
            rows = row.unionByName(spark.createDataFrame(entries, self.SCHEMA))
        literals = {"dt": str(int(partition)), "partition_column": _quoted(self.partition_column)}
        spec = ", ".join(f"{c} = {v}" for c, v in literals.items() if c in keyed)
        view = f"bounds_{uuid.uuid4().hex}"
        rows.select(*[c for c in spark.table(self.table).columns if c not in keyed]).createOrReplaceTempView(view)
        try:
            spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION ({spec}) SELECT * FROM {view}")
        finally:
            spark.catalog.dropTempView(view)


def _quoted(text) -> str:
    return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


class JDBCExtractorIncremental(Extractor):
    """Rows of ``source_table`` within bounds from the log; the bounds of what was read are logged.

    A ``Pipeline`` with a sink logs after the sink has stored the rows, so that a failed load is read again. By itself
    ``extract()`` logs at once, as callers of older tools expect; with ``commit_on_extract=False`` call ``commit()``
    once the rows are stored. The bounds are observed before the rows are handed on, and rows that arrive later with
    greater values are left to the next load. ``num_partitions`` reads in parallel over the boundary column.
    """

    def __init__(
        self, partition: int | str, jdbc_options: dict, source_table: str, values_table: str, values_db: str | None = None,
        values_partition_column: str | None = "updated_at", cache: bool = True, exact_reload: bool = False, commit_on_extract: bool = True,
        reader: Callable[[dict, str], DataFrame] = read_query, num_partitions: int | None = None,
    ):
        check_options(jdbc_options)
        self.partition, self.jdbc_options, self.source_table = int(partition), dict(jdbc_options), source_table
        self.log = BoundsLog(f"{values_db}.{values_table}" if values_db else values_table, values_partition_column)
        self.cache, self.exact_reload, self.commit_on_extract, self.reader = cache, exact_reload, commit_on_extract, reader
        self.num_partitions = num_partitions
        self._observed: tuple | None = None

    def query(self) -> str:
        bounds = self.log.bounds(self.partition, self.exact_reload)
        return bounded_query(self.source_table, self.log.partition_column, bounds)

    def extract(self, commit: bool | None = None) -> DataFrame:
        query = self.query()
        column = self.log.partition_column
        df = self.reader(in_parts(self.jdbc_options, query, column, self.num_partitions, self.reader), query)
        df = df.cache() if self.cache else df
        self._observed = observed_bounds(df, column)
        if not self.cache and self._observed[1] is not None:
            df = df.where((F.col(column) <= F.lit(self._observed[1])) | F.col(column).isNull())
        if self.commit_on_extract if commit is None else commit:
            self.commit()
        return df

    def commit(self) -> None:
        if self._observed is None:
            raise RuntimeError("nothing was extracted")
        self.log.write(self.partition, *self._observed)

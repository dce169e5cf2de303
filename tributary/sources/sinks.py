"""Sinks: partitioned catalog tables, parquet folders and database tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.sources.base import Loader
from tributary.sources.jdbc import check_options
from tributary.types import as_type, try_to


@dataclass(frozen=True)
class PartitionDefinition:
    column_name: str
    column_type: T.DataType
    default_value: object = None

    @classmethod
    def of(cls, given) -> PartitionDefinition:
        if isinstance(given, cls):
            return given
        assert isinstance(given, dict), "partition_definitions has to be a list of dictionaries"
        name = given.get("column_name")
        assert isinstance(name, str) and name, "column_name has to be a non-empty string"
        kind = given.get("column_type")
        try:
            kind = as_type(kind)
        except Exception as e:  # the DDL parser raises engine errors of several kinds
            raise AssertionError(f"column_type has to name a type: {given.get('column_type')!r}") from e
        return cls(name, kind, given.get("default_value"))

    def literal(self) -> str:
        if isinstance(self.column_type, T.NumericType):
            return str(self.default_value)
        return "'" + str(self.default_value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class HiveLoader(Loader):
    """Write into a partitioned catalog table, created when missing.

    Partition columns that are missing, or all of them with ``overwrite_partition_value``, get their default
    values. Names and order of the columns must be the table's. ``clear_partition`` replaces the one partition
    written to in a single statement, also by no rows. Files are sized by a rebalancing shuffle, or come
    in ``repartition_size`` parts. The session's current database stays as it is.
    """

    def __init__(
        self, db_name: str, table_name: str, partition_definitions: list | tuple = ({"column_name": "dt", "column_type": "IntegerType", "default_value": None},),
        clear_partition: bool = True, repartition_size: int | None = None, auto_create_table: bool = True, overwrite_partition_value: bool = True,
    ):
        assert isinstance(partition_definitions, (list, tuple)), "partition_definitions has to be a list"
        if clear_partition and not overwrite_partition_value:
            raise ValueError("clear_partition needs overwrite_partition_value: only a partition known beforehand can be cleared")
        self.db_name, self.table_name, self.full_table_name = db_name, table_name, f"{db_name}.{table_name}"
        self.partition_definitions = tuple(PartitionDefinition.of(p) for p in partition_definitions)
        self.clear_partition, self.repartition_size = clear_partition, repartition_size
        self.auto_create_table, self.overwrite_partition_value = auto_create_table, overwrite_partition_value

    def _with_partitions(self, df: DataFrame) -> DataFrame:
        for p in self.partition_definitions:
            if p.column_name in df.columns and not self.overwrite_partition_value:
                continue
            assert p.default_value or p.default_value == 0, f"No default partition value set for partition column: {p.column_name}!"
            df = df.withColumn(p.column_name, try_to(F.lit(p.default_value), p.column_type))
        return df

    def _varying(self) -> list[str]:
        """Partition columns that may differ from row to row: their rows are brought together before writing."""
        return [] if self.overwrite_partition_value else [p.column_name for p in self.partition_definitions]

    def load(self, input_df: DataFrame) -> None:
        spark = input_df.sparkSession
        df = self._with_partitions(input_df)
        df = df.repartition(self.repartition_size) if self.repartition_size else df.hint("rebalance", *self._varying())
        if not spark.catalog.tableExists(self.full_table_name):
            if not self.auto_create_table:
                raise Exception(f"Table: {self.full_table_name} does not exist and `auto_create_table` is set to False")
            df.write.partitionBy(*[p.column_name for p in self.partition_definitions]).saveAsTable(self.full_table_name)
            return
        columns = spark.table(self.full_table_name).columns
        assert df.columns == columns, f"Input columns don't match the columns of the Hive table: {df.columns} and {columns}"
        if self.clear_partition and self.partition_definitions:
            self._replace_partition(df)
        else:
            df.write.insertInto(self.full_table_name)

    def _replace_partition(self, df: DataFrame) -> None:
        names = {p.column_name for p in self.partition_definitions}
        view = f"load_{uuid.uuid4().hex}"
        spec = ", ".join(f"`{p.column_name}` = {p.literal()}" for p in self.partition_definitions)
        df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names]).createOrReplaceTempView(view)
        try:
            df.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.full_table_name} PARTITION ({spec}) SELECT * FROM {view}")
        finally:
            df.sparkSession.catalog.dropTempView(view)


class ParquetLoader(Loader):
    """Write a parquet folder partitioned by ``partition_by``, with given partition values if wanted."""

    def __init__(self, path: str, partition_by: str | list[str] = "dt", explicit_partition_values: dict | None = None, compression_codec: str = "snappy", mode: str = "errorifexists"):
        self.path, self.mode, self.compression_codec = path, mode, compression_codec
        self.partition_by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        self.explicit_partition_values = dict(explicit_partition_values or {})

    def load(self, input_df: DataFrame) -> None:
        df = input_df.withColumns({c: F.lit(v) for c, v in self.explicit_partition_values.items()})
        df.write.mode(self.mode).partitionBy(*self.partition_by).option("compression", self.compression_codec).parquet(self.path)


class JDBCLoader(Loader):
    """Write into a table of a database, from ``num_partitions`` tasks at most, in batches of ``batch_size`` rows.

    Every task commits its own rows, so a load that fails half-way leaves rows behind; write into a fresh table and
    swap it in where that matters.
    """

    def __init__(self, jdbc_options: dict, table_name: str, mode: str = "append", num_partitions: int = 8, batch_size: int = 10_000):
        check_options(jdbc_options)
        self.jdbc_options, self.table_name, self.mode = dict(jdbc_options), table_name, mode
        self.num_partitions, self.batch_size = num_partitions, batch_size

    def load(self, input_df: DataFrame) -> None:
        options = {**self.jdbc_options, "dbtable": self.table_name, "numPartitions": str(self.num_partitions), "batchsize": str(self.batch_size)}
        input_df.write.format("jdbc").options(**options).mode(self.mode).save()

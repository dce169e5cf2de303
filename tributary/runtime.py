"""Helpers that touch the session: tables, shared storage and bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_released_at_exit: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _application_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors see.

    Only where the session names no such folder (local tests) a temporary one is set.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tributary-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/tributary-{context.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to shared storage; tables made from it are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the engine may be gone already; what is left lies in the application's own folder
        pass


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A name for a fresh folder in shared storage, deleted when the application ends regularly."""
    folder = _application_dir(spark)
    if folder not in _released_at_exit:
        _released_at_exit.add(folder)
        atexit.register(_release_at_exit, spark)
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to shared storage once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows, written as JSON, up to which a table may be broadcast.
MAX_BYTES = 128 << 20


def broadcast_within(df: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Measuring stops at ``max_rows + 1`` rows; beyond either bound Spark is left to shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    seen = df.limit(max_rows + 1).select(F.octet_length(F.to_json(row)).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes else df
